"""Foreign lists of statements: text lists, JSON of unknown shape, folders and zip archives of both.

Conversation logs and account files are never read; other files only if their name hints at memories,
unless the caller named one file. Oversized files count as empty. Null contents give no entries.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import SPACES as WHITE
from recordloom.operators.derive import subject_of, type_of
from recordloom.operators.timestamps import days_from_civil, to_utc_ms

# What is read from an export, and how its lines look.
SUFFIXES = [".json", ".md", ".txt", ".markdown", ".text"]
CONVERSATIONS = ["conversations.json", "conversation.json", "chat.html", "chat.json", "shared_conversations.json", "message_feedback.json", "model_comparisons.json", "projects.json"]
ACCOUNTS = ["user.json", "users.json"]
HINT = "memor|preference|profile|personaliz|user[-_ ]?context|model[-_ ]?set[-_ ]?context"
MOST_BYTES, MOST_FOLDERS, DEEPEST, LEAST_TEXT = 8 * 1024 * 1024, 4, 8, 4
TEXT_KEYS = ["text", "content", "memory", "value", "statement", "fact", "summary", "body"]
DATE_KEYS = ["created_at", "createdAt", "create_time", "saved_at", "savedAt", "updated_at", "updatedAt", "update_time", "timestamp", "date", "time"]
LIST_KEYS = ["memories", "memory", "entries", "saved_memories", "savedmemories", "user_memories", "model_set_context", "modelsetcontext", "facts", "preferences", "profile", "items"]
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
SPACES = WHITE.replace("\n", "")  # within a line
_S = f"[{SPACES}]"
FENCE, HEADING, RULE, LABEL = f"^{_S}*```", f"^{_S}*#{{1,6}}{_S}+", f"^{_S}*(?:-{{3,}}|\\*{{3,}}|_{{3,}}){_S}*$", f"^{_S}*[A-Za-z][A-Za-z ]{{0,38}}:{_S}*$"
BULLET = f"^{_S}*(?:[-*•‣>]+|\\d+[.)]){_S}+"
NAMED_DAY = f"(?:{MONTHS})[a-z]*\\.?{_S}+\\d{{1,2}},?{_S}+\\d{{4}}"
LEADING = f"^{_S}*[\\[(]?{_S}*(\\d{{4}}-\\d{{2}}-\\d{{2}}(?:[T ]\\d{{2}}:\\d{{2}}(?::\\d{{2}})?(?:\\.\\d+)?Z?)?|{NAMED_DAY}|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}){_S}*[\\])]?{_S}*(?:[-–—:|]{_S}*)?"
TRAILING = f"{_S}*[\\[(]{_S}*(?:saved|added|updated)?{_S}*[:{SPACES}]?{_S}*(\\d{{4}}-\\d{{2}}-\\d{{2}}(?:[T ][\\d:.]+Z?)?|{NAMED_DAY}){_S}*[\\])]{_S}*$"
QUOTE = "^[\"'“”]|[\"'“”]$"
# How the dates of such lines are read: ISO, a named month, month/day/year.
ISO_DAY, ISO_TIME = "(\\d{4})-(\\d{2})-(\\d{2})", "[Tt ](\\d{2}):(\\d{2})(?::(\\d{2}))?(?:\\.(\\d+))?[Zz]?"
_ISO = re.compile(f"{ISO_DAY}(?:{ISO_TIME})?", re.A)
_NAMED = re.compile(f"({MONTHS})[a-z]*\\.?{_S}+(\\d{{1,2}}),?{_S}+(\\d{{4}})", re.A | re.I)
_SLASHED = re.compile("(\\d{1,2})/(\\d{1,2})/(\\d{4})", re.A)
_SKIPPED = re.compile("|".join(f"(?:{p})" for p in (HEADING, RULE, LABEL)), re.A)
_FENCE, _BULLET, _QUOTE = (re.compile(p, re.A) for p in (FENCE, BULLET, QUOTE))
_LEADING, _TRAILING = (re.compile(p, re.A | re.I) for p in (LEADING, TRAILING))


def line_date_ms(text: str) -> int | None:
    """Epoch milliseconds of a date as lines of lists have it; None for impossible ones. Without a zone it is UTC."""
    hour = minute = second = ms = 0
    if m := _ISO.fullmatch(text):
        y, mo, d = (int(x) for x in m.group(1, 2, 3))
        hour, minute, second = (int(x or 0) for x in m.group(4, 5, 6))
        ms = int((m.group(7) or "0")[:3].ljust(3, "0"))
    elif m := _NAMED.fullmatch(text):
        y, mo, d = int(m.group(3)), MONTHS.split("|").index(m.group(1).lower()) + 1, int(m.group(2))
    elif m := _SLASHED.fullmatch(text):
        mo, d, y = (int(x) for x in m.groups())
    else:
        return None
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if not (1 <= mo <= 12 and 1 <= d <= (29 if mo == 2 and leap else DAYS[mo - 1]) and hour < 24 and minute < 60 and second < 60):
        return None
    return (int(days_from_civil(np.array([y]), np.array([mo]), np.array([d]))[0]) * 86400 + hour * 3600 + minute * 60 + second) * 1000 + ms


def line_entries(text: str) -> Iterator[tuple[int, str, str | None, int | None]]:
    """(line, entry, dated, ms) of one list, in a single pass over its lines.

    A leading date always goes; a trailing one is looked for if that gave no real date, and goes as well."""
    fenced = False
    for i, line in enumerate(re.split("\r?\n", text)):
        if _FENCE.search(line):
            fenced = not fenced
            continue
        if fenced or not line.strip(WHITE) or _SKIPPED.search(line):
            continue
        body, dated, ms = _BULLET.sub("", line, count=1).strip(WHITE), None, None
        if m := _LEADING.search(body):
            dated, ms, body = m.group(1), line_date_ms(m.group(1)), body[m.end() :].strip(WHITE)
        if ms is None and (m := _TRAILING.search(body)):
            dated, ms, body = m.group(1), line_date_ms(m.group(1)), body[: m.start()].strip(WHITE)
        body = _QUOTE.sub("", body).strip(WHITE)
        if len(body) >= LEAST_TEXT:
            yield i, body, None if ms is None else dated, ms


def text_entries(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line, entry, dated, ms): the statements of lists df(key, column), one per line outside code fences; dated is the text of a real date that led or ended the line.

    Null and empty lists have none; a list is read where its row lies, so nothing is shuffled."""
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, *e) for r, t in enumerate(b.column(1).to_pylist()) if t for e in line_entries(t)]
            columns = [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(columns[0]), *columns[1:]], names=[key, "line", "entry", "dated", "ms"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {key_type.simpleString()}, line int, entry string, dated string, ms long")


def date_ms(v: object) -> int | None:
    """Epoch milliseconds of a date as such files have it: seconds below 10^12, else milliseconds, else a notation."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int | float):
        return int(v * 1000 if v < 1e12 else v) if 0 < v < 8.64e15 else None
    return to_utc_ms([v], [None], [None])[0][0] if isinstance(v, str) and v.strip() else None


def json_entries(root: object) -> list[tuple[str, int | None]]:
    """(statement, epoch milliseconds) of everything that looks like an entry in parsed JSON."""
    out: list[tuple[str, int | None]] = []

    def entry(o: dict) -> tuple[str, int | None] | None:
        text = next((v.strip() for k in TEXT_KEYS if isinstance(v := o.get(k), str) and len(v.strip()) >= LEAST_TEXT), None)
        return None if text is None else (text, next((ms for k in DATE_KEYS if (ms := date_ms(o.get(k))) is not None), None))

    todo: list[tuple[object, str, int]] = [(root, "", 0)]
    while todo:
        node, key, depth = todo.pop()
        if depth > DEEPEST or node is None:
            continue
        below: list[tuple[object, str, int]] = []
        if isinstance(node, list):
            for x in node:
                if isinstance(x, str):
                    if key.lower() in LIST_KEYS and len(x.strip()) >= LEAST_TEXT:
                        out.append((x.strip(), None))
                elif isinstance(x, dict) and (e := entry(x)):
                    out.append(e)
                elif isinstance(x, dict | list):
                    below.append((x, key, depth + 1))
        elif isinstance(node, dict):
            for k, v in node.items():
                if isinstance(v, str) and k.lower() in LIST_KEYS:
                    out += [(line.strip(), None) for line in v.splitlines() if len(line.strip()) >= LEAST_TEXT]
                elif isinstance(v, dict | list):
                    below.append((v, k, depth + 1))
        todo += reversed(below)
    return out


def zip_entries(content: bytes) -> list[tuple[str, str]]:
    """(name, text) of the readable files of an archive; only stored and deflated ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(tuple(SUFFIXES))]
        if any(i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for i in infos):
            raise ValueError("unsupported compression in archive")
        return [(i.filename, z.read(i).decode("utf-8", "replace") if i.file_size <= MOST_BYTES else "") for i in infos]


def load(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of a file, a folder (down to MOST_FOLDERS levels) or zip archives in either.

    Of files over MOST_BYTES only the name comes, with empty content: their bytes are not read."""
    folder = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.col("path"))
    plain_name = f"(?:{'|'.join(re.escape(s) for s in SUFFIXES)})$"
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape("/" + re.sub("^[a-z]+:/*", "", folder).lstrip("/")) + "/?", "")
    wanted = files.where(name.rlike(plain_name) | name.endswith(".zip")).where(F.size(F.split(below, "/")) <= MOST_FOLDERS + 1)
    # conditions on the length reach the scan, which then leaves the content of other files unread
    small, large = wanted.where(F.col("length") <= MOST_BYTES), wanted.where(F.col("length") > MOST_BYTES)
    is_zip = F.substring("content", 1, 2) == F.lit(b"PK")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [e for c in b.column(1).to_pylist() for e in zip_entries(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["name", "content"])

    plain = small.where(~is_zip & name.rlike(plain_name)).select(F.col("path").alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    unread = large.where(name.rlike(plain_name)).select(F.col("path").alias("name"), F.lit("").alias("content"))
    # an archive may be large, only its files may not
    archives = small.where(is_zip).select("path", "content").unionByName(large.where(name.endswith(".zip")).select("path", "content"))
    return plain.unionByName(unread).unionByName(archives.mapInArrow(unpack, "name string, content string"))


def sources_report(files: DataFrame, explicit: bool = False) -> DataFrame:
    """(name, kind, read): which of files(name, content) an import reads, and what the others are."""
    return files.select("name", file_kind(F.col("name"), explicit).alias("kind")).withColumn("read", F.col("kind") == "memory")


def file_kind(name: Column, explicit: bool = False) -> Column:
    """conversation, account, memory or other, by the name of a file."""
    base = F.lower(F.regexp_extract(name, "[^/\\\\]+$", 0))
    hinted = F.lit(True) if explicit else base.rlike(HINT)
    return F.when(base.isin(*CONVERSATIONS), "conversation").when(base.isin(*ACCOUNTS), "account").when(hinted, "memory").otherwise("other")


def entries(files: DataFrame, explicit: bool = False) -> DataFrame:
    """(name, pos, entry, ms): the statements of the memory files among files(name, content)."""
    read = files.where(file_kind(F.col("name"), explicit) == "memory").where("content is not null")
    is_json = F.lower("name").endswith(".json") | F.col("content").rlike("^\\s*[\\[{]")
    parsed = F.try_parse_json("content").isNotNull()
    strict = F.when(F.lower("name").endswith(".json") & ~parsed, F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("name"))).cast("boolean")).otherwise(is_json & parsed)
    marked = read.withColumn("j", strict)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, i, *e) for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, e in enumerate(json_entries(json.loads(c)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["name", "pos", "entry", "ms"])

    schema = "name string, pos int, entry string, ms long"
    from_json = marked.where("j").select("name", "content").mapInArrow(walk, schema)
    lines = text_entries(marked.where("not j"), "name", "content").select("name", F.col("line").alias("pos"), "entry", "ms")
    return from_json.unionByName(lines)


def records(found: DataFrame, vendor: str, now: Column) -> DataFrame:
    """Store records of entries(name, pos, entry, ms): confirmed by the user, active, of derived type and subject, without scope and expiry."""
    at = F.coalesce(F.timestamp_millis("ms"), now)
    return found.select(
        F.md5(F.concat_ws("|", "name", F.col("pos").cast("string"), "entry")).alias("id"), F.col("entry").alias("text"), type_of(F.col("entry")).alias("type"), subject_of(F.col("entry")).alias("subject"),
        F.lit("user-confirmed").alias("source"), F.lit("active").alias("status"), at.alias("created_at"), at.alias("updated_at"), F.struct(F.lit(f"import:{vendor}").alias("name"), F.lit(None).cast("string").alias("version")).alias("client"),
    )
