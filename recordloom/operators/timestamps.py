"""Mixed timestamp notations and time zones, normalised to one UTC instant.

Each string becomes a shape mask: runs of digits by their length, words by their class (month, weekday,
am/pm, zone, filler, unknown), other characters as they are. Each distinct mask is mapped to a parser
once; all strings of a mask are then converted together in NumPy, local times through transition
tables of their zone.

Rules: without a zone of its own a notation is read in the row's zone hint, or UTC if that is null. A
date alone is its first instant. A local time that occurs twice is the earlier instant, a skipped one
is read with the offset before the change: both are the offset before the transition. Numeric day and
month follow the locale (month first only for MONTH_FIRST). Two-digit years are 20xx. Digits finer
than milliseconds are cut off. Null, words, a time alone, impossible dates and unknown zone hints give
null; the results of repeated rows are equal.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of months, first in English, then German, French, Spanish, Italian, Portuguese, Dutch.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene gennaio gen janeiro januari",
    2: "february feb februar februari février fevrier févr fevr fév febrero febbraio fevereiro fev",
    3: "march mar märz maerz mär mrz mars marzo março maart mrt",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maggio mag maio mei",
    6: "june jun juni juin junio giugno giu junho",
    7: "july jul juli juillet juil julio luglio lug julho",
    8: "august aug août aout agosto ago agustus augustus",
    9: "september sep sept septembre septiembre settembre set setembro",
    10: "october oct oktober okt octobre octubre ottobre ott outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre decembre déc diciembre dic dicembre dezembro",
}
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mer jeu ven sam dim "
    "lunes martes miércoles jueves viernes sábado domingo mié jue vie sáb dom"
)
FILLERS = "saved added updated created on at the of de del à a um uhr o'clock le el am les las st nd rd th er date time kl klo"
# Zone abbreviations in their usual European, North American and Japanese meanings, in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360,
    "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "jst": 540,
}
MONTH_FIRST = ("en-us",)

_MONTH = {w: m for m, names in MONTHS.items() for w in names.split()}
_CLASS = {w: "F" for w in FILLERS.split()} | {w: "W" for w in WEEKDAYS.split()} | {w: "Z" for w in ZONES} | {"t": "T", "h": "H", "pm": "P"} | {w: "M" for w in _MONTH}
_LENGTH = "0123456789abcdefghijk"
_TOKEN = re.compile(r"\d+|[^\W\d_年月日時分秒]+(?:['’][^\W\d_]+)?")
_DOTTED = re.compile(r"\b([ap])\.\s?m\b\.?", re.I)
_SPACE = re.compile(r"\s+")
_TRIM = " \t()[]{}<>\"'“”„«»|;:,*_-–—"

_TIME = r"(?P<time>[12](?:[:.時]| ?H ?)2(?:[:.分]2(?:[.,][1-9a-k])?)?[分秒]?(?: ?P)?|[12] ?P)"
_ZONE = r"(?P<zone>Z|(?:Z ?)?[+−-](?:2:?2|4|[12])(?: ?\(Z\))?)"
_GAP = r"(?:,? (?:F )*|, ?|T|-|:)"
_DATES = {
    "ymd": r"4(?P<s>[-/.])[12](?P=s)[12]|4年[12]月[12]日|8",
    "num": r"[12](?P<s>[-/.])[12](?P=s)[24]",
    "dmy": r"[12]F?\.?[ -]?(?:F )*M\.?,?[ -]?(?:F )*[24]",
    "mdy": r"M\.?[ -][12]F?,? [24]",
    "ymn": r"4[ -]M\.?[ -][12]",
}
_WHOLE = {k: re.compile(rf"(?:W\.?,? )?(?:F )*(?:{d})(?:{_GAP}{_TIME}(?: ?F)?(?: ?{_ZONE})?)?") for k, d in _DATES.items()}
_UNIX = re.compile(r"W,? M [12] 2:2:2(?: P)?(?: (?P<zone>Z|[+-]4))? 4")
_TIME_FIRST = {k: re.compile(rf"{_TIME}(?: ?{_ZONE})?,? (?:F )*(?:W,? )?(?P<date>{d})") for k, d in _DATES.items() if k != "ymd"}
_EPOCH = re.compile(r"(?:[9a](?:\.[1-9])?|d|g|j)")


def shape(text: str) -> tuple[str, list[str]]:
    """(mask, tokens) of a notation; tokens are its runs of digits and its words of meaning, in order."""
    t = _SPACE.sub(" ", unicodedata.normalize("NFKC", text)).strip(_TRIM)
    t = _DOTTED.sub(r"\1m", t)
    out: list[str] = []
    tokens: list[str] = []
    at = 0
    for m in _TOKEN.finditer(t):
        out.append(t[at : m.start()])
        at = m.end()
        word = m.group()
        if word.isdigit():
            out.append(_LENGTH[len(word)] if len(word) < len(_LENGTH) else "X")
            tokens.append(word)
            continue
        low = word.lower()
        kind = _CLASS.get(low, "X")
        if low == "am" and len(out) > 1 and out[-2][-1:].isdigit():
            kind = "P"  # after a number; before one it is a German "on"
        if kind == "P" or kind in "MZ":
            tokens.append(low)
        out.append(kind)
    out.append(t[at:])
    mask = "".join(out).replace("−", "-")
    # what only introduces a date, or closes one
    mask = re.sub(r"^(?:F[:,]? )+", "", mask)
    return mask.rstrip(" .)]"), tokens


class Parser:
    """How the tokens of one mask are read: `fields` names each token."""

    def __init__(self, kind: str, fields: list[str]):
        self.kind, self.fields = kind, fields


def _time_fields(mask: str) -> list[str]:
    """The fields of a time of day by its mask."""
    names = iter(["hour", "minute", "second", "fraction"])
    return [("pm" if c == "P" else next(names)) for c in mask if c == "P" or c in _LENGTH]


def _zone_fields(mask: str) -> list[str]:
    out = []
    for i, c in enumerate(mask):
        if c == "Z":
            # of an abbreviation and an offset the offset counts
            out.append("zone" if len(mask) == 1 else "skip")
        elif c in _LENGTH:
            sign = "-" if "-" in mask else "+"
            out.append(f"{sign}hhmm" if c == "4" else f"{sign}hh" if "hh" not in "".join(out) else f"{sign}mm")
    return out


def _date_fields(kind: str, mask: str) -> list[str]:
    if mask == "8":
        return ["date8"]
    order = {"ymd": "ymd", "num": "abY", "dmy": "dmY", "mdy": "mdY", "ymn": "ymd"}[kind]
    full = {"y": "year", "Y": "year", "m": "month", "d": "day", "a": "first", "b": "second_"}
    return [full[c] for c in order]


@lru_cache(maxsize=20_000)
def parser_of(mask: str) -> Parser | None:
    compact = re.fullmatch(r"8T(?P<t>[46])(?P<f>\.[1-9])?(?P<zone>Z|[+-](?:4|2:2|2))?", mask)
    if compact:
        fields = ["date8", "hhmmss" if compact["t"] == "6" else "hhmm", *(["fraction"] if compact["f"] else [])]
        return Parser("local", fields + _zone_fields(compact["zone"] or ""))
    if _EPOCH.fullmatch(mask):
        return Parser("epoch", ["whole", *(["fraction"] if "." in mask else [])])
    unix = _UNIX.fullmatch(mask)
    if unix:
        return Parser("local", ["month", "day", "hour", "minute", "second", *(["pm"] if "P" in mask else []), *_zone_fields(unix["zone"] or ""), "year"])
    for kind, whole in _WHOLE.items():
        if m := whole.fullmatch(mask):
            end = m.start("time") if m["time"] else len(mask)
            date = re.sub(r"^(?:W\.?,? )?(?:F )*", "", mask[:end])
            if kind == "ymd" and date[:1] == "8":
                date = "8"
            return Parser("local", _date_fields(kind, date) + _time_fields(m["time"] or "") + _zone_fields(m["zone"] or ""))
    for kind, whole in _TIME_FIRST.items():
        if m := whole.fullmatch(mask):
            return Parser("local", _time_fields(m["time"]) + _zone_fields(m["zone"] or "") + _date_fields(kind, m["date"]))
    return None


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


FIRST_YEAR, LAST_YEAR = 1900, 2100


@lru_cache(maxsize=1)
def zone_version() -> str:
    """The version of the installed tz database, as its files or package name it; else a digest of the offsets of some zones."""
    for folder in TZPATH:
        for name, found in (("+VERSION", r"\S+"), ("tzdata.zi", r"(?<=# version )\S+")):
            with contextlib.suppress(OSError), open(os.path.join(folder, name), encoding="utf-8") as f:
                if m := re.search(found, f.readline()):
                    return m.group()
    with contextlib.suppress(ImportError):
        import tzdata

        return tzdata.IANA_VERSION
    some = [transitions(z) for z in ("Europe/Berlin", "America/New_York", "America/Sao_Paulo", "Asia/Tehran", "Africa/Cairo", "Pacific/Apia")]
    return hashlib.sha256(b"".join(x.tobytes() for t in some if t for x in t)).hexdigest()[:12]


@lru_cache(maxsize=700)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(local seconds from which each offset holds, offsets in seconds) of a zone of the installed tz database, or None."""
    try:
        tz = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return None

    def offset(t: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=t)).astimezone(tz).utcoffset().total_seconds())

    start = int(datetime(FIRST_YEAR, 1, 2, tzinfo=UTC).timestamp())
    stop = int(datetime(LAST_YEAR, 1, 1, tzinfo=UTC).timestamp())
    starts, offsets = [], [offset(start)]
    a, now = start, offsets[0]
    while a < stop:
        b = a + 7 * 86400
        if (then := offset(b)) != now:
            low, high = a, b
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == now else (low, middle)
            then = offset(high)
            # both a gap and an overlap are read with the offset before it
            starts.append(high + max(now, then))
            offsets.append(then)
            now, b = then, high
        a = b
    return np.array(starts, np.int64), np.array(offsets, np.int64)


def local_to_utc(seconds: np.ndarray, zone: str | None) -> np.ndarray | None:
    """UTC seconds of local ones."""
    table = transitions(zone.strip() if zone and zone.strip() else "UTC")
    if table is None:
        return None
    out = seconds - table[1][np.searchsorted(table[0], seconds, side="right")]
    # outside the table, with two days for the offsets
    first, last = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (FIRST_YEAR, LAST_YEAR))
    for i in np.flatnonzero((seconds < first + 3 * 86400) | (seconds >= last - 2 * 86400)).tolist():
        local = datetime(1970, 1, 1) + timedelta(seconds=int(seconds[i]))
        out[i] = seconds[i] - int(ZoneInfo(zone.strip() if zone and zone.strip() else "UTC").utcoffset(local).total_seconds())
    return out


def _convert(parser: Parser, rows: list[list[str]], month_first: np.ndarray, zones: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(milliseconds, good) of strings of one mask."""
    n = len(rows)
    columns = {f: [r[i] for r in rows] for i, f in enumerate(parser.fields)}
    number = lambda f: np.array(columns[f], np.int64) if f in columns else None
    millis = np.zeros(n, np.int64)
    if "fraction" in columns:
        millis = np.array([int(f[:3].ljust(3, "0")) for f in columns["fraction"]], np.int64)
    if parser.kind == "epoch":
        whole, digits = number("whole"), len(columns["whole"][0])
        return whole * 1000 + millis if digits <= 10 else whole // {13: 1, 16: 1000, 19: 1_000_000}[digits], np.ones(n, bool)
    if "date8" in columns:
        whole = number("date8")
        y, m, d = whole // 10000, whole // 100 % 100, whole % 100
    else:
        y = number("year")
        y = np.where(np.array([len(x) <= 2 for x in columns["year"]], bool), y + 2000, y)
        if "first" in columns:
            a, b = number("first"), number("second_")
            m, d = np.where(month_first, a, b), np.where(month_first, b, a)
        else:
            d = number("day")
            m = np.array([_MONTH[w] if (w := x) in _MONTH else int(x) for x in columns["month"]], np.int64)
    good = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1) & (y <= 9999)
    m = np.where(good, m, 1)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    good &= d <= np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[m - 1] + ((m == 2) & leap)
    zero = np.zeros(n, np.int64)
    if "hhmmss" in columns or "hhmm" in columns:
        whole = number("hhmmss") if "hhmmss" in columns else number("hhmm") * 100
        hour, minute, second = whole // 10000, whole // 100 % 100, whole % 100
    else:
        hour, minute, second = (x if (x := number(f)) is not None else zero for f in ("hour", "minute", "second"))
    if "pm" in columns:
        good &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * np.array([w == "pm" for w in columns["pm"]])
    good &= (hour < 24) & (minute < 60) & (second < 60)
    local = days_from_civil(y, m, np.where(good, d, 1)) * 86400 + hour * 3600 + minute * 60 + second
    local = np.where(good, local, 0)
    fields = set(parser.fields)
    if "zone" in fields:
        return (local - 60 * np.array([ZONES[w] for w in columns["zone"]], np.int64)) * 1000 + millis, good
    offset = None
    for sign, factor in (("+", 1), ("-", -1)):
        if f"{sign}hhmm" in fields:
            x = number(f"{sign}hhmm")
            offset, most = factor * (x // 100 * 3600 + x % 100 * 60), x % 100
        elif f"{sign}hh" in fields:
            most = number(f"{sign}mm") if f"{sign}mm" in fields else zero
            offset = factor * (number(f"{sign}hh") * 3600 + most * 60)
    if offset is not None:
        good &= (np.abs(offset) <= 18 * 3600) & (most < 60)
        return (local - offset) * 1000 + millis, good
    out = np.zeros(n, np.int64)
    names = np.array([z or "" for z in zones], object)
    for z in dict.fromkeys(names):
        at = names == z
        utc = local_to_utc(local[at], z)
        if utc is None:
            good[at] = False
        else:
            out[at] = utc * 1000 + millis[at]
    return out, good


def to_utc_ms(texts: list[str | None], locales: list[str | None], hints: list[str | None]) -> tuple[list[int | None], list[str | None]]:
    """(milliseconds or None, masks) of notations."""
    groups: dict[str, list[int]] = {}
    tokens: list[list[str]] = [[]] * len(texts)
    masks: list[str | None] = [None] * len(texts)
    for i, t in enumerate(texts):
        if t is not None:
            masks[i], tokens[i] = shape(t)
            groups.setdefault(masks[i], []).append(i)
    out: list[int | None] = [None] * len(texts)
    for mask, at in groups.items():
        parser = parser_of(mask)
        if parser is None or len(parser.fields) != len(tokens[at[0]]):
            continue
        first = np.array([(locales[i] or "").strip().lower().replace("_", "-") in MONTH_FIRST for i in at])
        ms, good = _convert(parser, [tokens[i] for i in at], first, [hints[i] for i in at])
        for i, v, g in zip(at, ms.tolist(), good.tolist(), strict=True):
            if g:
                out[i] = v
    return out, masks


def normalised(df: DataFrame, key: str = "entry_id", column: str = "created_at", zones: str | None = None) -> DataFrame:
    """(key, utc_ms long, utc timestamp, shape string, zones string) of df(key, column, locale, tz_hint): one row per row, null where there is no instant.

    zones is the version of the tz database (default: the driver's); executors that have another one are refused."""
    version = zones or zone_version()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if zone_version() != version:
            raise RuntimeError(f"tz database {zone_version()} on an executor, wanted is {version}")
        for b in batches:
            ms, masks = to_utc_ms(*(b.column(i).to_pylist() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ms, pa.int64()), pa.array(masks, pa.string())], names=[key, "utc_ms", "shape"])

    out = df.select(F.col(key).cast("long"), F.col(column).alias("_t"), "locale", "tz_hint").mapInArrow(run, f"`{key}` long, utc_ms long, shape string")
    return out.withColumns({"utc": F.timestamp_millis("utc_ms"), "zones": F.lit(version)})


def found(raw_entries: DataFrame) -> DataFrame:
    """(entry_id, utc_ms) of the entries that have an instant."""
    return normalised(raw_entries).where("utc_ms is not null").select("entry_id", "utc_ms")
