"""Queries of the core operators over the given tables, each with the SQL that must give the same rows.

Every query judges at the fixed instant AS_OF and covers whole tables. Instants come out as epoch
milliseconds, measures rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.operators import age, derive, forget, integrate, rank, screen, timestamps
from recordloom.operators import normalize as N
from recordloom.session import dealt
from recordloom.sources import foreign, gatelog, store
from recordloom.streaming import gate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = "2026-03-01T00:00:00+00:00"
AS_OF_MICROS = 1_772_323_200_000_000


def as_of() -> Column:
    return F.timestamp_micros(F.lit(AS_OF_MICROS))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_dealt(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """For queries that work on texts."""
    return dealt(read(spark, sf_dir, table))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all batches, one row each."""
    return read(spark, sf_dir, "export_envelopes").select("batch_no", F.posexplode("memories").alias("pos", "m")).select("batch_no", F.col("pos").cast("long").alias("pos"), "m.*")


def ms(c: str) -> Column:
    return F.unix_millis(c)


# ---- pieces of SQL ----------------------------------------------------------------------------

WS = X.SPACES
NOW = f"TIMESTAMPTZ '{AS_OF}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def q_list(values: list[str]) -> str:
    return ", ".join(map(q, values))


def sql_trim(c: str) -> str:
    return f"trim({c}, {q(WS)})"


def sql_scope(c: str = "scope") -> str:
    return f"coalesce(nullif(lower({sql_trim(c)}), ''), 'default')"


def sql_subject(c: str = "subject") -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(lower({sql_trim(c)}), '[\\s ._]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '')"


SQL_TRUST = "CASE source WHEN 'user-explicit' THEN 3 WHEN 'user-confirmed' THEN 2 ELSE 1 END"
SQL_LIVE = f"(status = 'active' AND (expires_at IS NULL OR expires_at > {NOW}))"
SQL_ITEMS = "SELECT batch_no, CAST(i - 1 AS BIGINT) AS pos, m.* FROM (SELECT batch_no, unnest(memories) AS m, generate_subscripts(memories, 1) AS i FROM export_envelopes)"
SQL_KEYED = f"SELECT *, {sql_scope()} AS scope_key, {sql_subject()} AS subject_key, {SQL_TRUST} AS trust FROM memories"
SQL_ACTED = f"""SELECT *, CASE WHEN before IS NULL THEN 'created' WHEN trust < before THEN 'conflict' ELSE 'superseded' END AS action FROM (
  SELECT *, max(trust) OVER (PARTITION BY scope_key, subject_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({SQL_KEYED}) WHERE subject_key IS NOT NULL)"""
SQL_EXPIRY = "coalesce(expires_at, CASE type WHEN 'project' THEN created_at + INTERVAL 2160 HOUR WHEN 'state' THEN created_at + INTERVAL 48 HOUR END)"
SQL_SINGLES = "\\p{Han}\\p{Hiragana}\\p{Katakana}"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(regexp_replace({c}, '([{SQL_SINGLES}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def sql_fold(c: str) -> str:
    """Marks off, and the compatibility forms that the tables hold, in lower case."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    for a, b in (("…", "..."), (" ", " "), ("º", "o"), ("ª", "a"), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4"), ("𝒲", "W"), ("²", "2"), ("³", "3"), ("™", "TM"), ("ﬁ", "fi")):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"lower(strip_accents(translate({c}, {q(wide)}, {q(plain)})))"


def sql_stem(c: str) -> str:
    c = f"regexp_replace({c}, '^(.{{3,}}?)(?:ing|edly|ed|ly)$', '\\1')"
    c = f"regexp_replace({c}, '^(.{{2,}})ies$', '\\1y')"
    return f"regexp_replace({c}, '^(.{{3,}}?)(?:es|s)$', '\\1')"


def sql_stems(folded: str) -> str:
    """A list of stems of a folded text; stop words count only if there is nothing else."""
    kept = f"list_filter({sql_words(folded)}, lambda w: w NOT IN ({q_list(X.STOPWORDS)}))"
    return f"list_transform(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {sql_words(folded)} END, lambda w: {sql_stem('w')})"


def sql_grams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length('  ' || {c} || ' ') - 1), lambda i: substring('  ' || {c} || ' ', i, 3)))"


# ---- integration ------------------------------------------------------------------------------


@query(f"""WITH a AS ({SQL_ACTED}), r AS (SELECT *, row_number() OVER (PARTITION BY scope_key, subject_key ORDER BY seq DESC) AS rn FROM a WHERE action <> 'conflict'),
n AS (SELECT scope_key, subject_key, count(*) AS candidates FROM a GROUP BY ALL)
SELECT r.scope_key, r.subject_key, r.seq, CAST(r.trust AS BIGINT) AS trust, n.candidates FROM r JOIN n USING (scope_key, subject_key) WHERE rn = 1""")
def current_facts(s: SparkSession, d: str) -> DataFrame:
    return integrate.current_facts(read(s, d, "memories")).withColumn("trust", F.col("trust").cast("long"))


@query(f"""WITH a AS ({SQL_ACTED}) SELECT seq, action, CASE WHEN action <> 'conflict' THEN min(CASE WHEN action <> 'conflict' THEN seq END)
OVER (PARTITION BY scope_key, subject_key ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS superseded_by_seq FROM a""")
def supersession_chain(s: SparkSession, d: str) -> DataFrame:
    return integrate.supersession(read(s, d, "memories")).select("seq", "action", "superseded_by_seq")


@query(f"""WITH a AS ({SQL_ACTED}) SELECT scope_key, count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'superseded') AS superseded, count(*) FILTER (action = 'conflict') AS conflict FROM a GROUP BY 1""")
def conflict_counts(s: SparkSession, d: str) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return integrate.supersession(read(s, d, "memories")).groupBy("scope_key").agg(n("created"), n("superseded"), n("conflict"))


@query(f"SELECT {sql_scope()} AS scope_key, lower({sql_trim('text')}) AS text_key, min(seq) AS seq, count(*) AS copies FROM memories GROUP BY 1, 2")
def exact_dedup(s: SparkSession, d: str) -> DataFrame:
    return integrate.first_of_text(read(s, d, "memories"))


@query(f"""WITH i AS ({SQL_ITEMS}) SELECT batch_no, pos FROM i WHERE EXISTS (SELECT 1 FROM memories m WHERE {SQL_LIVE.replace('status', 'm.status').replace('expires_at', 'm.expires_at')}
AND {sql_scope('m.scope')} = {sql_scope('i.scope')} AND lower({sql_trim('m.text')}) = lower({sql_trim('i.text')}))""")
def duplicate_items(s: SparkSession, d: str) -> DataFrame:
    return integrate.duplicates(items(s, d), read(s, d, "memories"), as_of()).select("batch_no", "pos")


@query(f"""WITH i AS (SELECT *, {sql_scope()} AS scope_key, {sql_subject()} AS subject_key, {SQL_TRUST} AS trust FROM ({SQL_ITEMS})),
h AS (SELECT scope_key, subject_key, max(CASE WHEN source IN ({q_list(N.SOURCES)}) THEN trust END) AS max_trust, count(*) AS matches FROM ({SQL_KEYED}) WHERE status = 'active' AND subject_key IS NOT NULL GROUP BY 1, 2)
SELECT batch_no, pos, CASE WHEN matches IS NULL THEN 'created' WHEN trust < max_trust THEN 'conflict' ELSE 'superseded' END AS action, matches, CAST(max_trust AS BIGINT) AS max_trust FROM i LEFT JOIN h USING (scope_key, subject_key)""")
def subject_matches(s: SparkSession, d: str) -> DataFrame:
    return integrate.subject_matches(items(s, d), read(s, d, "memories")).select("batch_no", "pos", "action", "matches", F.col("max_trust").cast("long").alias("max_trust"))


@query("""WITH f AS (SELECT id, min(seq) AS next_seq, arg_min(status, seq) AS next_status FROM memories GROUP BY id)
SELECT m.seq, f.next_seq, f.next_status FROM memories m LEFT JOIN f ON m.superseded_by = f.id WHERE m.superseded_by IS NOT NULL""")
def successors(s: SparkSession, d: str) -> DataFrame:
    return integrate.successors(read(s, d, "memories"))


@query("""WITH RECURSIVE f AS (SELECT id, min(seq) AS n FROM memories GROUP BY id), s AS (SELECT m.seq, f.n FROM memories m JOIN f ON m.superseded_by = f.id),
c AS (SELECT seq, n AS node, CAST(1 AS BIGINT) AS length FROM s UNION ALL SELECT c.seq, s.n, c.length + 1 FROM c JOIN s ON s.seq = c.node WHERE c.length < 1000)
SELECT seq, arg_max(node, length) AS "end", max(length) AS length FROM c GROUP BY seq""")
def chain_ends(s: SparkSession, d: str) -> DataFrame:
    return integrate.chain_ends(read(s, d, "memories"))


def sql_fold_rows(order: str, source: str) -> str:
    """What the fold needs of records or candidates; vectors without a direction are none."""
    return f"""SELECT {order}, {sql_scope()} AS scope_key, {sql_subject()} AS subject_key, coalesce(lower({sql_trim('text')}), '') AS text_key, CAST({SQL_TRUST} AS BIGINT) AS trust, coalesce(epoch_us(created_at), 0) AS created, epoch_us(expires_at) AS expires,
CASE WHEN len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 THEN embedding END AS e FROM ({source})"""


def sql_gate_fold(cand: str, held: str) -> str:
    """The fold as recursion over the candidates of each scope: the state is the list of those accepted so far. cand has c, the order; held has seq.

    A record is active as long as no accepted later candidate has its subject; texts, subjects and vectors that may meet are paired before."""
    return f"""WITH RECURSIVE c0 AS MATERIALIZED ({cand}), h AS MATERIALIZED ({held}),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY c) AS n FROM c0),
same AS MATERIALIZED (SELECT scope_key, subject_key, list(n ORDER BY n) AS ns FROM c WHERE subject_key IS NOT NULL GROUP BY ALL),
ht AS MATERIALIZED (SELECT c.scope_key, c.n, list({{'seq': h.seq, 'same': coalesce(same.ns, [])}} ORDER BY h.seq) AS l FROM c JOIN h ON h.scope_key = c.scope_key AND h.text_key = c.text_key AND (h.expires IS NULL OR h.expires > c.created) LEFT JOIN same ON same.scope_key = h.scope_key AND same.subject_key = h.subject_key GROUP BY ALL),
ct AS MATERIALIZED (SELECT c.scope_key, c.n, list({{'seq': p.n, 'same': list_filter(coalesce(same.ns, []), lambda x: x > p.n)}} ORDER BY p.n) AS l FROM c JOIN c p ON p.scope_key = c.scope_key AND p.n < c.n AND p.text_key = c.text_key AND (p.expires IS NULL OR p.expires > c.created) LEFT JOIN same ON same.scope_key = p.scope_key AND same.subject_key = p.subject_key GROUP BY ALL),
hs AS MATERIALIZED (SELECT scope_key, subject_key, max(trust) AS most, min(seq) AS first, max(seq) AS last, count(*) AS k FROM h WHERE subject_key IS NOT NULL GROUP BY ALL),
hv AS MATERIALIZED (SELECT c.scope_key, c.n, list({{'seq': h.seq, 'same': coalesce(same.ns, []), 'cos': round(list_cosine_similarity(c.e, h.e), 9)}} ORDER BY round(list_cosine_similarity(c.e, h.e), 9) DESC, h.seq) AS l FROM c JOIN h ON h.scope_key = c.scope_key AND len(c.e) = len(h.e) AND (h.expires IS NULL OR h.expires > c.created) LEFT JOIN same ON same.scope_key = h.scope_key AND same.subject_key = h.subject_key WHERE list_cosine_similarity(c.e, h.e) >= 0.6 - 1e-6 GROUP BY ALL),
cv AS MATERIALIZED (SELECT c.scope_key, c.n, list({{'seq': p.n, 'same': list_filter(coalesce(same.ns, []), lambda x: x > p.n), 'cos': round(list_cosine_similarity(c.e, p.e), 9)}} ORDER BY round(list_cosine_similarity(c.e, p.e), 9) DESC, p.n) AS l FROM c JOIN c p ON p.scope_key = c.scope_key AND p.n < c.n AND len(c.e) = len(p.e) AND (p.expires IS NULL OR p.expires > c.created) LEFT JOIN same ON same.scope_key = p.scope_key AND same.subject_key = p.subject_key WHERE list_cosine_similarity(c.e, p.e) >= 0.6 - 1e-6 GROUP BY ALL),
a AS MATERIALIZED (SELECT c.scope_key, c.n, c.c, c.subject_key, c.trust, same.ns, coalesce(ht.l, []) AS ht, coalesce(ct.l, []) AS ct, coalesce(hv.l, []) AS hv, coalesce(cv.l, []) AS cv, hs.most, hs.first, hs.last, hs.k FROM c LEFT JOIN same USING (scope_key, subject_key) LEFT JOIN ht USING (scope_key, n) LEFT JOIN ct USING (scope_key, n) LEFT JOIN hv USING (scope_key, n) LEFT JOIN cv USING (scope_key, n) LEFT JOIN hs USING (scope_key, subject_key)),
t AS MATERIALIZED (SELECT scope_key, n, trust FROM c),
f AS (SELECT scope_key, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(n BIGINT, trust BIGINT)[]) AS acc, CAST(NULL AS BIGINT) AS c, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS match_held, CAST(NULL AS BIGINT) AS match_cand, CAST(NULL AS BIGINT) AS retired, CAST(NULL AS BIGINT) AS related FROM (SELECT DISTINCT scope_key FROM c0)
UNION ALL SELECT scope_key, n, CASE WHEN action IN ('created', 'superseded') THEN list_append(acc, {{'n': n, 'trust': trust}}) ELSE acc END, c, action,
 CASE action WHEN 'duplicate' THEN dup_h WHEN 'conflict' THEN CASE WHEN mine IS NULL THEN first END WHEN 'superseded' THEN CASE WHEN mine IS NULL THEN last END WHEN 'possible_duplicate' THEN CASE WHEN best_h >= best_c THEN near_h END END,
 CASE action WHEN 'duplicate' THEN CASE WHEN dup_h IS NULL THEN dup_c END WHEN 'conflict' THEN mine WHEN 'superseded' THEN mine WHEN 'possible_duplicate' THEN CASE WHEN best_h < best_c THEN near_c END END,
 CASE WHEN action = 'superseded' THEN CASE WHEN mine IS NULL THEN k ELSE 1 END ELSE 0 END, CASE WHEN action = 'created' THEN related ELSE 0 END
FROM (SELECT *, CASE WHEN dup_h IS NOT NULL OR dup_c IS NOT NULL THEN 'duplicate' WHEN has AND trust < top THEN 'conflict' WHEN has THEN 'superseded' WHEN greatest(best_h, best_c) >= 0.88 THEN 'possible_duplicate' ELSE 'created' END AS action
FROM (SELECT *, mine IS NOT NULL OR k IS NOT NULL AS has, CASE WHEN mine IS NOT NULL THEN list_filter(acc, lambda x: x.n = mine)[1].trust ELSE most END AS top,
 live_ht[1].seq AS dup_h, live_ct[1].seq AS dup_c, live_hv[1].seq AS near_h, coalesce(live_hv[1].cos, -1) AS best_h, live_cv[1].seq AS near_c, coalesce(live_cv[1].cos, -1) AS best_c, len(live_hv) + len(live_cv) AS related
FROM (SELECT a.*, f.acc, list_max(list_filter(a.ns, lambda x: list_contains(f.ids, x))) AS mine,
 list_filter(a.ht, lambda x: NOT list_has_any(x.same, f.ids)) AS live_ht, list_filter(a.ct, lambda x: list_contains(f.ids, x.seq) AND NOT list_has_any(x.same, f.ids)) AS live_ct,
 list_filter(a.hv, lambda x: x.cos >= 0.6 AND NOT list_has_any(x.same, f.ids)) AS live_hv, list_filter(a.cv, lambda x: x.cos >= 0.6 AND list_contains(f.ids, x.seq) AND NOT list_has_any(x.same, f.ids)) AS live_cv
FROM (SELECT scope_key, n, acc, list_transform(acc, lambda x: x.n) AS ids FROM f) f JOIN a ON a.scope_key = f.scope_key AND a.n = f.n + 1))))
SELECT f.c, f.action, f.match_held, m.c AS match_cand, f.retired, f.related FROM f LEFT JOIN c m ON m.scope_key = f.scope_key AND m.n = f.match_cand WHERE f.n > 0"""


SQL_GATE_FOLD = f"""SELECT c // 4294967296 AS batch_no, c % 4294967296 AS pos, action, coalesce(match_held, -1 - match_cand) AS match_seq, retired
FROM ({sql_gate_fold(sql_fold_rows("batch_no * 4294967296 + pos AS c", f"SELECT *, CAST(NULL AS TIMESTAMPTZ) AS expires_at, CAST(NULL AS DOUBLE[]) AS embedding FROM ({SQL_ITEMS})"), sql_fold_rows("seq", "SELECT * FROM memories WHERE coalesce(status, 'active') = 'active'"))})"""


@query(SQL_GATE_FOLD)
def gate_fold_exact(s: SparkSession, d: str) -> DataFrame:
    """The order-dependent fold of all batches into the store."""
    order = F.shiftleft("batch_no", 32) + F.col("pos")
    candidates = items(s, d).withColumn("seq", -1 - order).withColumn("arrival", order)
    held = read(s, d, "memories").withColumn("arrival", F.col("seq"))
    return integrate.fold(candidates, held, order="arrival").select(F.shiftright(-1 - F.col("seq"), 32).alias("batch_no"), (-1 - F.col("seq")).bitwiseAND((1 << 32) - 1).alias("pos"), "action", "match_seq", F.col("retired").cast("long").alias("retired"))


@query(f"""SELECT {', '.join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ("created", "superseded", "duplicate", "conflict", "possible_duplicate"))}, count(*) FILTER (action IN ('created', 'superseded')) AS imported, count(*) AS total FROM ({SQL_GATE_FOLD})""")
def fold_report(s: SparkSession, d: str) -> DataFrame:
    return integrate.import_report(gate_fold_exact(s, d))


@query(f"""SELECT c AS seq, action, match_cand AS match_seq, retired, related FROM ({sql_gate_fold(sql_fold_rows("seq AS c", "SELECT * FROM memories"), sql_fold_rows("seq", "SELECT * FROM memories WHERE false"))})""")
def gate_fold_store(s: SparkSession, d: str) -> DataFrame:
    """All records, in store order, folded into an empty store: with their vectors, so near-duplicates and related records come out, too."""
    return integrate.fold(read(s, d, "memories")).select("seq", "action", "match_seq", F.col("retired").cast("long").alias("retired"), F.col("related").cast("long").alias("related"))


@query(f"WITH i AS ({SQL_ITEMS}) SELECT batch_no, pos, row_number() OVER (PARTITION BY batch_no ORDER BY created_at, pos) AS place FROM i WHERE coalesce(status, 'active') = 'active'")
def replay_order(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("batch_no").orderBy(F.col("created_at").asc_nulls_last(), "pos")
    return items(s, d).where(F.coalesce("status", F.lit("active")) == "active").select("batch_no", "pos", F.row_number().over(w).cast("long").alias("place"))


# ---- ageing -----------------------------------------------------------------------------------


@query(f"SELECT seq, epoch_ms({SQL_EXPIRY}) AS expires_ms FROM memories")
def ttl_expiry(s: SparkSession, d: str) -> DataFrame:
    return age.with_expiry(read(s, d, "memories")).select("seq", ms("expires_at").alias("expires_ms"))


@query(f"SELECT seq, {sql_scope()} AS scope_key, epoch_ms(expires_at + INTERVAL 720 HOUR) AS removable_ms FROM memories WHERE status = 'active' AND expires_at <= {NOW}")
def ttl_expired_report(s: SparkSession, d: str) -> DataFrame:
    return age.expired_report(read(s, d, "memories"), as_of()).select("seq", "scope_key", ms("removable_at").alias("removable_ms"))


@query(f"""SELECT {sql_scope()} AS scope_key, count(*) AS hidden, count(*) FILTER (source IN ('user-explicit', 'user-confirmed')) AS human, epoch_ms(min(expires_at + INTERVAL 720 HOUR)) AS soonest_ms
FROM memories WHERE status = 'active' AND expires_at <= {NOW} GROUP BY 1""")
def hidden_by_scope(s: SparkSession, d: str) -> DataFrame:
    return age.hidden_by_scope(read(s, d, "memories"), as_of()).select("scope_key", "hidden", "human", ms("soonest").alias("soonest_ms"))


@query(f"SELECT {sql_scope()} AS scope_key, count(*) AS kept FROM memories WHERE expires_at IS NULL OR expires_at + INTERVAL 720 HOUR > {NOW} GROUP BY 1")
def compaction(s: SparkSession, d: str) -> DataFrame:
    return age.compacted(read(s, d, "memories"), as_of()).groupBy(N.scope_key().alias("scope_key")).agg(F.count("*").alias("kept"))


@query(f"SELECT count(*) AS removed FROM memories WHERE expires_at + INTERVAL 720 HOUR <= {NOW}")
def compaction_removed(s: SparkSession, d: str) -> DataFrame:
    return age.removable(read(s, d, "memories"), as_of()).agg(F.count("*").alias("removed"))


@query(f"SELECT {sql_scope()} AS scope_key, count(*) AS every, count(*) FILTER ({SQL_LIVE}) AS visible FROM memories GROUP BY 1")
def scope_visibility(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "memories").groupBy(N.scope_key().alias("scope_key")).agg(F.count("*").alias("every"), F.count_if(N.live(as_of())).alias("visible"))


@query("SELECT seq, epoch_ms(expires_at) - epoch_ms(created_at) AS life_ms FROM memories WHERE source IN ('user-explicit', 'user-confirmed') AND epoch_us(expires_at) - epoch_us(created_at) <= 604800000000")
def short_lifespan_notices(s: SparkSession, d: str) -> DataFrame:
    return age.short_lives(read(s, d, "memories")).select("seq", (ms("expires_at") - ms("created_at")).alias("life_ms"))


# ---- screening and deriving -------------------------------------------------------------------

_T = f"{sql_trim('coalesce(text, chr(32))')}"
_TOKENS = f"regexp_extract_all(t, '[A-Za-z0-9_+/=-]{{{screen.TOKEN_LEAST},}}')"
_MIXED = f"len(list_filter({_TOKENS}, lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]') AND list_aggregate(string_split(x, ''), 'entropy') >= {screen.ENTROPY_FLOOR})) > 0"
SQL_SECRET = f"""(regexp_matches(t, {q(screen.SECRET_SHAPES)}) OR regexp_matches(lower(t), {q("(?:^|[^a-z0-9_])" + screen.ASSIGNED)}) OR (regexp_matches(lower(t), {q(chr(92) + "b(?:" + screen.SECRET_WORDS + ")" + chr(92) + "b")}) AND {_MIXED}))"""
_WORDS = sql_words("lower(t)")
SQL_RULE = f"""CASE WHEN length(t) < {screen.LEAST} THEN 'too_short' WHEN length(t) > {screen.MOST} THEN 'too_long' WHEN {SQL_SECRET} THEN 'credential' WHEN lower(t) IN ({q_list(screen.PLEASANTRIES)}) THEN 'pleasantry'
WHEN len({_WORDS}) < 2 OR len(list_filter({_WORDS}, lambda w: w NOT IN ({q_list(screen.FILLER + screen.PLACEHOLDERS)}))) = 0 THEN 'no_statement'
WHEN regexp_matches(t, '{screen.QUESTION_MARKS}$') AND (regexp_matches(lower(t), {q(f"^(?:{screen.ASKING}|{screen.HELPING}){chr(92)}b")}) OR NOT regexp_matches(left(t, length(t) - 1), '{screen.SENTENCE_ENDS}')) THEN 'question'
WHEN type IS NULL AND (regexp_matches(lower(t), {q(f"{chr(92)}b(?:{screen.PASSING}){chr(92)}b")}) OR regexp_matches(t, '{screen.PASSING_FA}') OR regexp_matches(lower(t), {q(f"{chr(92)}b(?:{screen.WEATHER}){chr(92)}b")}) OR regexp_matches(lower(t), {q(screen.DEGREES + chr(92) + "b")})) THEN 'passing' END"""


@query(f"SELECT seq, rule, coalesce(rule IN ({q_list(screen.REDACTED)}), false) AS redact, length(t) AS n FROM (SELECT *, {SQL_RULE} AS rule FROM (SELECT *, {_T} AS t FROM memories))")
def prefilter_verdicts(s: SparkSession, d: str) -> DataFrame:
    return read_dealt(s, d, "memories").select("seq", screen.verdict().alias("v")).select("seq", "v.rule", "v.redact", F.col("v.n").cast("long").alias("n"))


@query(f"SELECT decision, rule, count(*) AS n FROM (SELECT decision, {SQL_RULE} AS rule FROM (SELECT *, {_T} AS t FROM gate_log)) GROUP BY ALL")
def reject_reason_hist(s: SparkSession, d: str) -> DataFrame:
    return read_dealt(s, d, "gate_log").select("decision", screen.verdict()["rule"].alias("rule")).groupBy("decision", "rule").agg(F.count("*").alias("n"))


@query(f"SELECT line_no, CASE WHEN rule IN ({q_list(screen.REDACTED)}) THEN '[redacted: ' || length(text) || ' characters]' WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS logged FROM (SELECT *, {SQL_RULE} AS rule FROM (SELECT *, {_T} AS t FROM gate_log))")
def logged_texts(s: SparkSession, d: str) -> DataFrame:
    logged = lambda v: F.when(v, screen.logged_text(F.col("text"), v)).otherwise(X.cut(F.col("text"), 100))
    return read_dealt(s, d, "gate_log").select("line_no", X.let(screen.verdict()["redact"], logged).alias("logged"))


@query(f"SELECT subject, {sql_subject()} AS subject_key, count(*) AS n FROM memories GROUP BY 1, 2")
def subject_normalize(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "memories").groupBy("subject", N.subject_key().alias("subject_key")).agg(F.count("*").alias("n"))


_HITS = [f"regexp_matches(low, {q(p)})" for p in derive.SUBJECTS.values()]
_PHRASE = f"list_filter(string_split_regex(regexp_extract(low, {q(derive.OWNED)}, 1), '\\s+'), lambda w: w <> '' AND w NOT IN ({q_list(derive.NOT_KEY)}))"


@query(f"""SELECT seq, CASE WHEN length(low) > {derive.MOST_CHARS} THEN NULL WHEN {' + '.join(f'CAST({h} AS INT)' for h in _HITS)} = 1 THEN CASE {' '.join(f"WHEN {h} THEN {q(k)}" for k, h in zip(derive.SUBJECTS, _HITS, strict=True))} END
WHEN NOT ({' OR '.join(_HITS)}) AND (len({_PHRASE}) >= 2 OR (len({_PHRASE}) = 1 AND length({_PHRASE}[1]) >= 3)) THEN array_to_string({_PHRASE}, '-') END AS derived FROM (SELECT seq, lower(text) AS low FROM memories)""")
def derive_subject(s: SparkSession, d: str) -> DataFrame:
    return read_dealt(s, d, "memories").select("seq", derive.subject_of(F.col("text")).alias("derived"))


@query(f"SELECT seq, CASE WHEN regexp_matches(lower(text), {q(f'{chr(92)}b(?:{derive.IDENTITY}){chr(92)}b')}) THEN 'identity' WHEN regexp_matches(lower(text), {q(f'{chr(92)}b(?:{derive.PREFERENCE}){chr(92)}b')}) THEN 'preference' END AS inferred FROM memories")
def infer_type(s: SparkSession, d: str) -> DataFrame:
    return read_dealt(s, d, "memories").select("seq", derive.type_of(F.col("text")).alias("inferred"))


@query("SELECT seq, coalesce(len(regexp_extract_all(text, '\\p{L}')) = 0 OR len(regexp_extract_all(text, '\\p{Latin}')) >= 0.8 * len(regexp_extract_all(text, '\\p{L}')), true) AS suits FROM memories")
def model_language(s: SparkSession, d: str) -> DataFrame:
    return read_dealt(s, d, "memories").select("seq", derive.suits_model(F.col("text")).alias("suits"))


@query(f"SELECT count(*) FILTER (good) AS usable, count(*) FILTER (NOT good) AS quarantined FROM (SELECT (type IS NULL OR type IN ({q_list(N.TYPES)})) AND (source IS NULL OR source IN ({q_list(N.SOURCES)})) AS good FROM memories)")
def enum_quarantine(s: SparkSession, d: str) -> DataFrame:
    good, bad = N.quarantine(read(s, d, "memories"))
    one = good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g")))
    return one.agg(F.count_if(F.col("g") == 1).alias("usable"), F.count_if(F.col("g") == 0).alias("quarantined"))


# ---- words and ranking ------------------------------------------------------------------------


@query(f"SELECT seq, len({sql_words('lower(text)')}) AS n_words, len(list_distinct({sql_words('lower(text)')})) AS n_distinct FROM memories WHERE text IS NOT NULL")
def token_stats(s: SparkSession, d: str) -> DataFrame:
    w = X.words(F.lower("text"))
    return read_dealt(s, d, "memories").where("text is not null").select("seq", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(f"SELECT stem, count(*) AS n, count(DISTINCT seq) AS records FROM (SELECT seq, unnest({sql_stems('folded')}) AS stem FROM (SELECT seq, {sql_fold('text')} AS folded FROM memories WHERE text IS NOT NULL)) GROUP BY 1")
def stem_terms(s: SparkSession, d: str) -> DataFrame:
    folded = read_dealt(s, d, "memories").where("text is not null").select("seq", X.fold(F.col("text")).alias("folded"))
    each = folded.select("seq", F.explode(X.content_stems(F.col("folded"))).alias("stem"))
    per = each.groupBy("stem", "seq").agg(F.count("*").alias("c"))
    return per.groupBy("stem").agg(F.sum("c").alias("n"), F.count("*").alias("records"))


@query(f"""WITH t AS (SELECT seq, array_to_string({sql_stems(sql_fold("coalesce(text, '')"))}, ' ') AS a, array_to_string({sql_stems(sql_fold("regexp_replace(coalesce(subject, ''), '[-_.]+', ' ', 'g')"))}, ' ') AS b FROM memories)
SELECT seq, round(CASE WHEN a = b THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE 2.0 * len(list_intersect({sql_grams('a')}, {sql_grams('b')})) / (len({sql_grams('a')}) + len({sql_grams('b')})) END, 6) AS similarity FROM t""")
def trigram_similarity(s: SparkSession, d: str) -> DataFrame:
    """How far the stems of each record's subject are those of its text."""
    stems = lambda c: F.array_join(X.content_stems(X.fold(c)), " ")
    subject = F.regexp_replace(F.coalesce("subject", F.lit("")), "[-_.]+", " ")
    both = read_dealt(s, d, "memories").select("seq", stems(F.coalesce("text", F.lit(""))).alias("a"), stems(subject).alias("b"))
    return both.select("seq", F.round(X.trigram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def _queries(s: SparkSession, d: str) -> DataFrame:
    """Every 50th record asks for its subject in its scope, with its vector."""
    m = read_dealt(s, d, "memories").where("seq % 50 = 0")
    return m.select(F.col("seq").alias("query_id"), F.regexp_replace(F.coalesce("subject", F.lit("")), "[-_.]+", " ").alias("query"), "scope", F.col("embedding").alias("vector"))


def _sql_recall(vectors: bool) -> str:
    lexical = f"least(1.0, 0.75 * token + 0.25 * whole + CASE WHEN list_contains(qs, CASE type WHEN 'identity' THEN {sql_stem(q('identity'))} WHEN 'project' THEN {sql_stem(q('project'))} WHEN 'preference' THEN {sql_stem(q('preference'))} WHEN 'state' THEN {sql_stem(q('state'))} END) THEN 0.15 ELSE 0 END)"
    cosine = "CASE WHEN len(v) = len(e) AND len(v) > 0 AND list_dot_product(v, v) > 0 AND list_dot_product(e, e) > 0 THEN list_cosine_similarity(v, e) ELSE 0 END" if vectors else "0"
    score = "CASE WHEN v IS NULL OR list_dot_product(v, v) = 0 THEN lexical ELSE 0.7 * lexical + 0.3 * greatest(0, least(1, semantic)) END" if vectors else "lexical"
    return f"""WITH s0 AS (SELECT seq, type, {sql_scope()} AS scope_key, embedding AS e, text, subject, {sql_stems(sql_fold("concat(coalesce(text, ''), ' ', regexp_replace(coalesce(subject, ''), '[-_]+', ' ', 'g'))"))} AS ts FROM memories WHERE {SQL_LIVE}),
s AS (SELECT *, {sql_grams("array_to_string(ts, ' ')")} AS tg FROM s0),
a0 AS (SELECT seq AS query_id, {sql_scope()} AS scope_key, embedding AS v, {sql_stems(sql_fold("regexp_replace(coalesce(subject, ''), '[-_.]+', ' ', 'g')"))} AS qs, {sql_trim("regexp_replace(coalesce(subject, ''), '[-_.]+', ' ', 'g')")} AS q FROM memories WHERE seq % 50 = 0),
a AS (SELECT *, {sql_grams("array_to_string(qs, ' ')")} AS qg FROM a0),
w AS (SELECT DISTINCT scope_key, unnest(ts) AS t FROM s), u AS (SELECT DISTINCT query_id, scope_key, unnest(qs) AS x FROM a),
p AS (SELECT query_id, x, t, CASE WHEN x = t THEN 1.0 ELSE 2.0 * len(list_intersect({sql_grams('x')}, {sql_grams('t')})) / (len({sql_grams('x')}) + len({sql_grams('t')})) END AS dice FROM u JOIN w USING (scope_key)),
b AS (SELECT y.query_id, y.seq, y.x, y.i, max(CASE WHEN dice >= 0.4 THEN dice ELSE 0 END) AS best FROM
  (SELECT query_id, seq, x, i, unnest(ts) AS t FROM (SELECT a.query_id, s.seq, s.ts, unnest(a.qs) AS x, generate_subscripts(a.qs, 1) AS i FROM a JOIN s USING (scope_key))) y JOIN p ON p.query_id = y.query_id AND p.x = y.x AND p.t = y.t GROUP BY ALL),
k AS (SELECT query_id, seq, sum(length(x) * best) / sum(length(x)) AS token FROM b GROUP BY ALL),
l AS (SELECT a.query_id, s.seq, s.type, a.qs, a.v, s.e, a.q, coalesce(k.token, 0) AS token, CASE WHEN len(ts) = 0 OR len(qs) = 0 THEN 0 WHEN ts = qs THEN 1.0 ELSE 2.0 * len(list_intersect(tg, qg)) / (len(tg) + len(qg)) END AS whole FROM a JOIN s USING (scope_key) LEFT JOIN k ON k.query_id = a.query_id AND k.seq = s.seq),
c AS (SELECT query_id, seq, v, q, CASE WHEN len(qs) = 0 THEN 0 ELSE {lexical} END AS lexical, {cosine} AS semantic FROM l),
r AS (SELECT query_id, seq, CASE WHEN q = '' THEN CAST(seq AS DOUBLE) ELSE round({score} + 1e-9, 6) END AS score, CASE WHEN q = '' THEN 0 ELSE lexical END AS lexical, CASE WHEN q = '' THEN 0 ELSE semantic END AS semantic FROM c WHERE q = '' OR lexical + 1e-9 >= 0.1 OR semantic + 1e-9 >= 0.35)
SELECT query_id, rank, seq, score, round(lexical + 1e-9, 6) AS lexical, round(semantic + 1e-9, 6) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM r) WHERE rank <= 5"""


@query(_sql_recall(False))
def lexical_recall_topk(s: SparkSession, d: str) -> DataFrame:
    out = rank.recall(read_dealt(s, d, "memories"), _queries(s, d).drop("vector"), 5, as_of())
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(_sql_recall(True))
def blended_recall(s: SparkSession, d: str) -> DataFrame:
    return rank.recall(read_dealt(s, d, "memories"), _queries(s, d), 5, as_of()).withColumn("rank", F.col("rank").cast("long"))


_SIMILAR = f"""WITH v AS (SELECT seq, {sql_scope()} AS scope_key, embedding AS e, {SQL_LIVE} AS live FROM memories WHERE len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.seq, b.seq AS other_seq, round(CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END, 6) AS similarity FROM v a JOIN v b ON a.scope_key = b.scope_key AND a.seq <> b.seq AND b.live WHERE a.seq % 50 = 0"""


@query(f"SELECT seq, other_seq, similarity, similarity >= 0.88 AS duplicate FROM ({_SIMILAR}) WHERE similarity >= 0.6")
def near_duplicate_records(s: SparkSession, d: str) -> DataFrame:
    """A search, as findSimilar of single candidates: every 50th record asks. near_duplicate_classes has all records."""
    m = read(s, d, "memories")
    return rank.similar(m, m.where("seq % 50 = 0"), N.RELATED_AT, as_of()).withColumn("duplicate", F.col("similarity") >= N.DUPLICATE_AT)


@query()
def near_duplicate_classes(s: SparkSession, d: str) -> DataFrame:
    """Every record, with its class and how many live records are related to it, and near-duplicates of it."""
    return rank.near_duplicates(read(s, d, "memories"), as_of())


@query(f"SELECT * FROM (SELECT seq, other_seq, similarity, row_number() OVER (PARTITION BY seq ORDER BY similarity DESC, other_seq) AS rank FROM ({_SIMILAR}) WHERE similarity >= 0.35) WHERE rank <= 5")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = read(s, d, "memories")
    w = Window.partitionBy("seq").orderBy(F.desc("similarity"), "other_seq")
    return rank.similar(m, m.where("seq % 50 = 0"), N.SEMANTIC_AT, as_of()).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


@query(f"SELECT * FROM (SELECT {sql_scope()} AS scope_key, seq, row_number() OVER (PARTITION BY {sql_scope()} ORDER BY seq DESC) AS rank FROM memories WHERE {SQL_LIVE}) WHERE rank <= 5")
def recent_records(s: SparkSession, d: str) -> DataFrame:
    return rank.recent(read(s, d, "memories"), 5, as_of()).select("scope_key", "seq", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH a AS (SELECT batch_no * 4294967296 + pos AS ask_id, {sql_scope()} AS scope_key, lower(left(id, CASE WHEN pos % 3 = 0 THEN 36 WHEN pos % 3 = 1 THEN 8 ELSE 7 END)) AS raw FROM ({SQL_ITEMS})),
n AS (SELECT ask_id, scope_key, regexp_replace(regexp_replace(raw, '^[^0-9a-f]+', ''), '[^0-9a-f]+$', '') AS needle FROM a),
h AS (SELECT ask_id, min(CASE WHEN lower(m.id) = needle THEN seq END) AS exact, count(m.seq) AS n, min(m.seq) AS first FROM n LEFT JOIN memories m ON {sql_scope('m.scope')} = n.scope_key AND (lower(m.id) = needle OR (length(needle) >= 8 AND starts_with(lower(m.id), needle))) GROUP BY ask_id)
SELECT ask_id, CASE WHEN exact IS NOT NULL OR n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'not-found' END AS result, CASE WHEN exact IS NOT NULL OR n = 1 THEN coalesce(exact, first) END AS seq, n AS matches FROM h""")
def id_prefix_resolve(s: SparkSession, d: str) -> DataFrame:
    length = F.when(F.col("pos") % 3 == 0, 36).when(F.col("pos") % 3 == 1, 8).otherwise(7)
    asked = items(s, d).select((F.col("batch_no") * F.lit(4294967296) + F.col("pos")).alias("ask_id"), F.substring(F.col("id"), F.lit(1), length).alias("id"), "scope")
    return forget.resolve(read(s, d, "memories"), asked)


# ---- import, export, log ----------------------------------------------------------------------


@query(f"""SELECT batch_no, pos, coalesce(CASE WHEN source IN ({q_list(N.SOURCES)}) THEN source END, 'agent-inferred') AS source, CASE WHEN status IN ('active', 'superseded') THEN status ELSE 'active' END AS status,
CASE WHEN type IN ({q_list(N.TYPES)}) THEN type END AS type, CASE WHEN {sql_trim('subject')} <> '' THEN subject END AS subject, coalesce(epoch_ms(created_at), epoch_ms({NOW})) AS created_ms, {sql_trim('text')} AS text FROM ({SQL_ITEMS}) WHERE coalesce({sql_trim('text')}, '') <> ''""")
def import_normalize(s: SparkSession, d: str) -> DataFrame:
    """The items of all batches as JSON, read back by the rules of import; items without a text would fail it and are left out first."""
    docs = _as_documents(s, d, bare=False)
    raw = store.unwrapped(docs).where(F.coalesce(X.trim("m.text"), F.lit("")) != "")
    m = raw.select(F.col("path").cast("long").alias("batch_no"), "pos", "m")
    return _normalised_items(m)


def _normalised_items(m: DataFrame) -> DataFrame:
    """store.normalised per batch: the batch is carried through the record's place."""
    packed = m.select((F.col("batch_no") * F.lit(4294967296) + F.col("pos")).alias("pos"), "m")
    n = store.normalised(packed, as_of())
    return n.select(F.shiftright("seq", 32).alias("batch_no"), F.col("seq").bitwiseAND(4294967295).alias("pos"), "source", "status", "type", "subject", ms("created_at").alias("created_ms"), "text")


def _as_documents(s: SparkSession, d: str, bare: bool) -> DataFrame:
    """(path, doc): each batch as a JSON document, its number for a path."""
    iso = lambda c: store.iso(c, 6)
    record = lambda m: F.struct(m["id"].alias("id"), m["text"].alias("text"), m["type"].alias("type"), m["subject"].alias("subject"), m["scope"].alias("scope"), m["source"].alias("source"), m["status"].alias("status"), iso(m["created_at"]).alias("createdAt"), iso(m["updated_at"]).alias("updatedAt"), m["client"].alias("client"))
    records = F.transform("memories", record)
    doc = F.to_json(records) if bare else F.to_json(F.struct(F.col("schema_version").alias("schemaVersion"), records.alias("memories")))
    return read(s, d, "export_envelopes").select(F.col("batch_no").cast("string").alias("path"), doc.alias("doc"))


@query(f"""SELECT batch_no, pos, CASE WHEN coalesce({sql_trim('scope')}, '') = '' THEN 'default' ELSE scope END AS scope, coalesce(status, 'active') AS status,
epoch_ms(CASE type WHEN 'project' THEN created_at + INTERVAL 2160 HOUR WHEN 'state' THEN created_at + INTERVAL 48 HOUR END) AS expires_ms FROM ({SQL_ITEMS})""")
def migrate_v1(s: SparkSession, d: str) -> DataFrame:
    """All batches written as bare lists, the first version of the store, and migrated."""
    raw = store.unwrapped(_as_documents(s, d, bare=True)).withColumn("pos", F.col("path").cast("long") * F.lit(4294967296) + F.col("pos"))
    return store.migrated(raw).select(F.shiftright("seq", 32).alias("batch_no"), F.col("seq").bitwiseAND(4294967295).alias("pos"), "scope", "status", ms("expires_at").alias("expires_ms"))


@query("SELECT status, count(*) AS n FROM memories GROUP BY 1")
def export_counts(s: SparkSession, d: str) -> DataFrame:
    records = store.envelope(read(s, d, "memories"), AS_OF, "recordloom")
    return records.select(F.get_json_object("record", "$.status").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT decision, source, scope, count(*) AS n, count(text) AS texts, CAST(grouping_id(decision, source, scope) AS BIGINT) AS level FROM (SELECT decision, coalesce(source, '(none)') AS source, {sql_scope()} AS scope, text FROM gate_log) GROUP BY ROLLUP (decision, source, scope)""")
def decision_log_rollup(s: SparkSession, d: str) -> DataFrame:
    return gatelog.rollup(read(s, d, "gate_log"))


@query("SELECT epoch_ms(date_trunc('day', ts AT TIME ZONE 'UTC')) AS start_ms, count(*) AS n, count(*) FILTER (decision = 'rejected') AS rejected FROM gate_log GROUP BY 1")
def decision_log_days(s: SparkSession, d: str) -> DataFrame:
    return gatelog.by_window(read(s, d, "gate_log")).select(ms("start").alias("start_ms"), "n", "rejected")


@query("""SELECT decision, count(*) AS n, count(nullif(nullif(scope, ''), 'default')) AS scopes, count(nullif(subject, '')) AS subjects, sum(least(length(text), 501)) AS chars FROM gate_log GROUP BY 1""")
def decision_log_lines(s: SparkSession, d: str) -> DataFrame:
    return gatelog.lines(read(s, d, "gate_log")).groupBy("decision").agg(F.count("*").alias("n"), F.count("scope").alias("scopes"), F.count("subject").alias("subjects"), F.sum(F.length("text")).alias("chars"))


_LEAD, _TRAIL = q(f"(?i){foreign.LEADING}"), q(f"(?i){foreign.TRAILING}")


def sql_line_ms(c: str) -> str:
    """Epoch milliseconds of the date of a line, by DuckDB's own calendar; null for impossible ones."""
    part = lambda i: f"coalesce(try_cast(regexp_extract({c}, {q(foreign.ISO_TIME)}, {i}) AS BIGINT), 0)"
    millis = f"coalesce(try_cast(left(rpad(regexp_extract({c}, {q(foreign.ISO_TIME)}, 4), 3, '0'), 3) AS BIGINT), 0)"
    day = lambda d: f"epoch_ms(CAST({d} AS TIMESTAMP))"
    named = f"try_strptime(left({c}, 3) || ' ' || regexp_extract({c}, '(\\d{{1,2}})[^\\d]+\\d{{4}}$', 1) || ' ' || right({c}, 4), '%b %-d %Y')"
    return f"""CASE WHEN regexp_full_match({c}, {q(f"{foreign.ISO_DAY}(?:{foreign.ISO_TIME})?")}) THEN CASE WHEN {part(1)} < 24 AND {part(2)} < 60 AND {part(3)} < 60 THEN {day(f"try_cast(left({c}, 10) AS DATE)")} + {part(1)} * 3600000 + {part(2)} * 60000 + {part(3)} * 1000 + {millis} END
WHEN regexp_matches({c}, '^\\d{{1,2}}/') THEN {day(f"try_strptime({c}, '%-m/%-d/%Y')")} WHEN regexp_full_match({c}, {q("(?i)" + foreign.NAMED_DAY)}) THEN {day(named)} END"""


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS line, raw, sum(CAST(regexp_matches(raw, {q(foreign.FENCE)}) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS inside FROM
  (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM documents)),
b AS (SELECT doc_id, line, {sql_trim(f"regexp_replace(raw, {q(foreign.BULLET)}, '')")} AS body FROM l WHERE inside = 0 AND NOT regexp_matches(raw, {q(foreign.FENCE)}) AND {sql_trim('raw')} <> '' AND NOT regexp_matches(raw, {q(foreign.HEADING)}) AND NOT regexp_matches(raw, {q(foreign.RULE)}) AND NOT regexp_matches(raw, {q(foreign.LABEL)})),
c AS (SELECT doc_id, line, nullif(regexp_extract(body, {_LEAD}, 1), '') AS lead, CASE WHEN regexp_matches(body, {_LEAD}) THEN {sql_trim(f"regexp_replace(body, {_LEAD}, '')")} ELSE body END AS body FROM b),
d AS (SELECT *, {sql_line_ms('lead')} AS lead_ms FROM c),
t AS (SELECT *, CASE WHEN lead_ms IS NULL THEN nullif(regexp_extract(body, {_TRAIL}, 1), '') END AS trail FROM d),
e AS (SELECT doc_id, line, CASE WHEN lead_ms IS NOT NULL THEN lead END AS lead, lead_ms, trail, {sql_line_ms('trail')} AS trail_ms, {sql_trim(f"regexp_replace(CASE WHEN trail IS NOT NULL THEN {sql_trim(f'regexp_replace(body, {_TRAIL}, {q('')})')} ELSE body END, {q(foreign.QUOTE)}, '', 'g')")} AS entry FROM t)
SELECT doc_id, CAST(line AS BIGINT) AS line, entry, coalesce(lead, CASE WHEN trail_ms IS NOT NULL THEN trail END) AS dated, coalesce(lead_ms, trail_ms) AS ms FROM e WHERE length(entry) >= 4""")
def vendor_text_parse(s: SparkSession, d: str) -> DataFrame:
    """The statements of lists: a leading date goes; a trailing one is looked for whenever the leading one is no real date."""
    return foreign.text_entries(read_dealt(s, d, "documents")).withColumn("line", F.col("line").cast("long"))


@query(f"SELECT CASE WHEN regexp_matches(lower(file_name), {q(foreign.HINT)}) THEN 'memory' ELSE 'other' END AS kind, count(*) AS n FROM raw_entries GROUP BY 1")
def vendor_file_kinds(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "raw_entries").groupBy(foreign.file_kind(F.col("file_name")).alias("kind")).agg(F.count("*").alias("n"))


# ---- streams ----------------------------------------------------------------------------------


@query(f"""WITH a AS ({SQL_ACTED}) SELECT seq, action FROM a""")
def stream_gate(s: SparkSession, d: str) -> DataFrame:
    """The records as a stream, each judged by the state of its scope and subject."""
    return gate.drained(gate.supersession_stream(gate.file_stream(s, read(s, d, "memories"))))


@query("SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Events counted in daily windows by a stream with a watermark."""
    events = gate.file_stream(s, read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return gate.drained(gate.windows_stream(events, "ts", "event_type"), mode="complete").select(ms("start").alias("start_ms"), "event_type", "n")


# ---- timestamps -------------------------------------------------------------------------------


@query()
def p5_found(s: SparkSession, d: str) -> DataFrame:
    return timestamps.found(read_dealt(s, d, "raw_entries"))


@query()
def p5_normalised(s: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised(read_dealt(s, d, "raw_entries"))
