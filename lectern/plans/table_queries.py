"""Mappings, histories, samples and events over the tables that stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import history as H
from lectern.operators import mapping as M
from lectern.operators import samples as A
from lectern.operators import words as W
from lectern.sources.tables import table
from lectern.streaming import requests as R
from lectern.streaming import status as ST

QUERIES, ORACLE_SQL = {}, {}
def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


KEYS = ["doc_id"]
SPANS_SQL = """t AS (SELECT doc_id, unnest(range(0, len(string_split(text, ' ')))) AS k, unnest(string_split(text, ' ')) AS w FROM documents),
    u AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - length(w) - 1 AS s FROM t),
    words AS (SELECT doc_id, k AS idx, w AS word, s, s + length(w) AS e FROM u WHERE w <> ''),
    positions AS (SELECT doc_id, unnest(range(0, length(text) + 1, 7)) AS t FROM documents)"""


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return W.space_word_spans(table(spark, sf, "documents"), KEYS)


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(7).cast("long"))).alias("t"))


@query(
    f"""WITH {SPANS_SQL}, r AS (SELECT doc_id, t * 2 AS a, t * 2 + 10 AS b FROM positions),
    ra AS (SELECT *, unnest(range(a // 50, (b - 1) // 50 + 1)) AS c FROM r), wa AS (SELECT *, unnest(range(2 * s // 50, (2 * e - 1) // 50 + 1)) AS c FROM words)
    SELECT r.doc_id, a AS norm_start, b AS norm_end, coalesce(min(s), a) AS orig_start, coalesce(max(e), b) AS orig_end
    FROM ra r LEFT JOIN wa w ON r.doc_id = w.doc_id AND r.c = w.c AND 2 * e > a AND 2 * s < b GROUP BY r.doc_id, a, b"""
)
def map_via_spans(spark: SparkSession, sf: str) -> DataFrame:
    words = W.space_word_spans(table(spark, sf, "documents"), KEYS, only=("start", "end_pos"))
    spans = words.select(*KEYS, (F.col("start") * 2).alias("norm_start"), (F.col("end_pos") * 2).alias("norm_end"), F.col("start").alias("orig_start"), F.col("end_pos").alias("orig_end"))
    ranges = _positions(spark, sf).select(*KEYS, (F.col("t") * 2).alias("norm_start"), (F.col("t") * 2 + 10).alias("norm_end"))
    return M.map_via_spans(ranges, spans, KEYS)


@query(
    f"""WITH {SPANS_SQL} SELECT p.doc_id, p.t, coalesce(idx, -1) AS active
    FROM positions p ASOF LEFT JOIN words w ON p.doc_id = w.doc_id AND p.t < w.e"""
)
def active_word_asof(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf).select(*KEYS, F.col("idx").cast("long").alias("idx"), F.col("end_pos").alias("end"))
    found = M.active_words(_positions(spark, sf), words, KEYS)
    return found.withColumn("active", F.col("active").cast("long"))


@query(
    f"""WITH {SPANS_SQL}, spans AS (SELECT doc_id, t // 7 AS span, t AS ss, t + 16 AS se, unnest(range(t // 50, (t + 15) // 50 + 1)) AS c FROM positions)
    SELECT w.doc_id, w.s, w.e, min_by(span, ((ss <> s OR se <> e)::INT, se - ss, span)) AS span
    FROM words w LEFT JOIN spans p ON w.doc_id = p.doc_id AND p.c = w.s // 50 AND ss <= s AND se >= e GROUP BY ALL"""
)
def containment(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf).select(*KEYS, F.col("start").alias("s"), F.col("end_pos").alias("e"))
    spans = _positions(spark, sf).select(*KEYS, F.floor(F.col("t") / 7).alias("span"), F.col("t").alias("start"), (F.col("t") + 16).alias("end"))
    return M.tightest_span(words, spans, KEYS)


@query(
    """WITH e AS (SELECT o_custkey, o_orderkey AS s, o_orderkey + 3 AS z, length(o_orderpriority) AS n, o_orderkey + coalesce(sum(length(o_orderpriority) - 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM orders WHERE o_orderkey % 4 = 0),
    p AS (SELECT o_custkey, o_orderkey + 2 AS at FROM orders)
    SELECT p.o_custkey, p.at, CASE WHEN p.at < a + n THEN s ELSE coalesce(z + p.at - a - n, p.at) END AS source, coalesce(p.at < a + n, false) AS inside FROM p ASOF LEFT JOIN e ON p.o_custkey = e.o_custkey AND p.at >= e.a"""
)
def source_positions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    edits = orders.where("o_orderkey % 4 = 0").select("o_custkey", F.col("o_orderkey").alias("orig_start"), (F.col("o_orderkey") + 3).alias("orig_end"), F.length("o_orderpriority").alias("new_len"))
    return M.source_positions(orders.select("o_custkey", (F.col("o_orderkey") + 2).alias("at")), edits, ["o_custkey"])


@query(
    """SELECT p_partkey, CAST(least(p_size % 7, 4) AS INTEGER) AS lo, list_min(x) AS orig_start, list_max(list_transform(x, lambda v: v + 3)) AS orig_end
    FROM (SELECT p_partkey, p_size, list_transform(range(least(p_size % 7, 4), greatest(least(p_size % 7, 4) + 1, least(p_size % 7 + 2, 5))), lambda i: CAST((i * p_size) % 11 AS INTEGER)) AS x FROM part)"""
)
def bounding_range(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("p_size") % 7).cast("int")
    char_map = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(((i * F.col("p_size")) % 11).cast("int").alias("s"), ((i * F.col("p_size")) % 11 + 3).cast("int").alias("e")))
    found = table(spark, sf, "part").select("p_partkey", F.least(start, F.lit(4)).alias("lo"), M.bounding_range(char_map, start, start + 2).alias("r"))
    return found.select("p_partkey", "lo", F.col("r.start").alias("orig_start"), F.col("r.end").alias("orig_end"))


@query(
    """WITH m AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
    SELECT r.user_id, r.ts AS at, m.value AS newest FROM r ASOF LEFT JOIN m ON r.user_id = m.user_id AND r.ts > m.ts"""
)
def directive_asof(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    rows = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("at"))
    return M.newest_before(rows, events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value"), ["user_id"])


@query(
    """SELECT o_custkey, o_orderkey, o_orderkey + coalesce(sum(length(o_orderpriority) - 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM orders"""
)
def edit_offsets(spark: SparkSession, sf: str) -> DataFrame:
    edits = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("orig_start"), (F.col("o_orderkey") + 3).alias("orig_end"), F.length("o_orderpriority").alias("new_len"))
    return M.edit_offsets(edits, ["o_custkey"]).select("o_custkey", F.col("orig_start").alias("o_orderkey"), "new_start")


ENTRIES_SQL = """entries AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes,
    CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'ready' ELSE 'pending' END AS status, o_orderpriority AS original_text FROM orders)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "ready").otherwise("pending")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"), status.alias("status"), F.col("o_orderpriority").alias("original_text"))


EVICT = 100_000_000_000

def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files of the store (name, modified, length), each as old in seconds as 100 less its size, and the names that are in use."""
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.timestamp_seconds(F.unix_timestamp(_now()) - F.lit(100) + F.col("p_size")).alias("modified"), F.col("p_size").cast("long").alias("length"))
    return files, table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("name"))


def _now() -> Column:
    return F.lit("2024-01-01 00:01:40").cast("timestamp")


@query(
    f"""WITH {ENTRIES_SQL}, t AS (SELECT sum(bytes) AS total FROM entries),
    f AS (SELECT id, bytes, total - coalesce(sum(bytes) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM entries, t WHERE status <> 'processing')
    SELECT id, bytes FROM f WHERE left_over > {EVICT}"""
)
def evict_to_size(spark: SparkSession, sf: str) -> DataFrame:
    return H.evict_to_size(_entries(spark, sf), EVICT).select("id", "bytes")


@query(f"WITH {ENTRIES_SQL} SELECT status, count(*) AS entries, sum(bytes)::BIGINT AS bytes FROM entries WHERE status <> 'processing' GROUP BY status")
def evict_all(spark: SparkSession, sf: str) -> DataFrame:
    return H.evict_all(_entries(spark, sf), True).groupBy("status").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))


@query("SELECT sum(l)::BIGINT AS total_bytes, count(*) FILTER (path LIKE '%.opus') AS audio_files FROM (SELECT CAST(p_size AS BIGINT) AS l, p_name || CASE WHEN p_size > 25 THEN '.opus' ELSE '.json' END AS path FROM part)")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("length"), F.concat("p_name", F.when(F.col("p_size") > 25, ".opus").otherwise(".json")).alias("path"))
    return H.cache_stats(files)


@query("SELECT p_partkey AS name FROM part WHERE p_size <= 40 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphan_anti(spark: SparkSession, sf: str) -> DataFrame:
    return H.orphans(*_store(spark, sf), _now()).select("name")


@query(
    """WITH f AS (SELECT p_partkey AS path, CAST(p_size AS BIGINT) AS length FROM part), p AS (SELECT o_orderkey AS id, unnest([o_custkey, o_orderkey]) AS path FROM orders)
    SELECT id, coalesce(sum(length), 0)::BIGINT AS bytes FROM p LEFT JOIN f USING (path) GROUP BY id"""
)
def entry_bytes(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("audio_path"), F.col("o_orderkey").alias("timestamps_path"))
    return H.bytes_of_entries(entries, table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("length")))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    parts = [orders.where(c).drop("o_orderstatus") for c in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    return H.upsert(*parts, "o_custkey", "o_orderkey")


@query("SELECT c_custkey AS id, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def config_patch(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return H.patched(base, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), "id")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'F' AND p_partkey IS NULL) THEN 'pending' WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'error' END AS status,
    p_partkey AS audio_path, CASE WHEN p_partkey IS NOT NULL THEN o_totalprice END AS duration_sec FROM orders LEFT JOIN part ON p_partkey = o_custkey"""
)
def status_repair(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "playing").otherwise("error")
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_custkey").alias("audio_path"), F.col("o_totalprice").alias("duration_sec"))
    return H.repair_status(entries, table(spark, sf, "part").select(F.col("p_partkey").alias("path")))


@query(f"WITH {ENTRIES_SQL} SELECT row_number() OVER (ORDER BY created_at DESC, id) AS place, id, created_at FROM entries")
def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """With the place of each row, so that the order itself is compared."""
    ordered = H.newest_first(_entries(spark, sf).select("id", "created_at"))
    return H.with_places(ordered).select("place", "id", "created_at")


@query(f"WITH {ENTRIES_SQL} SELECT id, status FROM entries WHERE id % 3 <> 0")
def delete_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf)
    kept, _ = H.delete_entries(entries, entries.where("id % 3 = 0").select("id"))
    return kept.select("id", "status")


@query(
    """SELECT o_orderkey AS id, o_custkey AS audio_path FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM part WHERE p_partkey = o_custkey)"""
)
def playable(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"), F.col("o_custkey").alias("audio_path"))
    return H.playable(entries, table(spark, sf, "part").select(F.col("p_partkey").alias("path"))).select("id", "audio_path")


@query(
    f"""WITH {ENTRIES_SQL}, files AS (SELECT p_partkey AS name, p_size AS age, CAST(p_size AS BIGINT) AS length FROM part), used AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_quantity > 45),
    o AS (SELECT count(*) AS n, coalesce(sum(length), 0)::BIGINT AS b FROM files WHERE age <= 40 AND name NOT IN (SELECT name FROM used)),
    e AS (SELECT count(*) AS n, coalesce(sum(bytes), 0)::BIGINT AS b FROM entries WHERE status <> 'processing')
    SELECT o.n AS removed_files, o.b AS removed_bytes, e.n AS evicted, e.b AS freed_bytes FROM o, e"""
)
def clear_cache(spark: SparkSession, sf: str) -> DataFrame:
    return H.clear_cache(*_store(spark, sf), _entries(spark, sf), _now(), None, True)


@query(
    f"""WITH {ENTRIES_SQL}, files AS (SELECT p_partkey AS name, p_size AS age, CAST(p_size AS BIGINT) AS length FROM part), used AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_quantity > 45),
    o AS (SELECT count(*) AS n, coalesce(sum(length), 0)::BIGINT AS b FROM files WHERE age <= 40 AND name NOT IN (SELECT name FROM used)),
    t AS (SELECT sum(bytes) AS total FROM entries), f AS (SELECT bytes, total - coalesce(sum(bytes) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM entries, t WHERE status <> 'processing'),
    e AS (SELECT count(*) AS n, coalesce(sum(bytes), 0)::BIGINT AS b FROM f WHERE left_over > {EVICT})
    SELECT o.n AS removed_files, o.b AS removed_bytes, e.n AS evicted, e.b AS freed_bytes FROM o, e"""
)
def startup_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return H.startup_cleanup(*_store(spark, sf), _entries(spark, sf), _now(), EVICT)


@query(
    """SELECT count(*) FILTER (wav AND there) AS to_convert, count(*) FILTER (wav AND NOT there) AS missing, count(*) FILTER (opus) AS already, count(*) FILTER (NOT wav AND NOT opus) AS none
    FROM (SELECT o_orderstatus = 'F' AS wav, o_orderstatus = 'O' AS opus, p_partkey IS NOT NULL AS there FROM orders LEFT JOIN part ON p_partkey = o_custkey)"""
)
def wav_migration(spark: SparkSession, sf: str) -> DataFrame:
    path = lambda c: F.concat(F.col(c).cast("string"), F.lit(".wav"))
    audio = F.when(F.col("o_orderstatus") == "F", path("o_custkey")).when(F.col("o_orderstatus") == "O", F.concat(F.col("o_custkey").cast("string"), F.lit(".opus")))
    return H.wav_migration(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), audio.alias("audio_path")), table(spark, sf, "part").select(path("p_partkey").alias("path")))


@query(
    """WITH l AS (SELECT user_id, max(event_id) AS e, max_by(event_type, event_id) AS t, max_by(value, event_id) AS v FROM events GROUP BY user_id)
    SELECT coalesce(l.user_id, c_custkey) AS id, CASE WHEN l.user_id IS NULL THEN c_acctbal ELSE v END AS value FROM customer FULL JOIN l ON l.user_id = c_custkey WHERE l.t IS DISTINCT FROM 'error'"""
)
def apply_events(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    kind = F.when(F.col("event_type") == "error", "removed").otherwise("updated")
    events = table(spark, sf, "events").select(F.col("user_id").cast(entries.schema["id"].dataType).alias("id"), "value", "event_id", kind.alias("kind"))
    return H.apply_events(entries, events, "id", "event_id")


_KINDS = {"signup": "start", "view": "regenerate", "purchase": "complete", "error": "fail", "click": "cancel"}


@query(
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type AS t FROM events),
    m(t, s, n) AS (VALUES ('signup', 0, 1), ('signup', 3, 1), ('purchase', 1, 2), ('error', 1, 3), ('click', 0, 0), ('click', 1, 0), ('view', 0, 1), ('view', 2, 1), ('view', 3, 1)),
    w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 0 AS s, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS d FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL SELECT w.user_id, e.k, coalesce(m.n, w.s), w.a + (m.n IS NOT NULL)::BIGINT, w.d + (m.n IS NULL)::BIGINT FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1 LEFT JOIN m ON m.t = e.t AND m.s = w.s)
    SELECT user_id, ['pending', 'processing', 'ready', 'error'][max_by(s, k) + 1] AS status, max_by(a, k) AS accepted, max_by(d, k) AS discarded FROM w GROUP BY user_id"""
)
def status_machine(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, what in _KINDS.items():
        kind = F.when(F.col("event_type") == name, what).otherwise(kind)
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", kind.alias("kind"))
    return ST.fold_statuses(events, "user_id", "kind", ["ts", "event_id"], F.to_date("ts"))


#: What events stand for in the queries of requests.
_ASKED = {"signup": "create", "view": "regenerate", "purchase": "complete", "error": "fail", "click": "cancel"}


def _request_sql() -> str:
    after = [f"WHEN e.t = '{name}' AND s.state = {k} THEN {R.answer(k, kind)[0]}" for name, kind in _ASKED.items() for k in range(len(R.STATES))]
    why = [f"WHEN e.t = '{name}' AND s.state = {k} THEN '{error}'" for name, kind in _ASKED.items() for k in range(len(R.STATES)) if (error := R.answer(k, kind)[1])]
    names = "[" + ", ".join(f"'{x}'" for x in R.STATES) + "]"
    kinds = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _ASKED.items()) + "}"
    return f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type AS t FROM events),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 0 AS state, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT user_id FROM events)
          UNION ALL SELECT e.user_id, e.k, CASE {' '.join(after)} END, CASE {' '.join(why)} END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT e.user_id, e.ts, e.event_id, {kinds}[e.t] AS kind, s.error IS NULL AS applied, {names}[s.state + 1] AS status, s.error FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, what in _ASKED.items():
        kind = F.when(F.col("event_type") == name, what).otherwise(kind)
    return table(spark, sf, "events").select("user_id", "ts", "event_id", kind.alias("kind"))


@query(_request_sql())
def request_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return R.request_outcomes(_requests(spark, sf), "user_id", "kind", ["ts", "event_id"], F.to_date("ts"))


@query("SELECT user_id, error, CAST(count(*) AS BIGINT) AS requests, CAST(min(event_id) AS BIGINT) AS first_event, error = 'stale' AS silent FROM (" + _request_sql() + ") WHERE error IS NOT NULL GROUP BY user_id, error")
def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected changes by entry and reason."""
    errors = R.rejected(R.request_outcomes(_requests(spark, sf), "user_id", "kind", ["ts", "event_id"], F.to_date("ts")))
    return errors.groupBy("user_id", "error", "silent").agg(F.count("*").alias("requests"), F.min("event_id").alias("first_event"))


@query()
def emitted_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions told of playback that views load (5 seconds long), purchases seek, clicks pause, signups resume and errors stop."""
    kinds = {"view": "load", "purchase": "seek", "click": "pause", "signup": "play", "error": "stop"}
    kind = F.lit(None).cast("string")
    for name, what in kinds.items():
        kind = F.when(F.col("event_type") == name, what).otherwise(kind)
    commands = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("position"), F.lit(5.0).alias("duration"))
    last = commands.agg(F.max(F.unix_millis("ts"))).first()[0] or 0
    return R.emitted_events(commands, last + 120_000, "user_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN true ELSE value >= 49.8 END AS ended FROM events")
def eof_flags(spark: SparkSession, sf: str) -> DataFrame:
    position = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").select("event_id", ST.at_end(position, F.lit(50.0)).alias("ended"))


@query(
    """SELECT event_id, coalesce(ts < last_seek + INTERVAL 6 HOUR, false) AS suppressed FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_seek FROM events) WHERE event_type = 'view'"""
)
def seek_suppress(spark: SparkSession, sf: str) -> DataFrame:
    return ST.suppressed_ticks(table(spark, sf, "events"), ["user_id"], "event_type", "ts", ["ts", "event_id"], "click", "view", "6 HOURS").select("event_id", "suppressed")


@query(
    """SELECT vec_id, list_transform(range(0, CAST(ceil(len(v) * 3 / 2.0) AS BIGINT)), lambda k: round(v[least(floor(k * (2 / 3.0::DOUBLE)), len(v) - 1)::BIGINT + 1] + (v[least(least(floor(k * (2 / 3.0::DOUBLE)), len(v) - 1)::BIGINT + 2, len(v))] - v[least(floor(k * (2 / 3.0::DOUBLE)), len(v) - 1)::BIGINT + 1]) * (k * (2 / 3.0::DOUBLE) - least(floor(k * (2 / 3.0::DOUBLE)), len(v) - 1)), 6)) AS samples
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
)
def resample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", A.rounded(A.resample(F.col("embedding").cast("array<double>"), 16000, 24000), 6).alias("samples"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(x AS DOUBLE))) * 32767) AS SMALLINT)) AS samples FROM embeddings")
def pcm16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", A.pcm16(F.col("embedding").cast("array<double>")).alias("samples"))


@query(
    """SELECT vec_id, CAST(k AS INTEGER) AS frame, CAST((k + 1) * 24 AS INTEGER) AS granule, CAST(list_sum(list_transform(v[k * 24 + 1 : k * 24 + 24], lambda x: CAST(round(x * 10000) AS BIGINT))) AS BIGINT) AS total, 24 AS size
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, unnest(range(0, CAST(ceil(len(embedding) / 24.0) AS BIGINT))) AS k FROM embeddings)"""
)
def frames(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "embeddings").select("vec_id", F.inline(A.frames(F.col("embedding").cast("array<double>"), 24)))
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 10000).cast("long"))
    return each.select("vec_id", "frame", "granule", total.alias("total"), F.size("samples").alias("size"))


@query("SELECT p_partkey, CASE WHEN r <= 10000 THEN 8000 WHEN r <= 14000 THEN 12000 WHEN r <= 20000 THEN 16000 WHEN r <= 36000 THEN 24000 ELSE 48000 END AS rate FROM (SELECT p_partkey, p_size * 1000 AS r FROM part)")
def nearest_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", A.nearest_rate(F.col("p_size") * 1000).alias("rate"))


@query(
    """WITH e AS (SELECT vec_id // 50 AS entry, vec_id AS idx, embedding AS v FROM embeddings),
    o AS (SELECT *, sum(len(v)) OVER (PARTITION BY entry ORDER BY idx) - len(v) AS before FROM e),
    x AS (SELECT entry, before + unnest(range(0, len(v))) AS pos, unnest(v) AS s FROM o)
    SELECT entry, CAST(pos // 1000 AS BIGINT) AS segment, CAST(min(pos) AS BIGINT) AS start, list(CAST(s AS DOUBLE) ORDER BY pos) AS samples FROM x GROUP BY entry, pos // 1000"""
)
def joined_samples(spark: SparkSession, sf: str) -> DataFrame:
    clips = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("entry"), "vec_id", F.col("embedding").cast("array<double>").alias("clip"))
    return A.join_clips(clips, "entry", "vec_id", "clip", 1000)


@query(
    """WITH d AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS t FROM documents),
    s AS (SELECT doc_id, idx, strlen(t) AS n, unnest(range(0, strlen(t) // 255 + 1)) AS k FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) - 1 AS pos FROM s),
    p AS (SELECT doc_id, pos // 255 AS page, count(*) AS segments, sum(least(255, n - 255 * k)) AS body, max(CASE WHEN k = n // 255 THEN 960 * (idx + 1) END) AS granule, min_by(k, pos) > 0 AS continued FROM o GROUP BY doc_id, pos // 255),
    h AS (SELECT doc_id, max(page) AS last FROM p GROUP BY doc_id)
    SELECT doc_id, CAST(page + 2 AS BIGINT) AS page, CAST(coalesce(granule, -1) AS BIGINT) AS granule, CAST(segments AS INTEGER) AS segments,
           CAST(CASE WHEN continued THEN 1 ELSE 0 END + CASE WHEN page = last THEN 4 ELSE 0 END AS INTEGER) AS flags, CAST(27 + segments + body AS INTEGER) AS size FROM p JOIN h USING (doc_id)"""
)
def container_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages around the lines of documents as packets, without the two header pages."""
    from lectern.sources import container as C

    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    packets = lines.select("doc_id", "idx", F.col("line").cast("binary").alias("data"), ((F.col("idx") + 1) * 960).alias("granule"))
    pages = C.container_pages(packets, "doc_id", "idx", "data", "granule", 48000)
    return pages.where(F.col("page") >= C.HEADERS).select("doc_id", "page", "granule", "segments", "flags", F.octet_length("content").alias("size"))


_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'error' END"


def _audio_entries(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "processing").otherwise("error")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_custkey").cast("string").alias("audio_path"), F.col("o_totalprice").alias("duration_sec"), F.lit(False).alias("was_regenerated"), F.col("o_orderpriority").alias("priority"))


@query(
    f"""SELECT o_orderkey AS id, CASE WHEN again THEN 'pending' ELSE s END AS status, CASE WHEN NOT again THEN CAST(o_custkey AS VARCHAR) END AS audio_path, CASE WHEN NOT again THEN o_totalprice END AS duration_sec, again AS was_regenerated
    FROM (SELECT *, {_STATUS_SQL} AS s, o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' AS again FROM orders)"""
)
def regenerate(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders are started anew, unless they are being processed."""
    entries = _audio_entries(spark, sf)
    started, _ = H.regenerate(entries, entries.where("priority = '1-URGENT'"))
    return started.drop("priority")


@query(f"SELECT o_orderkey AS id, 'synthesis_error' AS type, 'already processing' AS message FROM orders WHERE o_orderpriority = '1-URGENT' AND {_STATUS_SQL} = 'processing'")
def regenerate_errors(spark: SparkSession, sf: str) -> DataFrame:
    entries = _audio_entries(spark, sf)
    return H.regenerate(entries, entries.where("priority = '1-URGENT'"))[1]


@query(
    r"""SELECT doc_id, pos, CAST(pos - length(regexp_extract(substr(text, 1, pos), '([^ \t\n\x0B\f\r]*)$', 1)) AS INTEGER) AS start, CAST(pos + length(regexp_extract(substr(text, pos + 1), '^([^ \t\n\x0B\f\r]*)', 1)) AS INTEGER) AS end_pos
    FROM (SELECT doc_id, text, unnest([0, length(text) // 3, length(text) // 2, length(text)]) AS pos FROM documents WHERE text IS NOT NULL)"""
)
def word_around(spark: SparkSession, sf: str) -> DataFrame:
    """The runs without white space around four places of every document."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    n = F.length("text")
    places = docs.select("doc_id", "text", F.explode(F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), n)).alias("pos"))
    around = M.word_around(F.col("text"), F.col("pos"))
    return places.select("doc_id", "pos", around["start"].alias("start"), around["end"].alias("end_pos"))
