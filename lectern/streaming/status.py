"""Entry status as a machine over ordered events: streams keep the state of each key, batches compose transitions.

States: pending, processing, ready, error. Completions that come when an entry isn't processing are discarded by state, not by time.

Edge cases (tests/test_status.py): unknown events are discarded; keys may be null and are then one key; events that are equal in order
are taken as they come; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

STATES = ("pending", "processing", "ready", "error")
#: What an event makes of each state in turn; None discards the event.
TRANSITIONS = {
    "start": (1, None, None, 1),
    "complete": (None, 2, None, None),
    "fail": (None, 3, None, None),
    "cancel": (0, 0, None, None),
    "regenerate": (1, None, 1, 1),
}


def fold_statuses(events: DataFrame, key: str, kind: str, order: list[str], chunk: Column) -> DataFrame:
    """(key, status, accepted, discarded) after all events of each key, which starts as pending.

    Events of a key are cut into chunks (an expression that never goes back in order, like the day). A chunk is sorted and folded for
    every state that it could start in, as its events stream by; the few chunks of a key are then composed. So a busy key is many
    tasks' work, and no list of events is ever held.
    """
    rows = events.select(key, chunk.alias("chunk"), *order, F.col(kind).alias("event kind"))
    dealt = rows.repartition(key, "chunk").sortWithinPartitions(key, "chunk", *order).select(key, "chunk", "event kind")

    def run(batches: Iterator) -> Iterator:
        fresh = lambda: [(s, 0, 0) for s in range(len(STATES))]
        group, table, none = None, fresh(), (None,) * len(STATES)
        for batch in batches:
            done = []
            keys, chunks, kinds = (batch.column(k).to_pylist() for k in range(3))
            for k, c, event in zip(keys, chunks, kinds):
                if group != (k, c):
                    if group is not None:
                        done.append((*group, table))
                    group, table = (k, c), fresh()
                after = TRANSITIONS.get(event, none)
                table = [(s, a, d + 1) if after[s] is None else (after[s], a + 1, d) for s, a, d in table]
            yield folded(done)
        yield folded([] if group is None else [(*group, table)])

    def folded(done):
        import pyarrow as pa

        step = pa.struct([("s", pa.int32()), ("a", pa.int64()), ("d", pa.int64())])
        tables = [[dict(zip("sad", x)) for x in t] for *_, t in done]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kinds_of[0]), pa.array([x[1] for x in done], kinds_of[1]), pa.array(tables, pa.list_(step))], [key, "chunk", "table"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds_of = [to_arrow_type(dealt.schema[c].dataType) for c in (key, "chunk")]
    schema = T.StructType([dealt.schema[key], dealt.schema["chunk"], T.StructField("table", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("d", T.LongType())])))])
    tables = dealt.mapInArrow(run, schema)
    ordered = tables.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "table"))).alias("tables"))
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("d"))
    compose = lambda acc, t: F.get(F.transform(F.array(F.get(t["table"], acc["s"])), lambda x: F.struct(x["s"].alias("s"), (acc["a"] + x["a"]).alias("a"), (acc["d"] + x["d"]).alias("d"))), 0)
    final = ordered.select(key, F.aggregate("tables", zero, compose).alias("x"))
    return final.select(key, F.get(F.split(F.lit("|".join(STATES)), r"\|"), F.col("x.s")).alias("status"), F.col("x.a").alias("accepted"), F.col("x.d").alias("discarded"))


def stream_statuses(events: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """A stream of (key, status, accepted, discarded) after each batch of a stream of events, with a row of state for each key."""

    def advance(names, frames: Iterator, state) -> Iterator:
        import pandas as pd

        s, accepted, discarded = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for event in rows[kind]:
            after = TRANSITIONS.get(event, (None,) * 4)[s]
            s, accepted, discarded = (s, accepted, discarded + 1) if after is None else (after, accepted + 1, discarded)
        state.update((s, accepted, discarded))
        yield pd.DataFrame({key: [names[0]], "status": [STATES[s]], "accepted": [accepted], "discarded": [discarded]})

    kept = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(advance, f"{key} {kept}, status string, accepted long, discarded long", "s int, accepted long, discarded long", "update", "NoTimeout")


def at_end(position: Column, duration: Column, slack: float = 0.2) -> Column:
    """Whether playback has ended: the duration is known, and the position is not, or within slack of it."""
    return F.coalesce(duration.isNotNull() & (position.isNull() | ((duration > 0) & (position >= duration - slack))), F.lit(False))


def suppressed_ticks(events: DataFrame, keys: list[str], kind: str, ts: str, order: list[str], seek: str, tick: str, window: str) -> DataFrame:
    """Ticks with `suppressed`: whether a seek of the same key came less than a window before."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(kind) == seek, F.col(ts)), True).over(upto)
    recent = F.col(ts) < F.col("last_seek") + F.expr(f"INTERVAL {window}")
    return events.withColumn("last_seek", last).where(F.col(kind) == tick).withColumn("suppressed", F.coalesce(recent, F.lit(False))).drop("last_seek")


def highlight_stream(positions: DataFrame, words: DataFrame) -> DataFrame:
    """A stream of positions (entry_id, position_sec) with the active word of a stored table (entry_id, idx, start, end, previous_end).

    A word is active from the end of the one before it, so one range condition on an equi-join gives at most one row a position.
    """
    w = words.select("entry_id", "idx", "word", "previous_end", "end")
    return positions.join(w, "entry_id").where("position_sec >= previous_end AND position_sec < end").select("entry_id", "position_sec", "idx", "word")


def position_events(ticks: DataFrame, key: str = "entry_id", suppress_ms: int = 300, slack: float = 0.2) -> DataFrame:
    """What is told of a stream of ticks and seeks (key, ts_ms, kind, position, duration): (key, ts_ms, event, position).

    The end comes first, once, and nothing follows it; a seek tells its target at once and silences ticks for suppress_ms; other ticks
    tell their position. The state of a key is the end of its silence and whether it has ended.
    """

    def advance(names, frames: Iterator, state) -> Iterator:
        import pandas as pd

        silent_until, ended = state.get if state.exists else (-1, False)
        out = []
        for x in pd.concat(list(frames)).sort_values("ts_ms", kind="stable").itertuples():
            if ended:
                continue
            if x.kind == "seek":
                silent_until = int(x.ts_ms) + suppress_ms
                out.append((x.ts_ms, "position", x.position))
                continue
            known = not pd.isna(x.duration)
            if known and (pd.isna(x.position) or x.duration > 0 and x.position >= x.duration - slack):
                ended = True
                out.append((x.ts_ms, "finished", x.position))
            elif x.ts_ms >= silent_until and not pd.isna(x.position):
                out.append((x.ts_ms, "position", x.position))
        state.update((silent_until, ended))
        yield pd.DataFrame({key: [names[0]] * len(out), "ts_ms": [int(x[0]) for x in out], "event": [x[1] for x in out], "position": pd.Series([x[2] for x in out], dtype=float)})

    kept = ticks.schema[key].dataType.simpleString()
    return ticks.groupBy(key).applyInPandasWithState(advance, f"{key} {kept}, ts_ms long, event string, position double", "silent_until long, ended boolean", "append", "NoTimeout")


def queue_events(changes: DataFrame, key: str = "id", kind: str = "kind", order: str = "seq") -> DataFrame:
    """A stream of what a queue shows of each entry after each batch of changes: (key, status, playing, removed).

    updated sets the status, removed takes the entry off for good until it is updated again, started and stopped mark what is playing.
    """

    def advance(names, frames: Iterator, state) -> Iterator:
        import pandas as pd

        status, playing, removed = state.get if state.exists else (None, False, False)
        for x in pd.concat(list(frames)).sort_values(order, kind="stable").itertuples():
            what = getattr(x, kind)
            if what == "updated":
                status, removed = x.status, False
            elif what == "removed":
                playing, removed = False, True
            elif what in ("started", "stopped", "finished"):
                playing = what == "started" and not removed
        state.update((status, playing, removed))
        yield pd.DataFrame({key: [names[0]], "status": [status], "playing": [playing], "removed": [removed]})

    kept = changes.schema[key].dataType.simpleString()
    return changes.groupBy(key).applyInPandasWithState(advance, f"{key} {kept}, status string, playing boolean, removed boolean", "status string, playing boolean, removed boolean", "update", "NoTimeout")
