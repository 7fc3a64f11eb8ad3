"""Compare and set in order: requests change an entry only where its state allows, and each gets its outcome, errors included.

Streams keep a typed state for each entry (transformWithState); batches give the same rows: requests of an entry are cut into chunks,
each chunk is folded for every state that it could start in, the few chunks of an entry are composed, and each is played again from the
state it then starts in. So a busy entry is many tasks' work. The position emitter makes its own ticks with timers: it needs no row to
tell a position, or to find that playback has ended.

Edge cases (tests/test_requests.py): an entry that was never created, or was deleted, is not found; unknown kinds are rejected; a null key
is one entry in batches; requests that are equal in order are taken as they come; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = ("absent", "pending", "processing", "ready", "error")
NOT_FOUND, NOT_NOW, LATE, EXISTS, UNKNOWN = "not_found", "synthesis_error", "stale", "exists", "unknown_request"
#: What a request makes of each state in turn, or why it is rejected.
REQUESTS: dict[str, tuple[int | str, ...]] = {
    "create": (1, EXISTS, EXISTS, EXISTS, EXISTS),
    "start": (NOT_FOUND, 2, NOT_NOW, NOT_NOW, 2),
    "complete": (LATE, LATE, 3, LATE, LATE),
    "fail": (LATE, LATE, 4, LATE, LATE),
    "cancel": (NOT_FOUND, 1, 1, NOT_NOW, NOT_NOW),
    "regenerate": (NOT_FOUND, 2, NOT_NOW, 2, 2),
    "delete": (NOT_FOUND, 0, 0, 0, 0),
}


def answer(state: int, kind: str | None) -> tuple[int, str | None]:
    """(state after the request, why it was rejected)."""
    after = REQUESTS.get(kind, (UNKNOWN,) * len(STATES))[state]
    return (state, after) if isinstance(after, str) else (after, None)


def _outcome_schema(requests: DataFrame, key: str, order: list[str]) -> T.StructType:
    kept = [requests.schema[c] for c in (key, *order)]
    return T.StructType([*kept, T.StructField("kind", T.StringType()), T.StructField("applied", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])


def request_outcomes(requests: DataFrame, key: str, kind: str, order: list[str], chunk: Column) -> DataFrame:
    """(key, order..., kind, applied, status after it, error) of every request; chunk is an expression that never goes back in order."""
    rows = requests.select(key, *order, F.col(kind).cast("string").alias("kind"), chunk.alias("chunk"))
    sort = [key, "chunk", *order]
    tables_schema = T.StructType([rows.schema[key], rows.schema["chunk"], T.StructField("table", T.ArrayType(T.IntegerType()))])
    schema = _outcome_schema(requests, key, order)

    def fold(batches: Iterator) -> Iterator:
        group, at, table = None, None, []
        for batch in batches:
            out = []
            for i, (k, c, x) in enumerate(zip(*(batch.column(n).to_pylist() for n in range(3)))):
                if (k, c) != group:
                    if group is not None:
                        out.append((*at, table))
                    group, table, at = (k, c), list(range(len(STATES))), (batch.column(0).slice(i, 1), batch.column(1).slice(i, 1))
                table = [answer(s, x)[0] for s in table]
            if out:
                yield emit(out)
        if group is not None:
            yield emit([(*at, table)])

    def emit(out):
        import pyarrow as pa

        keys, chunks, found = zip(*out)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.concat_arrays(chunks), pa.array(found, pa.list_(pa.int32()))], tables_schema.names)

    tables = rows.select(key, "chunk", "kind", *order).repartition(key, "chunk").sortWithinPartitions(*sort).select(key, "chunk", "kind").mapInArrow(fold, tables_schema)
    ordered = tables.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "table"))).alias("tables"))
    entry = lambda t, s: F.struct(t["chunk"].alias("chunk"), s.alias("state"))
    nothing = F.filter(F.transform("tables", lambda t: entry(t, F.lit(0))), lambda x: F.lit(False))
    step = lambda acc, t: F.struct(F.get(t["table"], acc["state"]).alias("state"), F.concat(acc["starts"], F.array(entry(t, acc["state"]))).alias("starts"))
    starts = ordered.select(F.col(key).alias("chunk's key"), F.explode(F.aggregate("tables", F.struct(F.lit(0).alias("state"), nothing.alias("starts")), step)["starts"]).alias("x"))
    starts = starts.select("chunk's key", F.col("x.chunk").alias("chunk's place"), F.col("x.state").alias("state"))
    known = rows.join(starts, F.col(key).eqNullSafe(F.col("chunk's key")) & F.col("chunk").eqNullSafe(F.col("chunk's place"))).drop("chunk's key", "chunk's place")

    def play(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, state = None, 0
        for batch in batches:
            applied, status, errors = [], [], []
            for k, c, x, start in zip(*(batch.column(n).to_pylist() for n in (key, "chunk", "kind", "state"))):
                if (k, c) != group:
                    group, state = (k, c), start
                state, error = answer(state, x)
                applied.append(error is None)
                status.append(STATES[state])
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (key, *order, "kind")), pa.array(applied, pa.bool_()), pa.array(status, pa.string()), pa.array(errors, pa.string())], schema.names)

    return known.repartition(key, "chunk").sortWithinPartitions(*sort).mapInArrow(play, schema)


class Entries(StatefulProcessor):
    """The state of an entry is its status."""

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "state int")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        asked = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        state, found = (self.status.get()[0] if self.status.exists() else 0), []
        for x in asked["kind"]:
            state, error = answer(state, x)
            found.append((error is None, STATES[state], error))
        self.status.update((state,))
        yield pd.concat([asked[[self.key, *self.order, "kind"]], pd.DataFrame(found, columns=["applied", "status", "error"], dtype=object).astype({"applied": bool})], axis=1)

    def close(self) -> None:
        pass


def with_rocks(spark) -> None:
    """The state store that typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_outcomes(requests: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """A stream of the rows of request_outcomes(); accepted() and rejected() tell them apart."""
    with_rocks(requests.sparkSession)
    rows = requests.select(key, *order, F.col(kind).cast("string").alias("kind"))
    return rows.groupBy(key).transformWithStateInPandas(Entries(key, order), _outcome_schema(requests, key, order), "Append", "None")


def accepted(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("applied").drop("applied", "error")


def rejected(outcomes: DataFrame) -> DataFrame:
    """Requests that changed nothing, with the reason; late completions are told apart from what a user has to be told."""
    return outcomes.where("NOT applied").drop("applied").withColumn("silent", F.col("error") == LATE)


#: Milliseconds between ticks, and after a seek without them; seconds before the end that count as the end.
TICK, SILENT, SLACK = 100, 300, 0.2


class Playback:
    """Playback of one entry: commands at times, and ticks between them.

    load sets the duration and plays from a position, play and pause do so from where it stands, seek moves, stop ends; before a load and
    after a stop there is nothing to play. A tick first looks for the end, which is told once; then it is silent if a seek was less than SILENT ago; else it tells the position.
    """

    FIELDS = "loaded boolean, playing boolean, position double, since long, duration double, silent long, tick long"

    def __init__(self, values: tuple | None = None):
        self.loaded, self.playing, self.position, self.since, self.duration, self.silent, self.tick = values or (False, False, 0.0, 0, None, -1, -1)

    def values(self) -> tuple:
        return self.loaded, self.playing, float(self.position), int(self.since), self.duration, int(self.silent), int(self.tick)

    def at(self, ts: int) -> float:
        return self.position + (ts - self.since) / 1000 if self.playing else self.position

    def ticks(self, upto: int) -> Iterator[tuple[int, str, float]]:
        """Events of all ticks before `upto`."""
        while self.playing and self.tick < upto:
            ts, position = self.tick, self.at(self.tick)
            self.tick += TICK
            if self.duration is not None and self.duration > 0 and position >= self.duration - SLACK:
                self.playing, self.position, self.since = False, position, ts
                yield ts, "finished", position
            elif ts >= self.silent:
                yield ts, "position", position

    def command(self, ts: int, kind: str, position: float | None, duration: float | None) -> Iterator[tuple[int, str, float]]:
        self.position, self.since = self.at(ts), ts
        if kind == "load":
            self.loaded, self.position, self.duration, self.silent = True, position or 0.0, duration, -1
        if kind == "load" or kind == "play" and self.loaded and not self.playing:
            self.playing, self.tick = True, ts + TICK
        elif kind == "seek" and self.loaded and position is not None:
            self.position, self.silent = position, ts + SILENT
            yield ts, "position", position
        elif kind == "pause":
            self.playing = False
        elif kind == "stop":
            self.loaded, self.playing, self.position = False, False, 0.0


_EVENTS = "ts_ms long, event string, position double"


def _told(key: str, names: list, found: list[tuple]):
    import pandas as pd

    return pd.DataFrame({key: pd.Series(names, dtype=object), "ts_ms": pd.Series([x[0] for x in found], dtype="int64"), "event": pd.Series([x[1] for x in found], dtype=object), "position": pd.Series([x[2] for x in found], dtype=float)})


class Emitter(StatefulProcessor):
    """Commands wait until the watermark has passed them, so that they come in order; a timer waits for the next command or tick."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.playback = handle.getValueState("playback", Playback.FIELDS)
        self.waiting = handle.getListState("waiting", "ts long, kind string, position double, duration double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        none = lambda x: None if pd.isna(x) else float(x)
        for frame in rows:
            for x in frame.itertuples():
                self.waiting.appendValue((int(x.ts_ms), x.kind, none(x.position), none(x.duration)))
                self.handle.registerTimer(int(x.ts_ms) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        playback, found, rest = Playback(self.playback.get() if self.playback.exists() else None), [], []
        for ts, kind, position, duration in sorted((tuple(x) for x in self.waiting.get()), key=lambda x: x[0]) if self.waiting.exists() else ():
            if ts < upto:
                found += [*playback.ticks(ts), *playback.command(ts, kind, position, duration)]
            else:
                rest.append((ts, kind, position, duration))
        found += playback.ticks(upto)
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.playback.update(playback.values())
        if playback.playing:
            self.handle.registerTimer(max(playback.tick, upto) + 1)
        yield _told(self.key, [key[0]] * len(found), found)

    def close(self) -> None:
        pass


def emitted_stream(commands: DataFrame, key: str = "entry_id", late: str = "0 seconds") -> DataFrame:
    """A stream of (key, ts_ms, event, position) made of a stream of commands (key, ts timestamp, kind, position, duration), without ticks.

    What is told reaches up to the watermark, the newest time of all commands less `late`; commands that come later than that are lost.
    """
    with_rocks(commands.sparkSession)
    timed = commands.withWatermark("ts", late).select(key, "ts", F.unix_millis("ts").alias("ts_ms"), "kind", "position", "duration")
    kept = commands.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(Emitter(key), f"{key} {kept}, {_EVENTS}", "Append", "EventTime")


def emitted_events(commands: DataFrame, until_ms: int, key: str = "entry_id") -> DataFrame:
    """The same of a table of commands, with ticks before until_ms; an entry's commands stream by in order, none are held."""
    rows = commands.select(key, F.unix_millis("ts").alias("ts_ms"), "kind", "position", "duration").repartition(key).sortWithinPartitions(key, "ts_ms")
    schema = T.StructType([commands.schema[key], *T.StructType.fromDDL(_EVENTS)])

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        none = lambda x: None if pd.isna(x) else float(x)
        name, playback, started = None, Playback(), False
        for frame in frames:
            names, found = [], []

            def told(events: Iterator) -> None:
                size = len(found)
                found.extend(events)
                names.extend([name] * (len(found) - size))

            for k, ts, kind, position, duration in frame.itertuples(index=False):
                if not started or k != name:
                    if started:
                        told(playback.ticks(until_ms))
                    name, playback, started = k, Playback(), True
                if ts < until_ms:
                    told(playback.ticks(ts))
                    told(playback.command(ts, kind, none(position), none(duration)))
            yield _told(key, names, found)
        if started:
            found = list(playback.ticks(until_ms))
            yield _told(key, [name] * len(found), found)

    return rows.mapInPandas(run, schema)
