"""A history of entries as a table: repair, changes, search, and keeping its files within bounds.

Edge cases (tests/test_history.py): ids that no entry has change nothing; repeated ids in a request count once; entries without a date
are the oldest; entries without files are evicted only with their texts; empty tables give no rows, or zeros where one row of totals is
returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import TimestampType

from lectern.session import settle

# Fixed values
GRACE_SECONDS = 60
FORMATS = ("plain", "markdown", "html")
PIPER_MOST = 100_000
ENGINES = ("piper", "silero", "silero_native")
# End of fixed values


def new_entries(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Pending entries of texts that aren't blank, without a leading byte order mark."""
    text = F.regexp_replace(text_col, "^\\uFEFF", "")
    kept = texts.where(F.trim(F.col(text_col)) != "")
    return kept.select(F.uuid().alias("id"), text.alias("original_text"), F.lit("pending").alias("status"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"), F.lit(False).alias("was_regenerated"))


def repair_status(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries as they should be after a restart: ready without its file is pending, without metadata; processing starts again."""
    there = files.select(F.col("path").alias("audio_path"), F.lit(True).alias("there")).distinct()
    full = entries.join(there, "audio_path", "left")
    gone = F.col("audio_path").isNotNull() & F.col("there").isNull()
    lost = gone | F.col("audio_path").isNull()
    status = F.when(F.col("status").isin("ready", "playing") & lost, "pending").when(F.col("status") == "processing", "pending").when(F.col("status") == "playing", "ready").otherwise(F.col("status"))
    cleared = {"status": status, "duration_sec": F.when(gone, None).otherwise(F.col("duration_sec")), "audio_path": F.when(gone, None).otherwise(F.col("audio_path"))}
    return full.withColumns(cleared).select(*entries.columns)


def upsert(entries: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key among both."""
    both = entries.unionByName(changes)
    newest = F.max(F.struct(F.col(order), *[F.col(c) for c in entries.columns if c not in (key, order)])).alias("row")
    return both.groupBy(key).agg(newest).select(key, "row.*").select(*entries.columns)


def update_where(entries: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Compare and set: new values where the condition holds on the row as it is."""
    return entries.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_audio(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries without audio, pending, for these ids."""
    mark = entries.join(ids.select("id", F.lit(True).alias("drop it")).distinct(), "id", "left")
    hit = F.col("drop it").isNotNull()
    nulls = {c: F.when(hit, None).otherwise(F.col(c)) for c in ("audio_path", "timestamps_path", "duration_sec") if c in entries.columns}
    return mark.withColumns(nulls | {"status": F.when(hit, "pending").otherwise(F.col("status"))}).select(*entries.columns)


def regenerate(entries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries started anew, and errors (id, type, message) for those that are processing."""
    asked = entries.join(ids.select("id").distinct(), "id", "left_semi")
    errors = asked.where("status = 'processing'").select("id", F.lit("synthesis_error").alias("type"), F.lit("already processing").alias("message"))
    started = delete_audio(entries, asked.where("status <> 'processing'"))
    mark = started.join(asked.where("status <> 'processing'").select("id", F.lit(True).alias("hit")), "id", "left")
    return mark.withColumn("was_regenerated", F.coalesce("hit", "was_regenerated")).select(*entries.columns), errors


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with every field that patch sets."""
    fields = [c for c in base.columns if c != key]
    joined = base.alias("b").join(patch.alias("p"), F.col(f"b.{key}") == F.col(f"p.{key}"), "left")
    return joined.select(F.col(f"b.{key}").alias(key), *[F.coalesce(F.col(f"p.{c}"), F.col(f"b.{c}")).alias(c) for c in fields])


def search(entries: DataFrame, text: str, column: str = "original_text") -> DataFrame:
    """Entries whose text holds the trimmed query, whatever its case; a blank query keeps all."""
    return entries.where(F.contains(F.lower(column), F.lit(text.strip().lower()))) if text.strip() else entries


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("created_at"), "id")


def with_places(ordered: DataFrame) -> DataFrame:
    """Rows in their order with their place in it, from 1: counted by partition, so that no task sees all rows."""
    at = ordered.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    at = settle(at, "ordered")
    sizes = at.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = F.broadcast(sizes.select("part", "first", before.alias("before")))
    return at.join(offsets, "part").withColumn("place", F.col("before") + F.col("row") - F.col("first") + 1).drop("part", "row", "first", "before")


def orphans(files: DataFrame, references: DataFrame, now: Column) -> DataFrame:
    """files (name, modified) that no entry names and that are at least GRACE_SECONDS old."""
    old = files.where(F.unix_timestamp(now) - F.unix_timestamp("modified") >= GRACE_SECONDS)
    return old.join(references.select("name").where("name IS NOT NULL").distinct(), "name", "left_anti")


def bytes_of_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(id, bytes) of the files of each entry that exist."""
    paths = entries.select("id", F.explode(F.array("audio_path", "timestamps_path")).alias("path"))
    return paths.join(files.select("path", "length"), "path", "left").groupBy("id").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _second(entries: DataFrame) -> Column:
    """created_at in seconds since 1970, in its own order whatever the session's time zone; without a date it is before all others."""
    at = F.col("created_at")
    if entries.schema["created_at"].dataType == TimestampType():
        second = F.unix_seconds(at)
    else:  # as the clock shows it: a zone's clock skips hours, so what has none is not put into one
        at = at.cast("timestamp_ntz")
        second = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.coalesce(second, F.lit(-(1 << 62)))


def evict_to_size(entries: DataFrame, target: int) -> DataFrame:
    """Rows (id, created_at, bytes, status) to evict, oldest first until the total of all is at most target; none for target 0.

    Bytes are summed by day, and of the day where the target is crossed by minute; rows are put in order only within the minute where
    it is crossed. So no task sorts all entries.
    """
    if target <= 0:
        return entries.limit(0)
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long")).first()[0]
    at = _second(entries)
    rest, evicted = entries.where("status <> 'processing' AND bytes IS NOT NULL"), []
    for size in (86400, 60):
        cell = at - F.pmod(at, F.lit(size))
        cells = rest.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("cell_bytes"))
        before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day, or each minute of one day
        left = cells.withColumn("left_over", F.lit(total) - F.coalesce(F.sum("cell_bytes").over(before), F.lit(0)))
        crossed = left.where((F.col("left_over") > target) & (F.col("left_over") - F.col("cell_bytes") <= target)).orderBy("cell").first()
        if crossed is None:  # all of it goes, or nothing
            return reduce(DataFrame.unionByName, [*evicted, rest if total > target else rest.limit(0)])
        evicted.append(rest.where(cell < F.lit(crossed.cell)))
        rest, total = rest.where(cell == F.lit(crossed.cell)), int(crossed.left_over)
    order = Window.orderBy(F.asc_nulls_first("created_at"), "id").rowsBetween(Window.unboundedPreceding, -1)
    freed = rest.withColumn("freed", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    return reduce(DataFrame.unionByName, [*evicted, freed.where(F.lit(total) - F.col("freed") > target).drop("freed")])


def evict_all(entries: DataFrame, delete_texts: bool = False) -> DataFrame:
    """Rows that a full clearing evicts."""
    kept = entries.where("status <> 'processing'")
    return kept if delete_texts else kept.where("bytes IS NOT NULL")


def evictions(rows: DataFrame) -> DataFrame:
    """One row of what an eviction removes: evicted, freed_bytes."""
    return rows.agg(F.count("*").alias("evicted"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("freed_bytes"))


def swept(files: DataFrame, references: DataFrame, now: Column) -> DataFrame:
    """One row of what a sweep removes: removed_files, removed_bytes; files: (name, modified, length)."""
    return orphans(files, references, now).agg(F.count("*").alias("removed_files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("removed_bytes"))


def startup_cleanup(files: DataFrame, references: DataFrame, entries: DataFrame, now: Column, target: int) -> DataFrame:
    """Totals of a sweep and of an eviction to size, which keeps texts, in one row."""
    return swept(files, references, now).crossJoin(F.broadcast(evictions(evict_to_size(entries, target))))  # one row each


def clear_cache(files: DataFrame, references: DataFrame, entries: DataFrame, now: Column, target_mb: int | None = None, delete_texts: bool = False) -> DataFrame:
    """Totals of a sweep and of an eviction, to a size in MiB or of everything, in one row."""
    rows = evict_all(entries, delete_texts) if target_mb is None else evict_to_size(entries, target_mb * 1024 * 1024)
    return swept(files, references, now).crossJoin(F.broadcast(evictions(rows)))  # one row each


def delete_entries(entries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and the paths (path) of the files of those that go."""
    going = entries.join(ids.select("id").distinct(), "id", "left_semi")
    paths = [c for c in ("audio_path", "timestamps_path") if c in entries.columns]
    files = going.select(F.explode(F.array(*paths)).alias("path")).where("path IS NOT NULL")
    return entries.join(ids.select("id").distinct(), "id", "left_anti"), files


def set_format(entries: DataFrame, formats: DataFrame) -> DataFrame:
    """Entries with the format that formats (id, format) asks for, whatever their status; an unknown format changes nothing."""
    asked = formats.where(F.col("format").isin(*FORMATS)).groupBy("id").agg(F.max("format").alias("asked"))
    return entries.join(asked, "id", "left").withColumn("format", F.coalesce("asked", "format")).select(*entries.columns)


def playable(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that can be played: ready, and their audio file exists."""
    return entries.where("status = 'ready' AND audio_path IS NOT NULL").join(files.select(F.col("path").alias("audio_path")).distinct(), "audio_path", "left_semi").select(*entries.columns)


def apply_events(entries: DataFrame, events: DataFrame, key: str, order: str, kind: str = "kind") -> DataFrame:
    """Entries after a log of changes: the last event of each key puts its row, or removes it (kind is `removed`).

    events have the columns of entries, order and kind; an entry without events stays.
    """
    columns = [c for c in entries.columns if c != key]
    rows = entries.select(key, F.lit(None).cast(events.schema[order].dataType).alias("order"), F.lit("updated").alias("kind"), F.struct(*columns).alias("row"))
    log = events.select(key, F.col(order).alias("order"), F.col(kind).alias("kind"), F.struct(*columns).alias("row"))
    last = rows.unionByName(log).groupBy(key).agg(F.max(F.struct(F.col("order").isNotNull().alias("later"), "order", "kind", "row")).alias("last"))
    return last.where("last.kind <> 'removed'").select(key, "last.row.*").select(*entries.columns)


def wav_migration(entries: DataFrame, files: DataFrame) -> DataFrame:
    """One row that counts entries by what a migration of wav files to opus does: to_convert, missing, already, none."""
    there = files.select(F.col("path").alias("audio_path"), F.lit(True).alias("there")).distinct()
    wav, opus = F.lower("audio_path").endswith(".wav"), F.lower("audio_path").endswith(".opus")
    full = entries.join(there, "audio_path", "left")
    return full.agg(
        F.count_if(wav & F.col("there").isNotNull()).alias("to_convert"), F.count_if(wav & F.col("there").isNull()).alias("missing"),
        F.count_if(opus).alias("already"), F.count_if(F.col("audio_path").isNull()).alias("none"),
    )


def too_long(text: Column, engine: Column, most: int = PIPER_MOST, engines: tuple[str, ...] = ("piper",)) -> Column:
    """Whether an engine with a limit gets a text beyond it; the length is in code points."""
    return F.coalesce(engine.isin(*engines) & (F.length(text) > most), F.lit(False))


def ingest(texts: DataFrame, engine: Column, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """New entries of texts, and errors (text, type, message) of those that are blank or too long for the engine."""
    marked = texts.withColumn("why", F.when(F.coalesce(F.trim(F.col(text_col)), F.lit("")) == "", "empty text").when(too_long(F.col(text_col), engine), "text too long"))
    errors = marked.where("why IS NOT NULL").select(F.col(text_col).alias("text"), F.lit("bad_input").alias("type"), F.col("why").alias("message"))
    return new_entries(marked.where("why IS NULL"), text_col), errors


def cache_stats(files: DataFrame) -> DataFrame:
    """Bytes of all files, and how many hold audio."""
    audio = F.lower(F.substring_index("path", ".", -1)).isin("opus", "wav")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.count_if(audio).alias("audio_files"))


def fallback_engine(available: dict[str, Column]) -> Column:
    """The first engine that is available, in the order given."""
    return F.coalesce(*[F.when(ok, F.lit(name)) for name, ok in available.items()])
