"""Files of a narration store as tables: history, word times, file listings, requests, manifests and audio.

Edge cases (tests/test_store.py): an absent path is an empty table; a corrupt document gives no entries and is listed by corrupt_files;
fields that are absent are null, or a default where one is named; requests that can't be read are errors, not failures.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.session import settle

ENTRY = (
    "id string, original_text string, normalized_text string, status string, format string, html_source string, created_at timestamp_ntz, audio_path string, "
    "timestamps_path string, duration_sec double, audio_generated_at timestamp_ntz, was_regenerated boolean, error_message string"
)
HISTORY = f"version int, entries array<struct<{ENTRY.replace(' string', ':string').replace(' timestamp_ntz', ':timestamp_ntz').replace(' double', ':double').replace(' boolean', ':boolean')}>>, _corrupt_record string"
WORDS = "words array<struct<word:string,start:double,end:double,original_pos:array<bigint>>>"
MANIFEST = "model_id string, opset int, export_date_utc string, files array<struct<path:string,size:bigint,sha256:string>>"
REQUEST = "cmd string, id bigint, text string, speaker string, sample_rate int, _corrupt_record string"
COMMANDS = ("warmup", "synthesize", "shutdown")
AUDIO = ("opus", "wav")


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one or many history documents; one row for each entry."""
    return _documents(spark, path, HISTORY).where("entries IS NOT NULL").select(F.inline("entries"))


def corrupt_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of history documents that can't be read, to be set aside by whoever owns them."""
    found = _documents(spark, path, HISTORY)
    if not found.inputFiles():
        return spark.createDataFrame([], "file string, content string")
    bad = F.col("entries").isNull() & F.col("_corrupt_record").isNotNull()
    return found.where(bad).select(F.col("_metadata.file_path").alias("file"), F.col("_corrupt_record").alias("content"))


def write_history(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines in a new folder of path, which appears with its _SUCCESS mark; what is playing is stored as ready.

    Former folders stay until drop_former(): a reader, or a crash while writing, finds the last whole one.
    """
    status = F.when(F.col("status") == "playing", "ready").otherwise(F.col("status"))
    entries.withColumn("status", status).write.json(f"{path}/entries-{time.time_ns():020d}")


def _written(spark: SparkSession, path: str) -> list[str]:
    """Whole folders of a history, oldest first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(fs_path(f"{path}/entries-*/_SUCCESS")) or []
    return sorted(x.getPath().getParent().toString() for x in found)


def drop_former(spark: SparkSession, path: str) -> None:
    """Delete all folders of a history but the last whole one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for old in _written(spark, path)[:-1]:
        fs_path(old).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(old), True)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries that write_history() wrote last."""
    found = _written(spark, path)
    return spark.read.schema(ENTRY).json(found[-1]) if found else spark.createDataFrame([], ENTRY)


# The settings and their defaults.
SETTINGS = {
    "speaker": ("string", "aidar"), "sample_rate": ("int", 24000), "speech_rate": ("double", 1.0), "notify_on_ready": ("boolean", True),
    "notify_on_error": ("boolean", True), "text_format": ("string", "plain"), "max_cache_size_mb": ("int", 500), "code_block_mode": ("string", "read"),
    "read_operators": ("boolean", True), "theme": ("string", "auto"), "player_hotkeys": ("map<string,string>", {
        "play_pause": "Space", "forward_5": "Right", "backward_5": "Left", "forward_30": "Shift+Right", "backward_30": "Shift+Left", "speed_up": "]",
        "speed_down": "[", "next_entry": "n", "prev_entry": "p", "repeat_sentence": "r",
    }), "window_geometry": ("array<int>", None), "preview_dialog_enabled": ("boolean", True), "engine": ("string", "silero_native"),
    "piper_voice": ("string", "ruslan"),
}
# End of fixed values


SETTINGS_SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in SETTINGS.items())


def _default(name: str) -> Column:
    kind, value = SETTINGS[name]
    return F.from_json(F.lit(json.dumps(value)), kind) if isinstance(value, dict) else F.lit(value).cast(kind)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of settings for each document at path, defaults where a field is absent, null or malformed; a row of defaults for none."""
    found = _documents(spark, path, SETTINGS_SCHEMA + ", _corrupt_record string")
    found = found if not found.isEmpty() else spark.createDataFrame([(None,)], "speaker string").select(*[F.lit(None).cast(kind).alias(name) for name, (kind, _) in SETTINGS.items()])
    return found.select(*[F.coalesce(name, _default(name)).alias(name) for name in SETTINGS])


def patched_settings(settings: DataFrame, patch: DataFrame, column: str = "value") -> DataFrame:
    """Settings after a patch, a table of one JSON object in a string column: every field that is set overrides, unknown ones are ignored."""
    asked = patch.select(F.from_json(F.col(column), SETTINGS_SCHEMA).alias("p"))
    return settings.crossJoin(F.broadcast(asked.limit(1))).select(*[F.coalesce(f"p.{name}", name).alias(name) for name in SETTINGS])  # one row each


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines of the files at path, with where their block begins in the file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (file, block, value) with `id`, their number within the file from 0.

    Rows are numbered by the task that reads their block, and blocks by the rows before them; no file is ever one row or one task.
    """
    at = settle(rows.withColumn("row", F.monotonically_increasing_id()), "lines")
    sizes = at.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    offsets = sizes.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    return at.join(offsets, ["file", "block"]).withColumn("id", F.col("row") + F.col("offset"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a vocabulary file of any size: a token's id is the number of its line, from 0."""
    return _numbered(_lines(spark, path)).select("id", F.regexp_replace("value", "\\s+\\z", "").alias("token"))


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """(id, gram) of a file of grams between white space, gzipped or not; a gram's id is its place in the file."""
    grams = _lines(spark, path).select("file", "block", F.explode(F.split("value", r"\s+")).alias("value")).where("value <> ''")
    return _numbered(grams).select("id", F.col("value").alias("gram"))


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """(word, stress, yo) of a gzipped file of lines `word stress yo`; yo is -1 for none, and a malformed line fails the job."""
    parts = F.split(F.trim("value"), r"\s+")
    whole = lambda k: F.get(parts, k).try_cast("int")
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("int")
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.get(parts, 0).alias("word"), F.coalesce(whole(1), bad).alias("stress"), F.coalesce(whole(2), bad).alias("yo"))


def write_word_times(times: DataFrame, path: str) -> None:
    """Words of each entry as JSON, in a folder for each entry; read_saved_word_times() reads them.

    Entries that are saved again are replaced, and others stay, whatever the session's setting: folders are swapped when the job commits.
    """
    word = F.struct("word", "start", "end", F.array("orig_start", "orig_end").alias("original_pos"))
    words = times.groupBy("entry_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", word.alias("w")))), lambda x: x["w"]).alias("words"))
    words.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entry_id").json(path)


def read_saved_word_times(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, idx, word, start, end, orig_start, orig_end) as write_word_times() wrote them."""
    files = _or_empty(spark, WORDS + ", entry_id string", lambda: spark.read.schema(WORDS + ", entry_id string").json(path))
    each = files.select("entry_id", F.posexplode("words").alias("idx", "w"))
    return each.select("entry_id", "idx", "w.word", "w.start", "w.end", F.get("w.original_pos", 0).alias("orig_start"), F.get("w.original_pos", 1).alias("orig_end"))


def newer_files(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(file, version) of history documents of a later version than this library's, which are read all the same."""
    found = _documents(spark, path, HISTORY)
    return found.where(F.col("version") > version).select(F.col("_metadata.file_path").alias("file"), "version") if found.inputFiles() else spark.createDataFrame([], "file string, version int")


def entry(entries: DataFrame, entry_id: str) -> DataFrame:
    """The row with this id; none for an unknown one."""
    return entries.where(F.col("id") == entry_id)


def read_word_times(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, idx, word, start, end, orig_start, orig_end) of files ID.timestamps.json."""
    files = _or_empty(spark, WORDS, lambda: spark.read.schema(WORDS).option("multiLine", True).option("pathGlobFilter", "*.timestamps.json").json(path).withColumn("file", F.input_file_name()))
    if "file" not in files.columns:
        files = files.withColumn("file", F.lit(""))
    each = files.select(F.regexp_extract("file", r"([^/]+)\.timestamps\.json$", 1).alias("entry_id"), F.posexplode("words").alias("idx", "w"))
    return each.select("entry_id", "idx", "w.word", "w.start", "w.end", F.get("w.original_pos", 0).alias("orig_start"), F.get("w.original_pos", 1).alias("orig_end"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, modified, length) of a folder's files; their content is not read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = _or_empty(spark, schema, lambda: spark.read.format("binaryFile").load(path))
    return found.select(F.substring_index("path", "/", -1).alias("name"), "path", F.col("modificationTime").alias("modified"), "length")


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines (batch or stream) with request, a struct, and error: struct<type, message>, null for those that can be read."""
    request = F.from_json(F.col(column), REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = lines.withColumn("request", request)
    why = F.when(F.col("request").isNull() | F.col("request._corrupt_record").isNotNull(), "not a JSON object")
    why = why.when(F.col("request.cmd").isNull() | ~F.col("request.cmd").isin(*COMMANDS), "unknown command")
    why = why.when((F.col("request.cmd") == "synthesize") & (F.trim(F.coalesce("request.text", F.lit(""))) == ""), "empty text")
    return read.withColumn("error", F.when(why.isNotNull(), F.struct(F.lit("bad_input").alias("type"), why.alias("message"))))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, opset, position, path, size, sha256): the files that a manifest lists; a malformed one, or one without files, lists none."""
    rows = _documents(spark, path, MANIFEST).where("size(files) > 0")
    return rows.select("model_id", "opset", F.posexplode("files").alias("position", "f")).select("model_id", "opset", "position", "f.path", "f.size", "f.sha256")


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest with problem: missing, size, checksum or null; files: (path, content). The checksum is worked out where a file lies."""
    there = files.select("path", F.length("content").cast("long").alias("real_size"), F.sha2("content", 256).alias("real_sha256"))
    problem = F.when(F.col("real_size").isNull(), "missing").when(F.col("real_size") != F.col("size"), "size").when(F.col("real_sha256") != F.lower("sha256"), "checksum")
    return manifest.join(there, "path", "left").withColumn("problem", problem).select(*manifest.columns, "problem")


def first_problem(verified: DataFrame) -> DataFrame:
    """(model_id, path, problem) of the first file in order that isn't as listed."""
    least = F.min_by(F.struct("path", "problem"), "position").alias("x")
    return verified.where("problem IS NOT NULL").groupBy("model_id").agg(least).select("model_id", "x.path", "x.problem")


def parse_wav(content: bytes) -> tuple[int, bytes] | None:
    """(rate, samples) of a mono file of 32-bit floats, None for any other."""
    at, rate = 12, None
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, bits = (int.from_bytes(body[a:z], "little") for a, z in ((0, 2), (2, 4), (14, 16)))
            if (kind, channels, bits) != (3, 1, 32):
                return None
            rate = int.from_bytes(body[4:8], "little")
        elif name == b"data":
            return None if rate is None else (rate, body[: size // 4 * 4])
        at += 8 + size + size % 2
    return None


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(name, rate, samples array<float>) of the wav files of a folder; null where the layout is another."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = parse_wav(content.as_py())
                samples = pa.array([None if found is None else np.frombuffer(found[1], "<f4")], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([found and found[0]], pa.int32()), samples], ["name", "rate", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "content").mapInArrow(run, "name string, rate int, samples array<float>")


def wav_bytes(samples: Column, rate: int) -> Column:
    """A mono 16-bit wav file of samples from -1 to 1."""

    @F.pandas_udf("binary")
    def encode(clips):
        import struct

        import numpy as np
        import pandas as pd

        def one(x):
            scaled = np.clip(np.asarray(x, np.float64), -1, 1) * 32767
            data = np.trunc(scaled + np.copysign(0.5, scaled)).astype("<i2").tobytes()
            return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data

        return pd.Series([None if x is None else one(x) for x in clips], dtype=object)

    return encode(samples)
