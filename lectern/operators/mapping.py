"""Provenance as tables: ranges of normalised text, edits, rendered spans and the positions of playback, mapped by joins.

Edge cases (tests/test_mapping.py): ranges and words without a match keep their row, with themselves, -1 or null; equal rows of ranges,
positions and words count once; rows with a null key match nothing; empty tables give no rows. Spans may be of any length: each is
made up of a few cells of a tree, about as many as the tree has levels, and not of a row for every so many positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.operators import packed as P
from lectern.session import settle


#: Positions of a cell of the lowest level, cells that make up one of the next level, and levels; ranges meet in cells, so a long
#: document is many keys.
CELL, FAN_BITS, LEVELS = 64, 3, 9


def _cover(start: Column, stop: Column) -> Column:
    """array<struct<level, node>>: the fewest cells that make up all lowest ones that a range touches, one at least."""
    low = F.floor(start / CELL)
    high = F.greatest(low, F.floor((stop - 1) / CELL))
    first = lambda k: F.shiftright(low + ((1 << FAN_BITS * k) - 1), FAN_BITS * k)
    last = lambda k: F.shiftright(high + 1, FAN_BITS * k) - 1
    none = F.array().cast("array<bigint>")
    run = lambda a, z: F.when(a <= z, F.sequence(a, z)).otherwise(none)
    parts = []
    for k in range(LEVELS):
        nodes = run(first(k), last(k))
        if k + 1 < LEVELS:
            edges = F.concat(run(first(k), F.shiftleft(first(k + 1), FAN_BITS) - 1), run(F.shiftleft(last(k + 1) + 1, FAN_BITS), last(k)))
            nodes = F.when(first(k + 1) <= last(k + 1), edges).otherwise(nodes)
        parts.append(_at_level(nodes, k))
    short = F.array(F.struct(F.lit(0).alias("level"), low.alias("node")))
    return F.when(low == high, short).when(first(1) > last(1), _at_level(F.sequence(low, high), 0)).otherwise(F.flatten(F.array(*parts)))


def _at_level(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))


def _above(level: Column, node: Column, levels: list[int]) -> Column:
    """array<struct<level, node>>: a cell, and those of the given levels that hold it."""
    at = [F.when(level <= k, F.struct(F.lit(k).alias("level"), F.call_function("shiftright", node, ((F.lit(k) - level) * FAN_BITS).cast("int")).alias("node"))) for k in levels]
    return F.array_compact(F.array(*at)) if at else F.array().cast("array<struct<level:int,node:bigint>>")


def _celled(df: DataFrame, cells: Column, name: str) -> DataFrame:
    """A stored table of df with (level, node), a row for each of its cells."""
    return settle(df.withColumn("cell", F.explode(cells)).select(*df.columns, "cell.level", "cell.node"), name)


def _used(celled: DataFrame) -> list[int]:
    return sorted(r.level for r in celled.select("level").distinct().collect())  # LEVELS at most


def map_via_spans(ranges: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, norm_start, norm_end) with orig_start, orig_end: the hull of the spans that overlap, itself where none does.

    Two ranges overlap if a cell of one is a cell of the other, or lies in one. Cells are dealt packed (operators/packed.py), and nothing is
    stored: what the tallest cells are is asked first.
    """
    names = ["start", "stop", "least", "most"]
    as_long = lambda df, *columns: df.select(*keys, *[F.col(c).cast("long").alias(n) for c, n in zip(columns, names)])
    r = as_long(ranges, "norm_start", "norm_end").where("start is not null").fillna(P.NO_MOST, ["stop"])
    s = as_long(spans, "norm_start", "norm_end", "orig_start", "orig_end").where("start is not null and stop is not null").fillna(P.NO_LEAST, ["least"]).fillna(P.NO_MOST, ["most"])
    tops = [P.top_level(df, "norm_start", "norm_end") for df in (ranges, spans)]
    cell = [*keys, "level", "node"]

    def dealt(df: DataFrame, above: int, name: str) -> DataFrame:
        ends = [F.min("least").alias(f"least of {name}"), F.max("most").alias(f"most of {name}")]
        return P.by_cell(df, keys, above).repartition(*cell).groupBy(*cell).agg(*ends, F.collect_list("part").alias(name))

    r, s = dealt(r, tops[1], "ranges"), dealt(s, tops[0], "spans")
    s = s.withColumnsRenamed({c: f"{c} of span" for c in cell})
    same = reduce(Column.__and__, [F.col(c) == F.col(f"{c} of span") for c in cell])
    met = r.join(s, same & (F.col("most of spans") > F.col("least of ranges")) & (F.col("least of spans") < F.col("most of ranges")), "left")
    homes = P.hulls(met, keys).repartition(*keys, "home").groupBy(*keys, "home").agg(F.collect_list("part").alias("parts"))
    kind = lambda df, c: df.schema[c].dataType
    found = P.unpacked(homes, keys).select(
        *keys, F.col("start").cast(kind(ranges, "norm_start")).alias("norm_start"), F.col("stop").cast(kind(ranges, "norm_end")).alias("norm_end"),
        F.col("least").cast(kind(spans, "orig_start")).alias("lo"), F.col("most").cast(kind(spans, "orig_end")).alias("hi"),
    )
    return found.select(*keys, "norm_start", "norm_end", F.coalesce("lo", "norm_start").alias("orig_start"), F.coalesce("hi", "norm_end").alias("orig_end"))


def _met(rows: DataFrame, spans: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Different rows with each span of their cell that is hit, or with nulls: a cell is dealt once, so what is grouped by it stays there."""
    cell = [*keys, "level", "node"]
    rows = rows.repartition(*cell).distinct()
    spans = spans.select(*[F.col(c).alias(f"{c} of span") for c in cell], *[c for c in spans.columns if c not in cell])
    same = reduce(Column.__and__, [F.col(c) == F.col(f"{c} of span") for c in cell])
    return rows.join(spans, same & hit, "left")


def map_positional(char_map: Column, start: Column, end: Column) -> Column:
    """struct<start, end> by position: the first element's start and the last one's end, positions cut to the map."""
    last = F.size(char_map) - 1
    cut = lambda k: F.least(F.greatest(k, F.lit(0)), last)
    found = F.struct(F.get(char_map, cut(start))["s"].alias("start"), F.get(char_map, cut(end - 1))["e"].alias("end"))
    return F.when(last < 0, F.struct(start.alias("start"), end.alias("end"))).otherwise(found)


def bounding_range(char_map: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: least start and greatest end over a range of the map, cut to its last entry; itself for an empty map."""
    size = F.size(char_map)
    low = F.least(start, size - 1)
    part = F.slice(char_map, low + 1, F.greatest(F.lit(1), F.least(end, size) - low))
    hull = F.struct(F.array_min(F.transform(part, lambda x: x["s"])).alias("start"), F.array_max(F.transform(part, lambda x: x["e"])).alias("end"))
    return F.when(size == 0, F.struct(start.alias("start"), end.alias("end"))).otherwise(hull)


def word_around(text: Column, position: Column) -> Column:
    """struct<start, end> of the run without white space around a position."""
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), position), r"(\S*)\z", 1))
    after = F.length(F.regexp_extract(F.substring(text, position + 1, F.length(text)), r"\A(\S*)", 1))
    return F.struct((position - before).alias("start"), (position + after).alias("end"))


#: Positions of a stretch: running values are taken within a stretch, and over stretches, so a long document is many tasks' work.
STRETCH = 4096


def active_words(positions: DataFrame, words: DataFrame, keys: list[str], stretch: float = STRETCH) -> DataFrame:
    """positions (keys, t) with the index of the active word: the first that ends after t, so the next one in a gap; -1 past the last."""
    part = lambda x: F.floor(x / stretch).alias("stretch")
    both = positions.select(*keys, part(F.col("t")), F.col("t").alias("at"), F.lit(None).cast(words.schema["idx"].dataType).alias("idx"), F.lit(1).alias("asks")).distinct()
    both = both.unionByName(words.select(*keys, part(F.col("end")), F.col("end").alias("at"), "idx", F.lit(0).alias("asks")))
    own = Window.partitionBy(*keys, "stretch").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.min("idx").over(own)).where("asks = 1")
    later = Window.partitionBy(*keys).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    firsts = both.groupBy(*keys, "stretch").agg(F.min("idx").alias("first")).withColumn("far", F.min("first").over(later)).drop("first")
    found = near.join(firsts, [*keys, "stretch"], "left")
    return found.select(*keys, F.col("at").alias("t"), F.coalesce(F.least("near", "far"), F.lit(-1)).alias("active"))


def newest_before(rows: DataFrame, marks: DataFrame, keys: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """rows (keys, at) with the value of the last mark before each, by one sort of both together."""
    both = rows.select(*keys, F.col(at).alias("at"), F.lit(None).cast(marks.schema[value].dataType).alias("value"), F.lit(0).alias("mark"))
    both = both.unionByName(marks.select(*keys, F.col(at).alias("at"), F.col(value).alias("value"), F.lit(1).alias("mark")))
    order = Window.partitionBy(*keys).orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("newest", F.last(F.when(F.col("mark") == 1, F.col("value")), True).over(order)).where("mark = 0").select(*keys, "at", "newest")


def tightest_span(words: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, s, e) with the rendered span that shows each: the same range, else the smallest around it, the first on a tie."""
    s = spans.select(*keys, "span", F.col("start").alias("ss"), F.col("end").alias("se"))
    s = _celled(s, _cover(F.col("ss"), F.col("se")), "spans")
    levels = _used(s) or [0]
    above = _above(F.lit(0), F.floor(F.col("s") / CELL), levels)
    cells = words.select(*keys, "s", "e", F.explode(above).alias("cell")).select(*keys, "s", "e", "cell.level", "cell.node")
    joined = _met(cells, s, keys, (F.col("ss") <= F.col("s")) & (F.col("se") >= F.col("e")))
    order = F.struct(((F.col("ss") != F.col("s")) | (F.col("se") != F.col("e"))).alias("not_exact"), (F.col("se") - F.col("ss")).alias("size"), "span")
    found = joined.groupBy(*keys, "level", "node", "s", "e").agg(F.min(F.when(F.col("ss").isNotNull(), order)).alias("best"))
    if len(levels) > 1:
        found = found.groupBy(*keys, "s", "e").agg(F.min("best").alias("best"))
    return found.select(*keys, "s", "e", F.col("best.span").alias("span"))


def edit_offsets(edits: DataFrame, keys: list[str]) -> DataFrame:
    """edits (keys, orig_start, orig_end, new_len) with new_start: where each lies after all edits before it."""
    order = Window.partitionBy(*keys).orderBy("orig_start").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("new_start", F.col("orig_start") + F.coalesce(F.sum(F.col("new_len") - (F.col("orig_end") - F.col("orig_start"))).over(order), F.lit(0)))


def unit_spans(maps: DataFrame, keys: list[str], char_map: str = "char_map") -> DataFrame:
    """One span for each character of a map: (keys, norm_start, norm_end, orig_start, orig_end)."""
    each = maps.select(*keys, F.posexplode(char_map).alias("i", "x"))
    return each.select(*keys, F.col("i").alias("norm_start"), (F.col("i") + 1).alias("norm_end"), F.col("x.s").alias("orig_start"), F.col("x.e").alias("orig_end"))


def map_to_original(variant: dict[str, Column], start: Column, end: Column) -> Column:
    """struct<start, end> by whichever map a row has: spans (array<struct<norm_start, norm_end, orig_start, orig_end>>), or char_map, or none."""
    spans, char_map = variant.get("spans"), variant.get("char_map")
    found = F.struct(start.alias("start"), end.alias("end"))
    if char_map is not None:
        found = F.when(char_map.isNotNull() & (F.size(char_map) > 0), map_positional(char_map, start, end)).otherwise(found)
    if spans is not None:
        hit = F.filter(spans, lambda x: (x["norm_end"] > start) & (x["norm_start"] < end))
        hull = F.struct(F.array_min(F.transform(hit, lambda x: x["orig_start"])).alias("start"), F.array_max(F.transform(hit, lambda x: x["orig_end"])).alias("end"))
        found = F.when(spans.isNotNull() & (F.size(hit) > 0), hull).when(spans.isNotNull(), F.struct(start.alias("start"), end.alias("end"))).otherwise(found)
    return found


def source_positions(points: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, at) of a rewritten text with `source`, where they come from, and `inside`, whether in a rewritten part.

    edits (keys, orig_start, orig_end, new_len) are disjoint; one running sum places them, one as-of pass finds the last that starts at
    or before each point. A point inside a part comes from the part's start.
    """
    placed = edit_offsets(edits, keys).select(*keys, F.col("new_start").alias("at"), F.struct("new_start", "new_len", "orig_start", "orig_end").alias("edit"), F.lit(0).alias("asks"))
    both = points.select(*keys, "at", F.lit(None).cast(placed.schema["edit"].dataType).alias("edit"), F.lit(1).alias("asks")).unionByName(placed)
    order = Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.max(F.when(F.col("asks") == 0, F.struct("edit.orig_start", "edit"))).over(order)["edit"]).where("asks = 1")
    inside = F.coalesce(F.col("at") < F.col("last.new_start") + F.col("last.new_len"), F.lit(False))
    moved = F.col("last.orig_end") + F.col("at") - F.col("last.new_start") - F.col("last.new_len")
    return found.select(*keys, "at", F.when(inside, F.col("last.orig_start")).otherwise(F.coalesce(moved, "at")).alias("source"), inside.alias("inside"))


def is_sorted(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sorted): whether starts never go back."""
    back = F.lag("start").over(Window.partitionBy(*keys).orderBy("idx")) > F.col("start")
    return words.withColumn("back", F.coalesce(back, F.lit(False))).groupBy(*keys).agg((~F.bool_or("back")).alias("sorted"))
