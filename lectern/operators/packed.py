"""Ranges and spans packed by the cells of a tree over positions, and the hull of the spans that overlap each range, in Arrow batches.

A packed row holds the rows of one cell as differences from row to row, in as few bytes as the largest of a batch needs, so that what is
shuffled is a few bytes for each range or span. Positions are whole numbers. Within a cell nothing is compared pair by pair, but for ranges
and spans that end before they start.

Edge cases (tests/test_mapping.py): as in operators/mapping.py; an empty range is hit by the spans that begin before it and end after it, an
empty span hits the ranges that do, and of ranges and spans that end before they start each pair is held against the rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import clearing

#: Positions of a cell of the lowest level and cells that make up one of the next level, as powers of two, and levels.
CELL_BITS, FAN_BITS, LEVELS = 12, 3, 7
#: Rows that are packed at once, and cells that are worked on at once.
ROWS, CELLS = 1 << 15, 128
#: What stands for no least and for no greatest number, and for an end that is null.
NO_LEAST, NO_MOST = (1 << 63) - 1, -(1 << 63)

_KINDS = ("i1", "i2", "i4", "i8")
_PART = T.StructType([T.StructField("base", T.BinaryType()), T.StructField("data", T.BinaryType())])


def top_level(df: DataFrame, start: str, stop: str) -> int:
    """The highest level of the cells that make up the ranges of df; nothing is stored."""
    blocks = F.shiftright(F.col(stop).cast("long") - 1, CELL_BITS) - F.shiftright(F.col(start).cast("long"), CELL_BITS) + 1
    with clearing(df.sparkSession):
        most = df.agg(F.max(blocks)).first()[0] or 0
    return max(k for k in range(LEVELS) if 1 << FAN_BITS * k <= max(most, 1))


def by_cell(df: DataFrame, keys: list[str], above: int) -> DataFrame:
    """(keys, level, node, least, most, part): df's rows (keys, start, stop, others), packed in each cell that they are made up of, and in those
    up to level `above` that hold one. With two columns `part` also has whether a range begins in the cell; least is the first start,
    most the last stop."""
    schema = T.StructType([*(df.schema[k] for k in keys), *_longs("level", "node", "least", "most"), T.StructField("part", _PART)])
    count, mark = len(df.columns) - len(keys), len(df.columns) - len(keys) == 2

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for held in _gathered(batches):
            columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(len(keys) + count)]
            start, stop, *others = (np.asarray(c) for c in columns[len(keys) :])
            row, level, node, own = _cells(start, np.where(stop == NO_MOST, start, stop), above)
            group = _groups(columns[: len(keys)])[row]
            order = _order(group, level, node, start[row])
            row, level, node, group, own = row[order], level[order], node[order], group[order], own[order]
            values = [start[row], stop[row], *([(own & (start[row] >> CELL_BITS >> FAN_BITS * level == node)).astype(np.int64)] if mark else [x[row] for x in others])]
            new = _changes(group, level, node)
            keep = new | _changes(*values)
            row, level, node, new, values = row[keep], level[keep], node[keep], new[keep], [v[keep] for v in values]
            first = np.flatnonzero(new)
            ends = [np.minimum.reduceat(values[0], first), np.maximum.reduceat(values[1], first)] if len(first) else values[:2]
            yield _batch([*(c.take(pa.array(row[first])) for c in columns[: len(keys)]), level[first], node[first], *ends, _encoded(_relative(values, mark), first)], schema.names)

    return df.mapInArrow(run, schema)


def hulls(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, home, part) of cells (keys, level, node, ranges, spans): the ranges that a span of their cell hits, or that begin there, with the
    least and the greatest end of what hits them, packed by the lowest cell where they begin."""
    schema = T.StructType([*(cells.schema[k] for k in keys), *_longs("home"), T.StructField("part", _PART)])

    def work(batch):
        import numpy as np
        import pyarrow as pa

        level, node = (np.asarray(batch.column(len(keys) + i)) for i in range(2))
        at, a, size, begins = _decoded(batch.column(len(keys) + 2), 3)
        of, s, length, low, wide = _decoded(batch.column(len(keys) + 3), 4)
        width = np.left_shift(1, CELL_BITS + FAN_BITS * level)
        least, most = _hull((at, a, a + size), (of, s, s + length), low, low + wide, node * width, width)
        home = a >> CELL_BITS
        told = np.flatnonzero((begins != 0) | (least != NO_LEAST) | (most != NO_MOST))
        told = told[_order(at[told], home[told], a[told], size[told])]
        at, a, size, home, least, most = (x[told] for x in (at, a, size, home, least, most))
        known = (least != NO_LEAST) + 2 * (most != NO_MOST)
        least, most = _filled(least, known & 1, a), _filled(most, known & 2, a)
        first = np.flatnonzero(_changes(at, home))
        return _batch([*(c.take(pa.array(at[first])) for c in batch.columns[: len(keys)]), home[first], _encoded([a, size, known, least, most - least], first)], schema.names)

    return cells.select(*keys, "level", "node", "ranges", "spans").mapInArrow(_sliced(work), schema)


def unpacked(homes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop, least, most) of homes (keys, parts), each different range once, null for what nothing is known of."""
    schema = T.StructType([*(homes.schema[k] for k in keys), *_longs("start", "stop", "least", "most")])

    def work(batch):
        import numpy as np
        import pyarrow as pa

        at, a, size, known, least, wide = _decoded(batch.column(len(keys)), 5)
        stop, most = a + size, np.where(known & 2, least + wide, NO_MOST)
        least = np.where(known & 1, least, NO_LEAST)
        order = _order(at, a, stop)
        at, a, stop, least, most = (x[order] for x in (at, a, stop, least, most))
        first = np.flatnonzero(_changes(at, a, stop))
        at, a, stop = at[first], a[first], stop[first]
        if len(first):
            least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
        ends = [pa.array(x, mask=x == none) for x, none in ((stop, NO_MOST), (least, NO_LEAST), (most, NO_MOST))]
        return _batch([*(c.take(pa.array(at)) for c in batch.columns[: len(keys)]), a, *ends], schema.names)

    return homes.select(*keys, "parts").mapInArrow(_sliced(work), schema)


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _batch(columns: list, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)


def _gathered(batches: Iterator) -> Iterator[list]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            yield held
            held, rows = [], 0
    if held:
        yield held


def _sliced(work: Callable) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for low in range(0, batch.num_rows, CELLS):
                yield work(batch.slice(low, CELLS))

    return run


def _groups(columns: list):
    """A number for each different row of the columns."""
    import numpy as np

    ids = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        ids = np.unique(ids * (len(ids) + 1) + np.asarray(c.dictionary_encode("encode").indices), return_inverse=True)[1]
    return ids


def _changes(*columns):
    """Whether each row differs from the one before."""
    import numpy as np

    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _order(*columns):
    """The places of rows in order of the columns; most lie so already."""
    import numpy as np

    tied, back = True, False
    for c in columns:
        back = back | (tied & (c[1:] < c[:-1]))
        tied = tied & (c[1:] == c[:-1])
    return np.lexsort(columns[::-1]) if np.any(back) else slice(None)


def _cells(start, stop, above: int):
    """(row, level, node, own): the fewest cells that make up all lowest ones that each range touches, one at least, and those above them."""
    import numpy as np

    low = start >> CELL_BITS
    high = np.maximum(low, (stop - 1) >> CELL_BITS)
    row, found = np.arange(len(low)), []

    def add(row, low, high, level: int) -> None:
        n = np.maximum(high - low + 1, 0)
        node = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(row, n)
        found.extend((row, k, node >> FAN_BITS * (k - level), k == level) for k in range(level, max(level, above) + 1))

    for k in range(LEVELS):
        first, last = (low + (1 << FAN_BITS) - 1) >> FAN_BITS, ((high + 1) >> FAN_BITS) - 1
        up = (first <= last) & (k + 1 < LEVELS)
        add(row[~up], low[~up], high[~up], k)
        add(row[up], low[up], (first[up] << FAN_BITS) - 1, k)
        add(row[up], (last[up] + 1) << FAN_BITS, high[up], k)
        row, low, high = row[up], first[up], last[up]
        if not len(row):
            break
    rows, _, nodes, _ = zip(*found)
    level, own = (np.repeat([x[i] for x in found], [len(r) for r in rows]) for i in (1, 3))
    return np.concatenate(rows), level, np.concatenate(nodes), own


def _relative(values: list, mark: bool) -> list:
    """Ends by their distance from the start."""
    start, stop, *others = values
    return [start, stop - start, *(others if mark else [others[0], others[1] - others[0]])]


def _filled(values, known, otherwise):
    """values, with the last known one where one is not known."""
    import numpy as np

    last = np.maximum.accumulate(np.where(known != 0, np.arange(len(values)), -1)) if len(values) else known
    return np.where(last >= 0, values[last], otherwise) if len(values) else values


def _encoded(columns: list, first):
    """A part for the rows from each of `first` on: their first values and the sizes of differences, and the differences from row to row.

    Differences may wrap around, which sums undo.
    """
    import numpy as np
    import pyarrow as pa

    base = np.empty((len(first), len(columns) + 1), np.int64)
    steps, kinds = [], []
    for i, c in enumerate(columns):
        step = np.diff(c, prepend=c[:1])
        step[first] = 0
        least, most = (step.min(), step.max()) if len(step) else (0, 0)
        kinds.append(next(k for k, kind in enumerate(_KINDS) if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max))
        steps.append(step)
        base[:, i + 1] = c[first]
    base[:, 0] = _code(kinds)
    data = np.empty(len(columns[0]), _record(kinds))
    for i, step in enumerate(steps):
        data[str(i)] = step
    return pa.StructArray.from_arrays([_binary(base, np.arange(len(first) + 1) * base.itemsize * (len(columns) + 1)), _binary(data, np.append(first, len(data)) * data.itemsize)], ["base", "data"])


def _code(kinds: list[int]) -> int:
    return sum(k << 2 * i for i, k in enumerate(kinds))


def _record(kinds: list[int]):
    return [(str(i), f"<{_KINDS[k]}") for i, k in enumerate(kinds)]


def _binary(values, offsets):
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _bytes(column):
    """The bytes of a binary column without nulls, and where each row ends."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _decoded(lists, count: int) -> list:
    """The row of each packed one, and its values; lists: parts by row, null for none."""
    import numpy as np
    import pyarrow as pa

    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
    if not len(owner):
        return [np.empty(0, np.int64) for _ in range(count + 1)]
    base, data = lists.flatten().flatten()
    base = np.frombuffer(_bytes(base)[0].tobytes(), np.int64).reshape(-1, count + 1)
    found = []
    for code in np.unique(base[:, 0]):
        mine = np.flatnonzero(base[:, 0] == code)
        raw, sizes = _bytes(data.take(pa.array(mine)))
        steps = np.frombuffer(raw.tobytes(), _record([int(code) >> 2 * i & 3 for i in range(count)]))
        rows = sizes // steps.itemsize
        first = np.cumsum(rows) - rows
        sums = [np.cumsum(steps[str(i)], dtype=np.int64) for i in range(count)]
        found.append([np.repeat(owner[mine], rows), *(x + np.repeat(base[mine, i + 1] - x[first], rows) for i, x in enumerate(sums))])
    return [np.concatenate(x) for x in zip(*found)]


def _hull(ranges: tuple, spans: tuple, low, high, floor, width) -> tuple:
    """The least low and the greatest high of the spans (cell, start, stop) of the cell of each range that end after its start and start
    before its end; floor, width: where each cell lies.

    A span that does so starts within the range, or is around its start.
    """
    import numpy as np

    (at, a, b), (of, s, e) = ranges, spans
    least, most = np.full(len(a), NO_LEAST), np.full(len(a), NO_MOST)
    if not len(a) or not len(s):
        return least, most
    room = np.cumsum(width + 4) - width - 4  # cells lie apart, and what is outside of a cell by one position
    place = lambda cell, x: room[cell] + 1 + np.clip(x - floor[cell], -1, width[cell] + 1)
    usual, whole, empty = np.flatnonzero(b >= a), np.flatnonzero(e > s), np.flatnonzero(e == s)
    usual = usual[_order(at[usual], a[usual])]
    begin, end = place(at[usual], a[usual]), place(at[usual], b[usual])
    out = [least[usual], most[usual]]
    for some, side in ((whole, "left"), (empty, "right")):
        if len(some):
            starts = place(of[some], s[some])
            order = _order(starts)
            starts, some = starts[order], some[order]
            _fold([low[some], high[some]], np.searchsorted(starts, begin, side), np.searchsorted(starts, end, "left"), out)
    if len(whole):
        first, stop = np.searchsorted(begin, place(of[whole], s[whole]), "right"), np.searchsorted(begin, place(of[whole], e[whole]), "left")
        _paint([low[whole], high[whole]], first, stop, out)
    least[usual], most[usual] = out
    for i in np.flatnonzero((b < a) & (b != NO_MOST)):
        hit = (of == at[i]) & (e > a[i]) & (s < b[i])
        least[i], most[i] = low[hit].min(initial=NO_LEAST), high[hit].max(initial=NO_MOST)
    for i in np.flatnonzero(e < s):
        hit = (at == of[i]) & (e[i] > a) & (s[i] < b)
        least[hit], most[hit] = np.minimum(least[hit], low[i]), np.maximum(most[hit], high[i])
    return least, most


def _powers(first, stop) -> list:
    """For each power of two, which lengths it is the greatest one of that is no more than them."""
    import numpy as np

    some = np.flatnonzero(stop > first)
    powers = np.frexp(stop[some] - first[some])[1] - 1
    return [some[powers == k] for k in range(powers.max(initial=-1) + 1)]


def _fold(values: list, first, stop, into: list) -> None:
    """into with the least and the greatest of values[first:stop]: of two stretches of the power of two that is no more than the length."""
    import numpy as np

    for k, mine in enumerate(_powers(first, stop)):
        low, high = first[mine], stop[mine] - (1 << k)
        for i, f in enumerate((np.minimum, np.maximum)):
            if k:
                values[i] = f(values[i][: -(1 << k - 1)], values[i][1 << k - 1 :])
            into[i][mine] = f(into[i][mine], f(values[i][low], values[i][high]) if k else values[i][low])


def _paint(values: list, first, stop, into: list) -> None:
    """into with the least and the greatest values of all [first, stop) that hold each place: likewise, from long stretches to their halves."""
    import numpy as np

    held = [np.full(len(into[0]), none) for none in (NO_LEAST, NO_MOST)]
    for k, mine in reversed([*enumerate(_powers(first, stop))]):
        for i, f in enumerate((np.minimum, np.maximum)):
            f.at(held[i], first[mine], values[i][mine])
            if k:
                f.at(held[i], stop[mine] - (1 << k), values[i][mine])
                held[i][1 << k - 1 :] = f(held[i][1 << k - 1 :], held[i][: -(1 << k - 1)])
    for i, f in enumerate((np.minimum, np.maximum)):
        f(into[i], held[i], out=into[i])
