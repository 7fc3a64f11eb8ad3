"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Candidates come from masks built over GF(2):
bit i has a non-zero vector m(i) of radius+1 bits, and the table of a non-zero vector v keeps the bits whose m(i) is odd against v.
The vectors of at most `radius` differing bits span fewer than radius+1 dimensions, so some v is orthogonal to all of them and
keeps none of these bits: every pair within the radius has the same key in some table.

Edge cases (tests/llm/test_simhash.py): null, empty and blank texts have no words, get fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; repeated rows keep one result each; a null id takes part but is never a
component's name unless all its ids are null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.graph import connected_components
from lectern.session import forget, settle

BLOCK = 1 << 16
#: Fingerprints link at this many differing bits or fewer; covering_links() relies on two.
RADIUS = 2


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector v; a set bit is one that the table of v compares."""
    size = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % size) & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, n: int):
    """XXH64 of every n-word shingle, repeats included; words are split at ASCII white space, A-Z is lower-cased."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if len(words) <= n:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([xxh64_intdigest(line[a:z], 42) for a, z in zip(starts.tolist(), ends[n - 1 :].tolist())], dtype=np.uint64)


def majority(hashes) -> int:
    """The 64 bits that are set in over half the hashes; zero for none."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[k : k + BLOCK], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint long) for every row of docs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [_signed(majority(shingle_hashes(x, shingle))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def covering_links(found: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints (column fingerprint) within RADIUS bits of each other.

    Fingerprints that meet others in a table are not compared with each other: each names itself and the points one bit away from
    it, among the bits its table doesn't compare. Two fingerprints within two bits share such a point and two that share one are
    within two bits, so linking each with the least at every point it names gives all links in rows linear in a bucket's size.
    """
    return _links_of_points(settle(_points(found), "points"))


def _points(found: DataFrame) -> DataFrame:
    """(fingerprint, point) of the fingerprints that meet others in a table."""
    masks = covering_masks(RADIUS)
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = found.select("fingerprint", F.explode(keys).alias("at")).select("fingerprint", "at.mask", "at.key")
    met = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").select("mask", F.bitwise_not("key").alias("other"))
    rows = rows.withColumn("other", F.bitwise_not("key")).join(met, ["mask", "other"], "left_semi")
    free = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]), F.col("mask") + 1)
    near = F.concat(F.array("fingerprint"), F.transform(free, lambda s: F.col("fingerprint").bitwiseXOR(s)))
    return rows.select("fingerprint", F.explode(near).alias("point")).distinct()


def _links_of_points(points: DataFrame) -> DataFrame:
    """Edges (u, v) of fingerprints with the least, other ones at their points, so v is less than u."""
    least = points.groupBy("point").agg(F.min("fingerprint").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = least.select(F.bitwise_not("point").alias("other"), "least")
    joined = points.withColumn("other", F.bitwise_not("point")).join(least, "other").where("fingerprint <> least")
    return joined.select(F.col("fingerprint").alias("u"), F.col("least").alias("v")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint long, component_id) for every row; component_id is the smallest id that links of at most RADIUS bits reach."""
    found = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = settle(found.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    roots = settle(connected_components(covering_links(least)), "roots")
    member = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = settle(member.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = settle(member.join(names, "root").select("fingerprint", "component_id"), "named")
    return found.join(named, "fingerprint", "left").select("id", "fingerprint", "component_id")


#: For near duplicates by similarity: words of a shingle, and the least Jaccard similarity.
SHINGLE, SIMILAR = 5, 0.8
#: Bits of a parity for each member of a set, at least; parities differ in no more places than their sets do.
PARITY_SHARE = 2
#: Texts, and shingles of them, that decide which shingles are common and come last in prefixes; any order gives the same links.
ORDER_TEXTS, ORDER_SHINGLES = 4000, 50_000
#: Texts of a bucket among which a nearest forest is sought at once, and texts of a bucket that one task holds.
CHUNK, BLOCK_TEXTS = 1024, 1 << 14
#: Keys of texts (32 bytes each) are broadcast up to so many.
BROADCAST_KEYS = 500_000


def shingle_set(text: bytes | None):
    """Sorted XXH64 of a text's different shingles."""
    import numpy as np

    return np.unique(shingle_hashes(text, SHINGLE))


def prefix_length(n: int, least: float) -> int:
    """Of two sets of a similarity of `least` or more, the first so many members of each, under one order for all, share one."""
    import math

    return n - math.ceil(least * n - 1e-6) + 1 if n else 0


def prefix(hashes, least: float, common, counts):
    """The first members of a sorted set: those not in `common` (sorted) first, then by count, then by value."""
    import numpy as np

    k = prefix_length(len(hashes), least)
    if not len(common):
        return hashes[:k]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))[:k]]


def parity(hashes) -> bytes:
    """Whether the number of members that fall on each place is odd, for a power of two of places: PARITY_SHARE a member, 64 at least."""
    import numpy as np

    places = 1 << max(6, (PARITY_SHARE * len(hashes) - 1).bit_length())
    at = (hashes & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8)).tobytes()


class Parities:
    """Parities of different sizes; halves of one, laid over each other, are the parity of half as many places."""

    def __init__(self, n, parities: list[bytes]):
        import numpy as np

        self.n = n
        self.words = np.array([len(x) // 8 for x in parities], np.int64)
        self.at = np.zeros(len(parities), np.int64)
        self.full, self.half = {}, {}
        for size in np.unique(self.words).tolist():
            which = np.flatnonzero(self.words == size)
            self.at[which] = np.arange(len(which))
            table = self.full[size] = np.frombuffer(b"".join([parities[i] for i in which.tolist()]), np.uint64).reshape(len(which), size)
            if size > 1:
                self.half[size] = table[:, : size // 2] ^ table[:, size // 2 :]

    def apart(self, i: int, others):
        """Share of the members of set i and each other one that are in one of them alone, at least."""
        import numpy as np

        least, size, sizes = np.abs(self.n[others] - self.n[i]), int(self.words[i]), self.words[others]
        mine = self.full[size][self.at[i]]
        for theirs, tables, own in ((size, self.full, mine), (2 * size, self.half, mine), (size // 2, self.full, mine[: size // 2] ^ mine[size // 2 :] if size > 1 else None)):
            if theirs in tables and own is not None and len(which := np.flatnonzero(sizes == theirs)):
                found = np.bitwise_count(tables[theirs][self.at[others[which]]] ^ own).sum(1, dtype=np.int64)
                least[which] = np.maximum(least[which], found)
        return least / np.maximum(1, self.n[others] + self.n[i])


def jaccard(a, b) -> float:
    """Of two sorted arrays without repeats; empty ones are like nothing."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _common_shingles(docs: DataFrame, text_col: str):
    """(sorted hashes, counts) of shingles that several of about ORDER_TEXTS texts have."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x).view(np.int64))], ["shingle"])

    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(max(1, docs.count() // ORDER_TEXTS))) == 0)
    counts = some.select(F.col(text_col).alias("text")).mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = sorted((r.shingle % 2**64, r.n) for r in counts.where("n > 2").orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).collect())
    return np.array([x for x, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(key, least_id, copies, n, fingerprint, parity, prefix) of every distinct text; n is the number of its different shingles.

    Copies are counted by their keys; only texts that have copies are shuffled, to take one of each.
    """
    common, counts = _common_shingles(docs, text_col)
    rows = docs.select(text_key(F.col(text_col)).alias("key"), F.col(id_col).alias("least_id"), F.col(text_col).alias("text"))
    copies = rows.groupBy("key").agg(F.min("least_id").alias("least_id"), F.count("*").alias("copies")).where("copies > 1")
    copies = _bounded(settle(copies, "copies"))
    once = rows.join(copies.select("key"), "key", "left_anti").select("key", "least_id", F.lit(1).cast("long").alias("copies"), "text")
    many = rows.select("key", "text").join(copies, "key").dropDuplicates(["key"]).select("key", "least_id", "copies", "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hashes = [shingle_hashes(x, SHINGLE) for x in batch.column(3).cast(pa.binary()).to_pylist()]
            prints = pa.array([_signed(majority(x)) for x in hashes], pa.int64())
            sets = [np.unique(x) for x in hashes]
            first = pa.array([prefix(x, least, common, counts).view(np.int64) for x in sets], pa.list_(pa.int64()))
            columns = [*batch.columns[:3], pa.array(map(len, sets), pa.int64()), prints, pa.array(map(parity, sets), pa.binary()), first]
            yield pa.RecordBatch.from_arrays(columns, ["key", "least_id", "copies", "n", "fingerprint", "parity", "prefix"])

    fields = [("key", T.BinaryType()), ("least_id", docs.schema[id_col].dataType), ("copies", T.LongType()), ("n", T.LongType()), ("fingerprint", T.LongType()), ("parity", T.BinaryType()), ("prefix", T.ArrayType(T.LongType()))]
    return once.unionByName(many).mapInArrow(run, T.StructType([T.StructField(*x) for x in fields]))


def text_key(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def nearest_forest(sets: Parities, bound: float) -> list[tuple[int, int]]:
    """Pairs that may be similar, of a least spanning tree of each CHUNK texts and of their first ones."""
    import numpy as np

    out = []
    for low in range(0, len(sets.n), CHUNK):
        left = np.arange(low + 1, min(low + CHUNK, len(sets.n)))
        near, by = sets.apart(low, left), np.full(len(left), low)
        if low:
            out += [(0, low)] * bool(sets.apart(0, np.array([low]))[0] <= bound)
        while len(left):
            k = int(near.argmin())
            i, at, distance = int(left[k]), int(by[k]), near[k]
            if distance <= bound:
                out.append((at, i))
            left, near, by = np.delete(left, k), np.delete(near, k), np.delete(by, k)
            if len(left):
                new = sets.apart(i, left)
                by = np.where(new < near, i, by)
                near = np.minimum(near, new)
    return out


def pairs_between(sets: Parities, room, roots, early, main, left, right, least: float, bound: float) -> list[tuple[int, int]]:
    """Pairs of a left and a right text, given by number, of different roots that may be similar.

    room is how many members a set has from the first one on that it shares with its bucket. Texts share no more than the lesser room,
    so of two similar ones the smaller is early; pairs of late texts, and of texts of the main root, are left out.
    """
    import numpy as np

    out, share = [], least / (1 + least)
    for i in left.tolist():
        fits = (roots[right] != roots[i]) & (np.minimum(room[right], room[i]) >= share * (sets.n[right] + sets.n[i]) - 1e-6)
        fits &= (main[right] | ~early[right] | (right > i)) if early[i] else (main[right] & early[right])
        others = right[fits]
        if len(others):
            out += [(i, int(x)) for x in others[sets.apart(i, others) <= bound]]
    return out


def _compared(rows: DataFrame, *work: str, pairs) -> DataFrame:
    """Pairs (a, b) by pairs(columns of a bucket and block) for rows (bucket, block, node, n, parity, work...); these come in order of node."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def found(parts):
            node, n, *more = (np.concatenate([p[k] for p in parts]) for k in (0, 1, *range(3, 3 + len(work))))
            at = np.array(pairs(node, Parities(n, [x for p in parts for x in p[2]]), *more), np.int64).reshape(-1, 2)
            a, b = node[at[:, 0]], node[at[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        group, parts = None, []
        for batch in batches:
            buckets, blocks, node, n = (batch.column(k).to_numpy() for k in range(4))
            bits, more = batch.column(4).to_pylist(), [batch.column(x).to_numpy(zero_copy_only=False) for x in work]
            edges = [0, *(np.flatnonzero((buckets[1:] != buckets[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(buckets)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if (buckets[low], blocks[low]) != group and parts:
                    yield found(parts)
                    parts = []
                group = buckets[low], blocks[low]
                parts.append((node[low:high], n[low:high], bits[low:high], *(x[low:high] for x in more)))
        if parts:
            yield found(parts)

    dealt = rows.select("bucket", F.col("block").cast("long").alias("block"), "node", "n", "parity", *work).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _bound(least: float) -> float:
    """Of two similar sets, the share of their members that are in one of them alone, at most."""
    return (1 - least) / (1 + least) + 1e-9


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints differ in RADIUS bits or fewer, at most two for each text.

    Texts of one fingerprint are paired with the first of them, and first ones with that of the least fingerprint that theirs links to.
    """
    firsts = settle(classes.groupBy("fingerprint").agg(F.min("node").alias("first")), "firsts")
    points = settle(_points(firsts), "points")
    links = settle(_links_of_points(points).groupBy("u").agg(F.min("v").alias("v")), "fingerprint links")
    forget(points)
    same = classes.select("fingerprint", "node").join(firsts, "fingerprint").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    first_of = lambda x, name: firsts.select(F.col("fingerprint").alias(x), F.col("first").alias(name))
    linked = links.join(first_of("u", "x"), "u").join(first_of("v", "y"), "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(linked)


def _rooted(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with root, the least node that links reach, in a stored table that replaces theirs; and (node, root) of all linked nodes."""
    roots = settle(connected_components(links), "roots")
    rooted = settle(members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    forget(members)
    return rooted, roots


def _forest_pairs(rooted: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different roots in the nearest forests of all buckets; a large bucket is cut into blocks, differently from other buckets."""
    rows = rooted.select(F.explode("buckets").alias("b"), "node", "root", "n", "parity").select("b.bucket", "b.size", "node", "root", "n", "parity")
    block = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("size") / BLOCK_TEXTS).cast("long"))
    bound = _bound(least)
    return _compared(rows.withColumn("block", block), "root", pairs=lambda node, sets, root: [(i, j) for i, j in nearest_forest(sets, bound) if root[i] != root[j]])


def _pairs_of_roots(rooted: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of texts of one bucket, but of different roots, that may be similar.

    Of such a pair one text at least is not of the bucket's main root, nearly all of a large group, and the smaller one is early: its
    members before the first that the bucket shares are too few to keep it from being similar. Early texts of other roots, and late
    ones if the main root has early ones, are dealt to blocks on the left; what they may be similar to is dealt to blocks on the
    right; each left block meets each right one in a task of its own, which holds two blocks at most. Variants of one template that
    are not similar are late, all of them, and meet nobody.
    """
    each = rooted.select(F.explode("buckets").alias("b"), "node", "root", "n").select("b.bucket", "node", "root", (F.col("n") - F.col("b.pos")).cast("long").alias("room"), "n")
    each = each.select("bucket", "node", "root", "room", (F.col("room") >= F.lit(2 * least / (1 + least)) * F.col("n") - 1e-6).alias("early"))
    roots = each.groupBy("bucket", "root").agg(F.count("*").alias("texts"), F.count_if("early").alias("early"))
    main = F.max_by(F.struct("root", "texts", "early"), F.struct("texts", "root")).alias("main")
    mixed = roots.groupBy("bucket").agg(F.sum("texts").alias("size"), F.count("*").alias("roots"), F.sum("early").alias("early"), main).where("roots > 1 AND size > 2")
    mixed = mixed.select("bucket", "size", F.col("main.root").alias("main_root"), F.col("main.early").alias("main_early"), (F.col("early") - F.col("main.early")).alias("early_left"), (F.col("size") - F.col("main.texts")).alias("others"))
    left_size, right_size = F.when(F.col("main_early") > 0, F.col("others")).otherwise(F.col("early_left")), F.when(F.col("early_left") > 0, F.col("size")).otherwise(F.col("main_early"))
    blocks = lambda size: F.ceil(size / BLOCK_TEXTS).cast("long")
    mixed = mixed.select(F.bitwise_not("bucket").alias("other"), "main_root", "main_early", "early_left", blocks(left_size).alias("lefts"), blocks(right_size).alias("rights")).where("lefts > 0 AND rights > 0")
    places = each.withColumn("other", F.bitwise_not("bucket")).join(mixed, "other").drop("other").withColumn("main", F.col("root") == F.col("main_root"))
    places = settle(places.where("NOT main OR early OR early_left > 0"), "places")
    if places.isEmpty():
        return places.select(F.col("node").alias("a"), F.col("node").alias("b"))
    tiles = lambda n, at: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    kept = ["bucket", "node", "root", "room", "early", "main"]
    left = places.where("NOT main AND (early OR main_early > 0)").select(*kept, F.lit(True).alias("left"), tiles(F.col("rights"), lambda j: own("lefts") * F.col("rights") + j).alias("block"))
    right = places.where("early_left > 0 OR main AND early").select(*kept, F.lit(False).alias("left"), tiles(F.col("lefts"), lambda i: i * F.col("rights") + own("rights")).alias("block"))
    bound = _bound(least)

    def pairs(node, sets, root, room, early, main, is_left):
        import numpy as np

        return pairs_between(sets, room, root, early, main, np.flatnonzero(is_left), np.flatnonzero(~is_left), least, bound)

    return _compared(left.unionByName(right).join(rooted.select("node", "n", "parity"), "node"), "root", "room", "early", "main", "left", pairs=pairs)


def _members(classes: DataFrame) -> DataFrame:
    """(node, n, parity, buckets array<struct<bucket, size, pos>>) of the texts that share a member of their prefixes with another.

    A bucket is a set of such texts, named by the first of the members that they share, which is at pos in the text's order; members
    of the same texts, told by their number, least, greatest and two sums of 64 bits, are one bucket.
    """
    tokens = classes.select("node", F.posexplode("prefix").alias("pos", "token"))
    shared = _bounded(settle(tokens.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "shared"))
    places = settle(tokens.join(shared, "token"), "places")
    sums = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"sum{k}") for k in (1, 2)]
    sets = places.groupBy("token", "size").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("pos", "node").alias("at"), *sums)
    buckets = settle(sets.groupBy("size", "low", "high", "sum1", "sum2").agg(F.min_by("token", "at").alias("token")).select("token"), "buckets")
    held = places.join(buckets, "token").groupBy("node").agg(F.collect_list(F.struct(F.col("token").alias("bucket"), "size", "pos")).alias("buckets"))
    members = settle(held.join(classes.select("node", "n", "parity"), "node"), "members")
    forget(buckets, places)
    return members


def _bounded(keys: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if its rows are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, least: float) -> DataFrame:
    """The pairs, as (u, v) in a stored table, whose texts have a Jaccard similarity of shingles of at least `least`.

    Texts travel with the pairs, as they compress, and their sets are taken again where they meet; parities leave few other pairs.
    """
    near = settle(pairs, "near")
    nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = settle(nodes.join(classes.select("node", "key"), "node"), "wanted")
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(_bounded(wanted), "key").select("node", "text")
    texts = settle(texts.dropDuplicates(["node"]), "texts")
    full = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            kept = [jaccard(shingle_set(p.as_py()), shingle_set(q.as_py())) >= least for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    links = settle(full.mapInArrow(compare, "u long, v long"), "links")
    forget(near, wanted, texts)
    return links


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """(key, least_id, copies, group) for every distinct text: its text_key, the smallest id that has it, how many rows, its group (long).

    Groups join texts whose sets of SHINGLE-word shingles have a Jaccard similarity of at least `least`, all of them. SimHash
    fingerprints of these shingles link first, and each link is held against the sets. It misses edits that turn more than RADIUS bits,
    so what it leaves in separate groups is found exactly: similar texts share one of the first shingles (prefix_length) under an order
    common to all, rare ones first. Of the texts that share one, those of a nearest forest are compared first, then all pairs that are
    still in separate groups. Parities of the sets are compared before the sets; they drop only pairs that can't be similar. Null texts
    count as empty; texts without words are alike only if equal.
    """
    classes = settle(_classes(docs, id_col, text_col, least).withColumn("node", F.monotonically_increasing_id()), "classes")
    links = _similar(_fingerprint_pairs(classes), classes, docs, text_col, least)
    rooted, roots = _rooted(_members(classes), links)
    forget(roots)
    links = links.unionByName(_similar(_forest_pairs(rooted, least), classes, docs, text_col, least))
    rooted, roots = _rooted(rooted, links)
    apart = settle(_pairs_of_roots(rooted, least), "apart")
    if not apart.isEmpty():
        links = links.unionByName(_similar(apart, classes, docs, text_col, least))
        roots = settle(connected_components(links), "roots")
    groups = settle(classes.select("key", "least_id", "copies", "node").join(roots, "node", "left").select("key", "least_id", "copies", F.coalesce("root", "node").alias("group")), "groups")
    forget(classes, rooted, apart)
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """(id, group) for every row of docs."""
    classes = near_duplicate_classes(docs, id_col, text_col, least).select("key", "group")
    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")).join(classes, "key", "left").select("id", "group")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row of docs for each group of near duplicates: one with the group's smallest id; nulls come last.

    Texts that are alone in their group pass as they are; only the rows of larger groups are put side by side.
    """
    classes = near_duplicate_classes(docs, id_col, text_col, least)
    sizes = classes.groupBy("group").agg(F.sum("copies").alias("rows"), F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "key")).alias("kept"))
    large = settle(classes.select("key", "group").join(sizes.where("rows > 1"), "group").select(F.col("key").alias("key of a group"), (F.col("key") == F.col("kept.key")).alias("kept"), F.col("kept.least_id").alias("id to keep")), "large")
    forget(classes)
    key, grouped = text_key(F.col(text_col)), _bounded(large)
    alone = docs.join(grouped.select("key of a group"), key == F.col("key of a group"), "left_anti")
    kept = docs.join(grouped.where("kept").drop("kept"), key == F.col("key of a group")).where(F.col(id_col).eqNullSafe(F.col("id to keep"))).dropDuplicates(["key of a group"])
    return alone.select(*docs.columns).unionByName(kept.select(*docs.columns))
