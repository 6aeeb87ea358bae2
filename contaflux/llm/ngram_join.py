"""Jaccard self-join of documents on word n-grams, by count-vector R-trees.

Every distinct shingle set is a point: its shingles are hashed into groups and the point
has the size of each group. Two sets share at most the sum over groups of the smaller
size, and a box of points shares with another at most the sum of the smaller upper sides;
pairs of boxes or points under the overlap that the threshold asks for are left out, and
the sets of the surviving pairs are compared.

One tree over all documents would be one task, and far points of many dimensions don't
prune. So documents meet in blocks first. Two linked sets must share a shingle among the
first ``n - ceil(t * n) + 1`` of each, in any order that all sets agree on. The order here
is rarest first: shingles that are frequent within some chunk of the table come last. A
block is what shares such a shingle. In each block
  1. every set is compared with one hub of the block; what links becomes one component;
  2. of blocks that still hold several components, cut by size, only the sets stay that share
     enough prefix tokens with other components to be similar to a set there; blocks that overlap
     become one group, and groups are cut into parts of a bounded number of sets and shingles;
  3. each pair of parts builds an R-tree, and a set stays only if the bounds leave it a partner
     in another component;
  4. the sets that stay are verified pair by pair as a tree gives them, uniting components at
     once, so that a group gives at most one link less than it has sets.
A link within a component can't change the result, so no group of copies is ever expanded
into its pairs, and no link between components is lost.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contaflux.llm.common import SHINGLE_WORDS, SIMILARITY_PERCENT, Scratch, give_back, pieces, shingle_sets, utf8
from contaflux.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A shingle counts as frequent in a chunk of CHUNK documents when FREQUENT of its sets have it.
CHUNK, FREQUENT = 8192, 8
#: A chunk ends early at so many shingles (8 bytes each).
CHUNK_SHINGLES = 1 << 20
#: The frequent shingles that are told to every task: the most frequent so many (8 bytes each).
#: They order shingles and change no result.
MOST_FREQUENT = 1 << 19
#: A block with more sets, or more shingles in all, is cut into parts of about so many, and
#: each pair of parts is looked at alone.
PART, PART_SHINGLES = 1000, 1 << 20
#: Sets of sizes in a ratio under this are in the same band or in neighbouring ones; over 4 / 3.
BAND = 1.34
#: A hub meets its sets in groups of about so many.
STAR = 500
#: Sets to verify up to this number are broadcast as ids (16 bytes each), else joined by a shuffle.
MOST_BROADCAST = 1 << 20
LEAF = 16
#: Hashes up to which a set's tokens are counted, in 64ths of all hashes: a prefix is a quarter of a set.
MARKS = np.array([4, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 24, 32, 48], np.uint64) << np.uint64(58)
#: How often groups that share sets are made one, so that a set is moved to fewer of them.
MERGES = 2


def prefix_length(n: int, percent: int = SIMILARITY_PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def least_common(a, b, greatest, least, half, percent: int = SIMILARITY_PERCENT):
    """How many tokens the prefixes of two similar sets of sizes a and b have in common at least.

    Of the two prefixes let x's be the one that ends first in the common order. At most
    |x| - overlap of its tokens are not in y, and those that are lie within y's prefix. The
    functions tell how to take the larger, the smaller, and the whole part of a quotient.
    """
    overlap = half(percent * (a + b) + 99 + percent, 100 + percent)
    spare = lambda n: n - half(n * percent + 99, 100) + 1 - n  # noqa: E731  the prefix less the set
    return greatest(least(spare(a), spare(b)) + overlap, 1)


def common_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return least_common(a, b, np.maximum, np.minimum, np.floor_divide)


def common_least_sql(a: str, b: str) -> Column:
    """The same of two columns."""
    p = SIMILARITY_PERCENT
    spare = lambda n: f"(1 - (({n} * {p} + 99) div 100))"
    return F.expr(f"greatest(least({spare(a)}, {spare(b)}) + (({p} * ({a} + {b}) + {99 + p}) div {100 + p}), 1)")


def common_below(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int = SIMILARITY_PERCENT) -> np.ndarray:
    """How many tokens below a mark two similar sets of sizes a and b have in common at least, of which x
    and y lie below it: at most a - overlap tokens of the one are not in the other. Where one set is
    much smaller it lies nearly whole within the other, which the prefixes' lengths alone don't tell."""
    overlap = (percent * (a + b) + 99 + percent) // (100 + percent)
    return np.maximum(x + overlap - a, y + overlap - b)


def below_marks(rare: np.ndarray, whole: bool) -> bytes:
    """How many of a set's sorted rare tokens lie below each of MARKS, up to the last mark before which
    the prefix has them all (whole: the prefix has all rare ones); at most 65535 are told."""
    known = len(MARKS) if whole else int(np.searchsorted(MARKS, rare[-1], "right"))
    return np.minimum(np.searchsorted(rare, MARKS[:known]), 65535).astype("<u2").tobytes()


def counts_of(below: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of counts for each result of below_marks(), 0 before all marks, and how many marks it has."""
    counts = np.zeros((len(below), len(MARKS) + 1), np.int64)
    counts[:, 1:] = np.frombuffer(b"".join(x.ljust(2 * len(MARKS), b"\0") for x in below), "<u2").reshape(-1, len(MARKS))
    return counts, np.array([len(x) // 2 for x in below], np.int64)


def group_count(n: int) -> int:
    """About one group for a shingle, a power of two, so that points of near sizes fold together."""
    return 1 << max(4, min(14, max(int(n), 1).bit_length()))


def count_vector(shingles: np.ndarray, groups: int | None = None) -> np.ndarray:
    groups = groups or group_count(len(shingles))
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def raw_of(vector: np.ndarray) -> bytes:
    """The bytes of a point: how wide its numbers are, then the numbers, packed: most are 0 or 1, so
    they take about a bit and a half each where they are shuffled."""
    wide = vector.max(initial=0) >= 256
    return (b"\4" if wide else b"\1") + zlib.compress(vector.astype("<u4" if wide else "<u1").tobytes(), 1)


def vector_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), "<u1" if raw[0] == 1 else "<u4").astype(np.int32)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The same point with fewer groups; group numbers are the hash's low bits, so sizes add up."""
    return vector.reshape(-1, groups).sum(axis=0) if len(vector) > groups else vector


def stacked(vectors: list[np.ndarray]) -> np.ndarray:
    """Points as rows of one array, folded to the fewest groups among them."""
    groups = min(map(len, vectors))
    rows = [folded(v, groups) for v in vectors]
    small = max(int(r.max(initial=0)) for r in rows) < 1 << 16
    return np.stack([r.astype(np.uint16 if small else np.uint32) for r in rows])


def enough(shared, a, b, percent: int = SIMILARITY_PERCENT):
    """Whether so many shared shingles make sets of sizes a and b similar: 100 * i >= percent * (a + b - i)."""
    return (100 + percent) * shared >= percent * (a + b)


def allowed(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
    """Whether the overlap of two points may suffice."""
    groups = min(len(x), len(y))
    return bool(enough(int(np.minimum(folded(x, groups), folded(y, groups)).sum()), nx, ny))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct shingles are similar sets."""
    both = np.concatenate([x, y])
    both.sort()
    return bool(enough(int(np.count_nonzero(both[1:] == both[:-1])), len(x), len(y)))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in some chunk of documents, copies counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, n = [], set(), 0

        def out():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "n"])

        for batch in pieces(batches, "text"):
            for shingles in shingle_sets(*utf8(batch.column(0))):
                mark = xxhash.xxh3_64_intdigest(shingles.tobytes())
                if mark not in seen and len(shingles):
                    seen.add(mark)
                    held.append(shingles)
                    n += len(shingles)
            if len(held) >= CHUNK or n >= CHUNK_SHINGLES:
                yield out()
                held, seen, n = [], set(), 0
        if held:
            yield out()
        held.clear()
        give_back()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """A row for each document: doc_id, th (hash of the text), node (hash of the set), n,
    and, for one copy a task, rare and often (the shingle hashes of the prefix, apart) and
    below, as below_marks() tells it."""
    schema = "doc_id long, th long, node long, n int, rare array<long>, often array<long>, below binary"
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for batch in pieces(batches, "text"):
            nodes, sizes, rares, oftens, belows = [], [], [], [], []
            for shingles in shingle_sets(*utf8(batch.column(2))):
                n = len(shingles)
                node = xxhash.xxh3_64_intdigest(shingles.tobytes()) if n else 0
                nodes.append(node)
                sizes.append(n)
                if not n or node in seen:
                    rares.append(None)
                    oftens.append(None)
                    belows.append(None)
                    continue
                seen.add(node)
                length = prefix_length(n)
                place = np.searchsorted(known, shingles) if len(known) else np.zeros(n, np.int64)
                place[place == len(known)] = 0
                told = known[place] == shingles if len(known) else np.zeros(n, bool)
                rare = shingles[~told]
                belows.append(below_marks(rare[:length], len(rare) <= length))
                rare = rare[:length]
                rares.append(rare.view(np.int64))
                oftens.append(shingles[told][: length - len(rare)].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(rares, longs), pa.array(oftens, longs), pa.array(belows, pa.binary())],
                names=["doc_id", "th", "node", "n", "rare", "often", "below"],
            )
        seen.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def met(postings: DataFrame) -> DataFrame:
    """The distinct rows (token, node) whose token other nodes have too. Rows come in the
    order of their tokens, so a task compares each with its neighbours and holds one row."""
    rows = postings.repartition("token").sortWithinPartitions("token", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, False  # the row held back, and whether it is known to be shared
        for batch in batches:
            token, node = (batch.column(i).to_numpy() for i in range(2))
            if last is not None:
                token, node = (np.concatenate([[x], y]) for x, y in zip(last, (token, node), strict=True))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node = token[new], node[new]
            twice = token[1:] == token[:-1]
            keep = np.zeros(len(token), bool)
            keep[1:] = twice
            keep[:-1] |= twice
            keep[0] |= known
            last, known = (token[-1], node[-1]), bool(keep[-1])
            out = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(token[out], pa.int64()), pa.array(node[out], pa.int64())], names=["token", "node"])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in last], names=["token", "node"])
        give_back()

    return rows.mapInArrow(run, "token long, node long")


def by_group(rows: DataFrame, joined: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """joined() of each run of rows with the same first column; rows lie sorted by it. A task
    holds one run and one batch; runs are bounded by those who make the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            if held and held[-1].column(0)[0].as_py() != keys[0]:
                yield from joined(pa.Table.from_batches(held))
                held = []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if i:
                    yield from joined(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from joined(pa.Table.from_batches(held))
        held.clear()
        give_back()

    return rows.mapInArrow(run, schema)


def links_of(a: list[int], b: list[int], names: tuple[str, str] = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))


def with_hubs(pairs: DataFrame, payload: DataFrame, test: Callable[[bytes, bytes, int, int], bool], scratch: Scratch) -> DataFrame:
    """Those of pairs (a, b) whose payloads (node, n, x) pass the test. The pairs of a hub are
    dealt into groups of about STAR; each gets the hub's payload once, so payloads aren't
    carried twice."""
    payload = scratch.keep(payload)  # read twice
    large = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups")).where("groups > 1"))
    side = F.broadcast(large) if large.count() <= MOST_BROADCAST else large  # a row for STAR pairs at most
    leaves = pairs.join(payload.withColumnRenamed("node", "b"), "b").join(side, "a", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    leaves = leaves.select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("groups"))).alias("g"), F.lit(1).alias("leaf"), "a", F.col("b").alias("node"), "n", "x")
    hubs = pairs.select("a").distinct().join(payload.withColumnRenamed("node", "a"), "a").join(side, "a", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).select("a", "n", "x", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"))
    hubs = hubs.select(F.xxhash64("a", F.col("i").cast("long")).alias("g"), F.lit(0).alias("leaf"), "a", F.col("a").alias("node"), "n", "x")
    rows = hubs.unionByName(leaves).repartition("g").sortWithinPartitions("g", "leaf")

    def joined(group: pa.Table) -> Iterator[pa.RecordBatch]:
        leaf, a, node, n = (group.column(i).to_pylist() for i in (1, 2, 3, 4))
        x = group.column(5)
        hubs = {a[i]: (x[i].as_py(), n[i]) for i in range(len(a)) if not leaf[i]}
        kept = [i for i in range(len(a)) if leaf[i] and test(hubs[a[i]][0], x[i].as_py(), hubs[a[i]][1], n[i])]
        if kept:
            yield links_of([a[i] for i in kept], [node[i] for i in kept])

    out = scratch.keep(by_group(rows, joined, "a long, b long"))
    scratch.drop(payload, large)
    return out


def bounded(x: bytes, y: bytes, nx: int, ny: int) -> bool:
    return allowed(vector_of(x), vector_of(y), nx, ny)


def verified(x: bytes, y: bytes, nx: int, ny: int) -> bool:
    return similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))


def sets_of(asked: DataFrame, docs: DataFrame, nodes: DataFrame, as_points: bool = False) -> DataFrame:
    """(node, n, x) of the asked (node): x has the sorted shingle hashes, or else the point of the
    set, taken anew from the texts, which is less than to keep those of all documents. nodes:
    node, th and least, by which one document of each set is found."""
    texts = nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("th").alias("asked"), F.col("least")).distinct()
    few = texts.count() <= MOST_BROADCAST
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    rows = rows.join(F.broadcast(texts) if few else texts, (F.col("th") == F.col("asked")) & F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            found, sizes, sets = [], [], []
            for shingles in shingle_sets(*utf8(batch.column(0))):
                raw = shingles.tobytes()
                node = xxhash.xxh3_64_intdigest(raw)
                if raw and node not in seen:
                    seen.add(node)
                    found.append(node)
                    sizes.append(len(shingles))
                    sets.append(raw_of(count_vector(shingles)) if as_points else raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())], names=["node", "n", "x"])
        seen.clear()
        give_back()

    return rows.mapInArrow(run, "node long, n int, x binary")


class RTree:
    """A packed R-tree of count vectors, bulk-loaded by cutting the points in halves at the
    median of the group (or the size) that varies most; LEAF points in a leaf, leaves in
    boxes of which only the upper sides matter."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.vectors, self.sizes = vectors, sizes
        self.order = np.arange(len(sizes))
        todo = [(0, len(sizes))]
        while todo:
            i, j = todo.pop()
            if j - i <= LEAF:
                continue
            own = self.order[i:j]
            group = int(np.argmax(vectors[own[:: 1 + len(own) // 64]].var(axis=0)))  # of some of them: order changes no result
            middle = (j - i) // 2 // LEAF * LEAF or LEAF  # leaves are full but for the last
            self.order[i:j] = own[np.lexsort((sizes[own], vectors[own, group]))]
            todo += [(i, i + middle), (i + middle, j)]
        self.levels = []
        tops, low, high = vectors[self.order], sizes[self.order], sizes[self.order]
        while True:
            cut = np.arange(0, len(tops), LEAF)
            tops, low, high = np.maximum.reduceat(tops, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((tops, low, high))
            if len(tops) == 1:
                break

    def near(self, vector: np.ndarray, n: int, percent: int = SIMILARITY_PERCENT) -> np.ndarray:
        """Rows of the points whose overlap with the given one may suffice."""
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high = self.levels[depth]
            at = at[at < len(tops)]
            fits = (100 * high[at] >= percent * n) & (percent * low[at] <= 100 * n)
            at = at[fits]
            shared = np.minimum(tops[at], vector).sum(axis=1, dtype=np.int64)
            at = at[enough(shared, n, np.maximum(low[at], -(-percent * n // 100)), percent)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = self.order[at[at < len(self.order)]]
        return at[enough(np.minimum(self.vectors[at], vector).sum(axis=1, dtype=np.int64), n, self.sizes[at], percent)]


def tree_pairs(vectors: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows after i whose points allow enough overlap with it) of each point, by an R-tree."""
    rows = stacked(vectors)
    tree = RTree(rows, sizes)
    for i in range(len(sizes)):
        near = tree.near(rows[i], int(sizes[i]))
        yield i, near[near > i]


#: Rows of groups: of a part of its own number, pairs across parts count; of part -1 all do.
GROUP = "g long, node long, n int, comp long, part int"


def parted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with g and part in place of keys: a set of rows with the same keys is cut into parts of
    about PART sets or PART_SHINGLES shingles, and every pair of parts, each with itself too, is a
    group g. rows has c and all, the sets and shingles with these keys."""
    rows = rows.withColumn("parts", F.ceil(F.greatest(F.col("c") / PART, F.col("all") / PART_SHINGLES)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("p"), F.greatest("part", j).alias("q")))
    rows = rows.withColumn("x", F.explode(mates)).withColumn("g", F.xxhash64(*keys, "x.p", "x.q"))
    return rows.withColumn("part", F.when(F.col("x.p") == F.col("x.q"), -1).otherwise(F.col("part"))).drop(*keys, "c", "all", "parts", "x")


def opened(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (token, node, n, comp) of those blocks (token, node, n) that hold several components."""
    rows = blocks.join(labels, "node", "left").select("token", "node", "n", F.coalesce("comp", "node").alias("comp"))
    return rows.join(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "token", "left_semi")


def opened(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (token, node, n, comp) of those blocks (token, node, n) that hold several components."""
    rows = blocks.join(labels, "node", "left").select("token", "node", "n", F.coalesce("comp", "node").alias("comp"))
    return rows.join(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "token", "left_semi")


def open_groups(rows: DataFrame, below: DataFrame) -> DataFrame:
    """Groups (g, node, n, s, comp, part, below) of the opened() rows; s is how many of them a set has:
    what it shares with its own component alone doesn't count. below: (node, below).

    A block is cut into bands of size, each of which also gets the next smaller sets, as only
    sets of near size link. Of bands with the same members (told by a sum of hashes) one is enough.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    members = rows.withColumn("band", F.explode(F.array(band, band + 1)))
    mark = F.sum(F.shiftright(F.xxhash64("node"), 20))
    several = members.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("all"), mark.alias("sign")).where("lo <> hi")
    several = several.groupBy("sign", "c", "lo", "hi").agg(F.min(F.struct("token", "band", "all")).alias("k")).select("k.token", "k.band", "c", "k.all")
    shares = rows.groupBy("node").agg(F.count("*").alias("s")).join(below, "node")
    return parted(members.join(several, ["token", "band"]).join(shares, "node"), "token", "band")


def countable(groups: DataFrame) -> DataFrame:
    """(least, node, n, comp) of the rows of groups that have a partner of another component, of a
    near size, so that both share as many prefix tokens with any set (s) as similar sets of their
    sizes, with as many tokens below the same mark, would with each other. least is the least node
    of the group's rows that stay: groups that overlap mostly have the same one, so they become
    one. Only numbers are moved for this."""
    rows = groups.select("g", "node", "n", "s", "comp", "part", "below").repartition("g").sortWithinPartitions("g")

    def joined(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, s, comp, part = (group.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4, 5))
        kept = np.zeros(len(n), bool)
        counts, marks = counts_of(group.column(6).to_pylist())
        for i in range(0, len(n) if len(n) > 1 else 0, 256):
            a, sa = n[i : i + 256, None], s[i : i + 256, None]
            fits = (comp[i : i + 256, None] != comp) & ((part[i : i + 256, None] != part) | (part < 0)) & (100 * np.minimum(a, n) >= SIMILARITY_PERCENT * np.maximum(a, n))
            fits &= np.minimum(sa, s) >= common_least(a, n)
            x, y = np.nonzero(fits)
            x += i
            mark = np.minimum(marks[x], marks[y])
            enough_below = np.minimum(s[x], s[y]) >= common_below(n[x], n[y], counts[x, mark], counts[y, mark])
            kept[x[enough_below]] = True
        if kept.any():
            least = np.full(int(kept.sum()), node[kept].min())
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(node[kept]), pa.array(n[kept], pa.int32()), pa.array(comp[kept])], names=["least", "node", "n", "comp"])

    return by_group(rows, joined, "least long, node long, n int, comp long").distinct()


def merged(rows: DataFrame) -> DataFrame:
    """Rows (least, node, n, comp) whose groups took the least of the names that their nodes have in
    any group, where what comes together has no more than PART sets: groups that share nodes become
    one, no two rows of a group come apart, and no group grows so far that it would be cut again."""
    names = rows.groupBy("node").agg(F.min("least").alias("m"))
    groups = rows.select("least", "node").join(names, "node").groupBy("least").agg(F.min("m").alias("m"))
    sizes = rows.join(groups, "least").select("m", "node").distinct().groupBy("m").agg(F.count("*").alias("c")).where(F.col("c") <= PART).select(F.col("m").alias("fits"))
    moved = groups.join(sizes, F.col("m") == F.col("fits"), "left").select("least", F.coalesce("fits", "least").alias("to"))
    return rows.join(moved, "least").select(F.col("to").alias("least"), "node", "n", "comp").distinct()


def sized(rows: DataFrame) -> DataFrame:
    """rows with c and all, the sets and shingles of their group."""
    return rows.join(rows.groupBy("least").agg(F.count("*").alias("c"), F.sum("n").alias("all")), "least")


def candidates(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """Those rows of groups that have a partner of another component within the bounds of an
    R-tree of vectors (node, x)."""
    rows = groups.join(vectors, "node").select("g", "node", "n", "comp", "part", "x")
    rows = rows.repartition("g").sortWithinPartitions("g")

    def joined(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        sizes, comp, part = (group.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
        kept = np.zeros(len(sizes), bool)
        for i, near in tree_pairs([vector_of(x) for x in group.column(5).to_pylist()], sizes):
            near = near[(comp[near] != comp[i]) & ((part[near] != part[i]) | (part[i] < 0))]
            kept[near] = True
            kept[i] |= len(near) > 0
        if kept.any():
            yield from group.drop_columns(["x"]).filter(pa.array(kept)).to_batches()

    return by_group(rows, joined, GROUP)


def joining_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that unite components within each of the groups: pairs come
    from an R-tree, are verified by their sets, and are not looked at once they are united."""
    one = groups.groupBy("g").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node", "part")).alias("one"), F.bit_xor(F.xxhash64(F.lit("again"), "node", "part")).alias("two"))
    one = one.groupBy("one", "two", "c").agg(F.min("g").alias("g")).select("g")
    rows = groups.join(one, "g").join(sets.select("node", "x"), "node").select("g", "node", "comp", "part", "x")
    rows = rows.repartition("g").sortWithinPartitions("g", "node")

    def joined(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp, part = (group.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
        sets = [np.frombuffer(x, np.uint64) for x in group.column(4).to_pylist()]
        parent, a, b = {c: c for c in comp.tolist()}, [], []

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for i, near in tree_pairs([count_vector(s) for s in sets], np.array([len(s) for s in sets])) if len(node) > 1 else ():
            for j in near.tolist():
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y and (part[i] != part[j] or part[i] < 0) and similar(sets[i], sets[j]):
                    parent[x] = y
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        if a:
            yield links_of(a, b)

    return by_group(rows, joined, "a long, b long")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and component of every row of docs.

    component_id is the smallest doc_id that can be reached by links (similarity of the
    shingle sets at or over the threshold), the row's own included; rows with null or
    wordless text have no links. Repeated rows stay and carry the same component; a row
    whose doc_id is null takes part and can get a component from others. component names the
    component by itself (null without words), as texts that share an id can be of several;
    text_hash tells such rows apart. Other columns are left out; an empty table gives no rows.
    A set is known by a 64-bit hash, and sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    rows = docs.select("doc_id", "text")
    every = scratch.keep(prefixes(rows, frequent_shingles(rows)))
    # Of each set the document with the least id tells its text (one without an id only if there is no other).
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "n")).alias("o")
    nodes = scratch.keep(every.where("n > 0").groupBy("node").agg(lead, F.max("below").alias("below")).select("node", F.col("o.doc_id").alias("first"), "o.th", F.col("o.doc_id").alias("least"), "o.n", "below"))
    own = scratch.keep(every.select("doc_id", "th", "node", "n"))
    rare, often = (every.where("rare is not null").select(F.explode(c).alias("token"), "node") for c in ("rare", "often"))
    # Rare shingles have short blocks. Blocks of frequent ones may be long: their rows are told apart by the node too.
    shared = scratch.keep(met(rare).unionByName(often.dropDuplicates(["token", "node"])))
    # s: how many tokens of its prefix a set shares with any other. A set's size comes from nodes here, not with each token.
    sizes = shared.groupBy("node").agg(F.count("*").alias("s")).join(nodes.select("node", "n"), "node")
    scratch.drop()  # the exchange of all prefixes is the largest one
    blocks = scratch.keep(shared.join(sizes, "node").select("token", "node", "n", "s"))
    scratch.drop(shared)
    # The hub of a block is the set with the largest share of shared shingles: of near copies
    # the one that the others were made from, which is near to all of them.
    hubs = blocks.groupBy("token").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "node", "n", "s")).alias("h"), F.count("*").alias("c")).where("c > 1").select("token", F.col("h.node").alias("hub"), F.col("h.n").alias("m"), F.col("h.s").alias("t"))
    near = (F.col("hub") != F.col("node")) & (100 * F.least("n", "m") >= SIMILARITY_PERCENT * F.greatest("n", "m")) & (F.least("s", "t") >= common_least_sql("n", "m"))
    pairs = scratch.keep(blocks.join(hubs, "token").where(near).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    both = lambda p: p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node")))
    scratch.drop(every)
    stars = with_hubs(pairs, sets_of(both(pairs), rows, nodes, as_points=True), bounded, scratch)
    links = with_hubs(stars, sets_of(both(stars), rows, nodes), verified, scratch)
    labels = scratch.keep(components(links, scratch))
    several = scratch.keep(opened(blocks, labels))
    scratch.drop(blocks, pairs, stars, links)
    some = scratch.keep(countable(open_groups(several, nodes.select("node", "below"))))
    scratch.drop(several)
    for _ in range(MERGES):
        before, some = some, scratch.keep(merged(some))
        scratch.drop(before)
    found = scratch.keep(candidates(parted(sized(some), "least"), sets_of(some, rows, nodes, as_points=True).select("node", "x")))
    scratch.drop(some)
    more = scratch.keep(joining_links(found, sets_of(found, rows, nodes)))
    # Components, not their sets, are united by the links that came later.
    comp = labels.select("node", "comp")
    ends = more.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    over = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch)
    named = nodes.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("c"))
    named = named.join(over.select(F.col("node").alias("c"), F.col("comp").alias("top")), "c", "left").select("node", "first", F.coalesce("top", "c").alias("comp"))
    component = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = scratch.keep(named.join(component, "comp").select("node", "component_id", F.col("comp").alias("component")))
    scratch.drop(found, more, labels, nodes)
    lone = own.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("th").alias("text_hash"), F.lit(None).cast("long").alias("component"))
    return own.where("n > 0").join(named, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("th").alias("text_hash"), "component").unionByName(lone)
