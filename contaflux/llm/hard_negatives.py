"""Hard negatives: for an anchor and each of its positives, the rows of other labels whose score
is near the positive's, but safely below it.

Rows are put in the order of a Hilbert curve over the dimensions that vary most, label by
label, and cut into blocks of rows of one label. Blocks are rows of Parquet files, with the
least and largest value of each dimension (a zone map) beside the packed vectors. From
an anchor and a zone map, interval arithmetic bounds the scores that a block can hold; what
lies outside the anchor's windows, or below the best rows found so far, isn't read or multiplied.

Anchors go to the tasks in groups of at most ANCHOR_GROUP, so a broadcast is bounded,
and blocks are never shuffled after they are written.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.llm.common import Scratch, give_back

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256  # a component x becomes floor(SCALE * x)
ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score is between these shares (percent) of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
ANCHOR_GROUP = 4096  # anchors of one broadcast
BLOCK_ROWS = 512
FILE_ROWS = 1 << 16  # rows of a file of blocks, about
CURVE_DIMENSIONS, CURVE_BITS = 8, 4
_POSITION_BITS = 20  # of a row's number; the rest is its block's
_NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v (whole numbers) of the rows that take part: those with an id, a label
    and a vector whose components are all there and finite."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    some = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~odd)
    return some.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each point (rows of whole numbers below 2 ** bits) on a Hilbert curve through all
    its dimensions. From the highest bit down each level's quadrant turns the ones inside it:
    a set bit flips the lower bits of the first dimension, a clear one swaps them with it;
    what is left, in Gray code, gives the digits of the place."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        below = level - np.uint64(1)
        for i in range(n):
            inside = (x[i] & level) != 0
            swapped = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inside, below, swapped)
            x[i] ^= swapped
        level >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, level = np.zeros(x.shape[1], np.uint64), np.uint64(1 << (bits - 1))
    while level > 1:
        turn ^= np.where((x[n - 1] & level) != 0, level - np.uint64(1), np.uint64(0))
        level >>= np.uint64(1)
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return place.astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of one width; what a shorter vector lacks is 0."""
    column = column.cast(pa.large_list(pa.int64()))
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes) and (sizes == width).all():
        out[:] = flat[offsets[0] : offsets[-1]].reshape(-1, width)
    else:
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            out[i, : b - a] = flat[a:b]
    return out


def blocks(rows: DataFrame, scratch: Scratch, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """The blocks of quantised rows, as a table in the shared folder, and the vectors' width:
    block (number), label, n, low, high (the zone map), ids and vectors (packed).
    Widths are filled up with zeros. Scores of 2 ** 56 or more are a ValueError."""
    rows = scratch.keep(rows)
    spread = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.max(F.abs("x")).alias("most")).collect()
    count, width = rows.count(), max((r["at"] + 1 for r in spread), default=0)
    most = max((r["most"] for r in spread), default=0)
    if width * most * most >= 1 << 56:
        raise ValueError(f"components of up to {most} in {width} dimensions: scores don't fit")
    chosen = sorted(sorted(spread, key=lambda r: (-(r["sd"] or 0), r["at"]))[:CURVE_DIMENSIONS], key=lambda r: r["at"])
    at = [r["at"] for r in chosen]
    mean, sd = np.array([r["mean"] for r in chosen]), np.array([max(r["sd"], 1e-9) for r in chosen])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(2), width)[:, at]
            cells = np.clip((points - mean) / sd * 2 ** (CURVE_BITS - 2) + 2 ** (CURVE_BITS - 1), 0, 2**CURVE_BITS - 1).astype(np.int64)
            place = hilbert(cells, CURVE_BITS) if at else np.zeros(len(points), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    files = max(1, -(-count // FILE_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // block_rows)))
    order = ["label", "place", "vec_id"]
    sorted_rows = rows.mapInArrow(placed, "vec_id long, label long, v array<long>, place long").repartitionByRange(files, *order).sortWithinPartitions(*order)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            vectors = matrix(batch.column(2), width)
            starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(labels) else []
            cuts = sorted({c for a, b in zip(starts, [*starts[1:], len(labels)], strict=True) for c in range(int(a), int(b), block_rows)})
            made = []
            for a, b in zip(cuts, [*cuts[1:], len(labels)], strict=True):
                part = vectors[a:b]
                made.append((number, int(labels[a]), b - a, part.min(axis=0).tobytes(), part.max(axis=0).tobytes(), ids[a:b].astype(np.int64).tobytes(), part.astype(kind).tobytes()))
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)], names=["block", "label", "n", "low", "high", "ids", "vectors"])
        give_back()

    return scratch.keep(sorted_rows.mapInArrow(cut, "block long, label long, n long, low binary, high binary, ids binary, vectors binary")), width


class Best:
    """The k highest scores of each key with the ids and numbers of their rows; ties: smaller id, then number."""

    def __init__(self, keys: int, k: int):
        self.k, self.least = k, np.full(keys, _NONE)
        self.kept = [np.zeros(0, np.int64)] * 4
        self.more: list[tuple] = []
        self.size = 0

    def offer(self, keys: np.ndarray, scores: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """A row of scores for each key; only those from low to high count."""
        fit = (scores >= np.maximum(low, self.least[keys])[:, None]) & (scores <= high[:, None])
        many = np.flatnonzero(fit.sum(axis=1) > self.k)
        if len(many):
            some = np.where(fit[many], scores[many], _NONE)
            fit[many] &= scores[many] >= np.partition(some, -self.k, axis=1)[:, -self.k][:, None]
        a, b = np.nonzero(fit)
        if len(a):
            self.more.append((keys[a], scores[a, b], ids[b], rows[b]))
            self.size += len(a)
            if self.size > 1 << 16:
                self.settle()

    def settle(self) -> list[np.ndarray]:
        key, score, id, row = (np.concatenate(x) for x in zip(self.kept, *self.more, strict=True)) if self.more else self.kept
        order = np.lexsort((row, id, -score, key))
        key, score, id, row = key[order], score[order], id[order], row[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        last = rank == self.k - 1
        self.least[key[last]] = score[last]
        self.kept, self.more, self.size = [x[rank < self.k] for x in (key, score, id, row)], [], 0
        return self.kept


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that each anchor can have with a vector between low and high."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low + down @ high, up @ high + down @ low


def products(anchors: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whole-number inner products: in floating point where that is exact, which is faster."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(block).max(initial=0)) * max(1, anchors.shape[1])
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ block.T.astype(np.float64)).astype(np.int64)
    return anchors @ block.T


def _zone(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    return batch.column(at("label"))[i].as_py(), np.frombuffer(batch.column(at("low"))[i].as_py(), np.int64), np.frombuffer(batch.column(at("high"))[i].as_py(), np.int64)


def _payload(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, numbers and vectors of a block's rows."""
    at = batch.schema.get_field_index
    ids = np.frombuffer(batch.column(at("ids"))[i].as_py(), np.int64)
    raw = batch.column(at("vectors"))[i].as_py()
    kind = {2: np.int16, 4: np.int32}.get(len(raw) // max(1, len(ids) * width), np.int64)
    first = batch.column(at("block"))[i].as_py() << _POSITION_BITS
    return ids, first + np.arange(len(ids)), np.frombuffer(raw, kind).reshape(len(ids), width).astype(np.int64)


def _batch(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "score", "vec_id", "row"])


_FOUND = "key long, score long, vec_id long, row long"


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _positives(table: DataFrame, width: int, anchors: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> DataFrame:
    """key (the anchor's place in its group), score, vec_id, row and rank of each anchor's positives."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors), POSITIVES)
        for batch in batches:
            for i in range(batch.num_rows):
                label, low, high = _zone(batch, i)
                own = np.flatnonzero(labels == label)
                own = own[bounds(anchors[own], low, high)[1] >= best.least[own]]
                if not len(own):
                    continue
                ids, rows, vectors = _payload(batch, i, width)
                scores = products(anchors[own], vectors)
                itself = numbers[own] - rows[0]
                there = np.flatnonzero((itself >= 0) & (itself < len(rows)))
                scores[there, itself[there]] = _NONE
                open_to = np.full(len(own), _NONE + 1)
                best.offer(own, scores, open_to, np.full(len(own), np.iinfo(np.int64).max), ids, rows)
        yield _batch(best.settle())
        give_back()

    wanted = [int(x) for x in np.unique(labels)]
    return _top(table.where(F.col("label").isin(wanted)).mapInArrow(search, _FOUND), POSITIVES)


def _negatives(table: DataFrame, width: int, anchors: np.ndarray, labels: np.ndarray, windows: np.ndarray) -> DataFrame:
    """key (anchor, window), score, vec_id, row and rank; windows: (anchor, low, high), whose
    order is the key. Zone maps choose the files to read first, then each file's blocks."""
    of, low_score, high_score = windows.T

    def wanted(label: int, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        down, up = bounds(anchors, low, high)
        return np.flatnonzero((labels[of] != label) & (up[of] >= np.maximum(low_score, least)) & (down[of] <= high_score))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, least = set(), np.full(len(of), _NONE)
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(batch.schema.get_field_index("file"))[i].as_py()
                if name not in files and len(wanted(*_zone(batch, i), least)):
                    files.add(name)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(files), pa.string())], names=["file"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(of), NEGATIVES)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = wanted(*_zone(batch, i), best.least)
                if not len(keys):
                    continue
                ids, rows, vectors = _payload(batch, i, width)
                need, back = np.unique(of[keys], return_inverse=True)
                scores = products(anchors[need], vectors)
                best.offer(keys, scores[back], low_score[keys], high_score[keys], ids, rows)
        yield _batch(best.settle())
        give_back()

    zones = table.select("label", "low", "high", F.input_file_name().alias("file"))
    files = [r["file"] for r in zones.mapInArrow(choose, "file string").distinct().collect()]
    spark = table.sparkSession
    chosen = spark.read.schema(table.schema).parquet(*files) if files else spark.createDataFrame([], table.schema)
    return _top(chosen.mapInArrow(search, _FOUND), NEGATIVES)


def mined(rows: DataFrame, anchor: Column | None = None, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows for which anchor (a condition on vec_id) holds, by default those
    whose id is divisible by ANCHOR_EVERY. Scores are whole-number inner products, higher ones
    come first, ties by the smaller vec_id. An anchor's positives are its first POSITIVES
    other rows of the same label; of each, the first NEGATIVES rows of other labels with a
    score from LEAST_PERCENT to MOST_PERCENT of the positive's are returned, all if they are fewer.

    Rows without an id, a label or a whole finite vector take no part. Vectors of unequal
    length are filled up with zeros. Rows that share an id are rows of their own: an
    anchor that is there twice is answered twice and can be its copy's positive. An empty table,
    or one without anchors, gives no rows; other columns are left out."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard_negatives")
    table, width = blocks(quantised(rows, id, vector, label), scratch)
    some = scratch.keep(_anchors(table, width, anchor if anchor is not None else F.col("vec_id") % ANCHOR_EVERY == 0))
    made = [_of_group(table, width, group, scratch) for group in _groups(some)]
    if not made:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _anchors(table: DataFrame, width: int, chosen: Column) -> DataFrame:
    """row (number), vec_id, label and vector of the anchors, in the order of the blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, vectors = _payload(batch, i, width)
                label = batch.column(batch.schema.get_field_index("label"))[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids), pa.array(np.full(len(ids), label)), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["row", "vec_id", "label", "vector"])

    return table.mapInArrow(unpack, "row long, vec_id long, label long, vector binary").where(chosen)


def _groups(anchors: DataFrame) -> Iterator[list]:
    """Neighbouring anchors, ANCHOR_GROUP at a time; the driver holds one group and one partition."""
    group: list = []
    for row in anchors.orderBy("row").toLocalIterator():
        group.append(row)
        if len(group) == ANCHOR_GROUP:
            yield group
            group = []
    if group:
        yield group


def _of_group(table: DataFrame, width: int, group: list, scratch: Scratch) -> DataFrame:
    vectors = np.array([np.frombuffer(r["vector"], np.int64) for r in group]).reshape(len(group), width)
    labels, numbers = np.array([r["label"] for r in group]), np.array([r["row"] for r in group])
    positives = sorted(_positives(table, width, vectors, labels, numbers).collect(), key=lambda r: (r["key"], r["rank"]))
    windows = [(r["key"], -(-LEAST_PERCENT * r["score"] // 100), MOST_PERCENT * r["score"] // 100) for r in positives]
    spark = table.sparkSession
    named = [(k, group[r["key"]]["vec_id"], r["vec_id"], r["score"]) for k, r in enumerate(positives)]
    pairs = spark.createDataFrame(named, "key long, anchor_id long, positive_id long, positive_score long")
    if not windows:
        return pairs.selectExpr("anchor_id", "positive_id", "0 rank", "anchor_id negative_id", "positive_score", "positive_score negative_score")
    found = _negatives(table, width, vectors, labels, np.array(windows, np.int64))
    out = found.join(F.broadcast(pairs), "key").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return scratch.keep(out)


def shifted(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Label noise of the corpus query: rows whose vec_id is divisible by every have the next label."""
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", label.alias("label"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
