"""Document fingerprints by one-permutation MinHash.

Each distinct word shingle is hashed once. The high bits of the hash choose one of ``BINS``
bins and the smallest hash of a bin is kept. An empty bin borrows from a bin found by
probing with a hash of (its number, attempt) until a full one is met (optimal
densification), so equal bins are filled alike in every document. Of each kept hash only
``BITS`` low bits are stored, packed as hexadecimal digits; the likeness of two
fingerprints is the share of equal bins, corrected for the chance that low bits agree.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contaflux.llm.common import SHINGLE_WORDS, mixed, pieces, shingle_hashes, utf8, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256  # a power of two; 64 at least
BITS = 4  # one hexadecimal digit each
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprint(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The low bits of each bin's smallest hash; empty for a text without words."""
    if not len(shingles):
        return np.zeros(0, np.uint8)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (shingles >> shift).astype(np.int64), shingles)
    full = np.zeros(bins, bool)
    full[(shingles >> shift).astype(np.int64)] = True
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        attempt += 1
        probe = (mixed(empty.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)
        met = full[probe]
        least[empty[met]] = least[probe[met]]
        empty = empty[~met]
    return (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(bits: np.ndarray) -> str:
    return _DIGITS[bits].tobytes().decode()


def unpacked(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.where(raw >= 97, raw - 87, raw - 48).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """An estimate of the Jaccard similarity of the shingle sets, 0 to 1. Shingles are a
    vanishing share of all 64-bit values, so unequal minima agree in their low bits with
    chance 2 ** -BITS. Two texts without words are alike (1), one such text is unlike all others (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 1 / (1 << BITS)
    return float(max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def of_texts(texts: pa.Array, bins: int = BINS, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    return [fingerprint(hashes, bins) for hashes in shingle_hashes(*word_hashes(*utf8(texts)), k)]


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column of the packed fingerprint of text (null and wordless: empty string).
    A column of that name is replaced; repeated rows stay."""
    rows = docs.drop(name)
    schema = StructType(list(rows.schema.fields)).add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            marks = [packed(f) for f in of_texts(batch.column(batch.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """text whose last half (of its code points, rounded down) gave way to as many of the first of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, rows_a_place: int = 2000, most_places: int = 5000) -> DataFrame:
    """Rows (place, late, k, doc_id, text) sorted within partitions, in which the next row
    of every document is the next row of its place.

    A place is a range of doc_id that holds about rows_a_place rows. Its last row needs the
    first row of the next place: those first rows, one a place, are added with late = 1
    to the place before. The cuts between places come from a narrow scan of doc_id, so the
    texts are shuffled once, and no task or driver holds more than a few of them.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    places = max(1, min(most_places, count // rows_a_place))
    found = rows.agg(F.percentile_approx("k", [i / places for i in range(1, places)] or [0.5], 20_000)).first()[0] or []
    cuts = np.array(sorted(set(found)) if places > 1 else [], np.int64)

    @F.pandas_udf("int")
    def place_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "left").astype(np.int32))

    firsts = rows.select("k").withColumn("place", place_of("k")).groupBy("place").agg(F.min("k").alias("k")).collect()
    firsts = sorted((r["place"], r["k"]) for r in firsts)
    heads = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]  # of the place before; of the first: the last
    wanted = docs.sparkSession.createDataFrame(heads, "place int, head long")
    late = rows.join(F.broadcast(wanted), F.col("k") == F.col("head")).groupBy("place", "k", "doc_id").agg(F.min("text").alias("text"))
    late = late.select("place", F.lit(1).alias("late"), "k", "doc_id", "text")
    every = rows.select(place_of("k").alias("place"), F.lit(0).alias("late"), "k", "doc_id", "text")
    return every.unionByName(late).repartition("place").sortWithinPartitions("place", "late", "k", "text")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every row of docs.

    The next document is the next row in ascending (doc_id, text), null ids first; after the
    last comes the first. A single row is its own next document, an empty table gives no
    rows, repeated rows stay, a null text counts as empty, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one has not come yet: place, doc_id, text, fingerprint
        for batch in pieces(batches, "text"):
            place, late, _, ids, column = (batch.column(i) for i in range(5))
            rows = list(zip(place.to_pylist(), late.to_pylist(), ids.to_pylist(), column.to_pylist(), of_texts(column), strict=True))
            pairs = []
            for here, is_late, doc_id, text, bits in rows:
                if held is not None:
                    pairs.append((held, text, bits))
                held = None if is_late else (here, doc_id, text, bits)
            changed = [edited(row[2], text) for row, text, _ in pairs]
            marks = of_texts(pa.array(changed, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[1] for row, _, _ in pairs], pa.int64()),
                    pa.array([len(row[2]) for row, _, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                    pa.array([packed(row[3]) for row, _, _ in pairs], pa.string()),
                    pa.array([packed(m) for m in marks], pa.string()),
                    pa.array([likeness(row[3], m) for (row, _, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                    pa.array([likeness(row[3], bits) for row, _, bits in pairs], pa.float64()),
                ],
                names=[f.split()[0] for f in EDITS.split(", ")],
            )

    return in_order(docs).mapInArrow(run, EDITS)
