"""Stretches of words that repeat with a period (runs), by maximal pairs in an LCP-interval tree.

Two equal stretches of words, i..i+L and i+q..i+q+L, that neither the words before nor the words
after them extend are a maximal pair. Where their distance q is at most L they touch or
overlap, so i..i+q+L has period q and nothing extends it: such pairs are the runs, one
for each multiple of the period that fits, and nothing needs to be extended word by word.

For each text, suffixes are sorted by doubling, which also tells their common prefixes. The
LCP-interval tree is walked bottom-up without being built; an interval carries its
positions in lists by the word to the left. Where two children meet, each position of the
smaller one looks for positions of the larger one within the interval's depth and with
another word to the left (the right-hand words differ, as the children do). As a run of
``least`` words has a pair of at least half as many equal words, only positions whose
next ``least / 2`` words occur twice in the text take part.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.llm.common import give_back, mixed, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Runs of fewer words are left alone.
LEAST_WORDS = 12
Run = tuple[int, int, int]  # start, length, period
Node = tuple[list[int], dict[int, list[int]]]  # sorted positions, and the same by the word to the left


def repeated(ids: np.ndarray, width: int) -> np.ndarray:
    """The positions whose next width words may occur elsewhere too (told by a hash, so none is missed)."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    words = mixed(ids.astype(np.uint64) + np.uint64(1))
    hashes = words[:n].copy()
    for j in range(1, width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words; equal where these are equal.
    The last ranks are all different. Only suffixes that aren't told apart yet are sorted again."""
    n = len(ids)
    kind = np.int32 if n < 2**31 - 1 else np.int64
    active, rank, key = np.arange(n), np.zeros(n, np.int64), ids.astype(np.int64)
    levels, width = [], 1
    while len(active):
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], rank[active[order]]
        at = np.arange(len(active))
        first = np.ones(len(active), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.astype(kind))
        alone = first.copy()
        alone[:-1] &= first[1:]
        active = active[~alone]
        after = np.full(len(active), -1)
        inside = active + width < n
        after[inside] = rank[active[inside] + width]
        key = rank[active] * (n + 1) + after + 1
        width *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes a and b have in common, pair by pair."""
    n, start, a, b = len(levels[0]), a, a.copy(), b.copy()
    for j in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = levels[j][a[same]] == levels[j][b[same]]
        a[same] += 1 << j
        b[same] += 1 << j
    return a - start


def meet(one: Node, other: Node, depth: int, left: list[int], least: int, found: dict[tuple[int, int], int]) -> Node:
    """Adds to found the maximal pairs between two children of an interval that are runs, and
    gives the union of the children. The smaller one is looked up in the larger one, by
    the positions in reach or by the classes of the word to the left, whichever are fewer."""
    if len(one[0]) < len(other[0]):
        one, other = other, one
    positions, classes = one
    for i in other[0]:
        own = left[i]
        a, b = bisect_left(positions, i - depth), bisect_right(positions, i + depth)
        if b - a <= len(classes):
            near = [j for j in positions[a:b] if left[j] != own]
        else:
            near = [j for word, at in classes.items() if word != own for j in at[bisect_left(at, i - depth) : bisect_right(at, i + depth)]]
        for j in near:
            period = abs(i - j)
            if depth + period >= least:
                run = (min(i, j), depth + period)
                if period < found.get(run, period + 1):  # of the multiples of a period the smallest stays
                    found[run] = period
    for i in other[0]:
        insort(positions, i)
        insort(classes.setdefault(left[i], []), i)
    return one


def runs(words: list, least: int = LEAST_WORDS) -> list[Run]:
    """(start, length, smallest period) of every stretch of words that has the period, at least
    twice and over least words or more, and that no neighbouring word extends; sorted by
    start, then period."""
    known: dict = {}
    ids = np.fromiter(map(known.setdefault, words, count()), np.int64, len(words))
    shortest = max(1, (least + 1) // 2)
    some = repeated(ids, shortest)
    if len(some) < 2:
        return []
    levels = suffix_ranks(ids)
    order = some[np.argsort(levels[-1][some], kind="stable")]
    depths = common_prefixes(levels, order[:-1], order[1:])
    del levels
    left = [-1, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, Node]] = []
    for i, depth in zip(order.tolist(), [*depths.tolist(), 0], strict=True):
        node: Node = ([i], {left[i]: [i]})
        while stack and stack[-1][0] >= depth:
            inner, child = stack.pop()
            node = meet(child, node, inner, left, least, found)
        if depth >= shortest:
            stack.append((depth, node))
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[Run]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def looped(doc_id: int | None, words: list) -> list:
    """The planted repetition of the corpus query: every tenth document, by the CRC-32 h of its
    id, goes on from word g % n (g = h // 10) with a loop of at least three periods."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * ((n - a) // p + 1))[: n - a]


def _each(docs: DataFrame, columns: list[tuple[str, pa.DataType, str]], row: Callable, edit: Callable | None, least: int) -> DataFrame:
    """For each document its doc_id and row(words, runs); texts go through in pieces of bounded bytes."""
    rows = docs.select("doc_id", F.col("text").alias("__text"))
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{name} {sql}" for name, _, sql in columns)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            ids, texts = batch.column(0), batch.column(1)
            made = []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes split at 0x20 and 0x09 to 0x0D
                if edit:
                    words = edit(ids[i].as_py(), words)
                made.append(row(words, runs(words, least)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[k] for m in made], kind) for k, (_, kind, _) in enumerate(columns))], names=["doc_id", *(c[0] for c in columns)])
        give_back()

    return rows.mapInArrow(apply, schema)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def found(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words and runs (start, length, period; in words) of every text of docs.

    Words are what ASCII white space separates. A null or empty text has no words and no runs;
    repeated rows stay, a null doc_id stays null, other columns are left out. A document is
    one row of one task, so a task holds the ranks of its longest text."""
    kinds = [("n_words", pa.int64(), "long"), ("runs", pa.list_(_RUN), "array<struct<start:long,length:long,period:long>>")]
    return _each(docs, kinds, lambda words, got: (len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in got]), None, least)


def collapsed(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text and n_dropped: each text with every run cut down to its first period, words
    joined by one blank. Null and empty texts become empty."""
    kinds = [("text", pa.string(), "string"), ("n_dropped", pa.int64(), "long")]

    def row(words, got):
        kept = collapse(words, got)
        return b" ".join(kept).decode("utf-8", "surrogatepass"), len(words) - len(kept)

    return _each(docs, kinds, row, None, least)


def run_digests(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Of every document, with the planted loops of looped(): n_runs; start, length, period and
    exponent_milli of the longest run (ties: the smallest start, then period; nulls without
    a run); runs_sha256 over `start,length,period` and a line feed of every run, and
    collapsed_sha256 over the collapsed text. Null and empty texts have no run and the
    digests of nothing; repeated rows stay."""
    kinds = [(c, pa.int64(), "long") for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    kinds += [(c, pa.string(), "string") for c in ("runs_sha256", "collapsed_sha256")]

    def row(words, got):
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in got)
        texts = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, got))).hexdigest()
        if not got:
            return 0, None, None, None, None, *texts
        start, length, period = min(got, key=lambda r: (-r[1], r[0], r[2]))
        return len(got), start, length, period, 1000 * length // period, *texts

    return _each(docs, kinds, row, looped, least)
