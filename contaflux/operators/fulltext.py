"""Full-text search with positions: a written inverted index, web-style queries, and ranks.

The index has a row for each word and document with all the word's positions. It is written once,
in folders by a hash of the word and sorted by word inside, so a query reads its own words' postings
only; a frequent word's postings are spread over several files by document.

A query is what people type: words that must all be there, ``"words in a row"``, ``or`` between
alternatives, and a dash before what must not be there. Words are what letters and digits
make up; what is typed as one piece (``FT-12``) must stand in a row as well.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contaflux.sources.shared import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[\p{L}\p{N}]+"
ROWS = 256  # whose words are put together at a time
FOLDERS = 64  # of an index, by a hash of the word
SPLITS = 8  # files of a folder, by a hash of the document
# The usual weight of a word without a label, the positions of a word that a rank looks at,
# the distance from which two words are strangers, and the limit of 1 + 1/4 + 1/9 + ...
WEIGHT, RANKED, FAR, LIMIT = 0.1, 256, 100, 1.64493406685


def words(text: Column) -> Column:
    """The words of a text in order, lower case. Null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass(frozen=True)
class Term:
    """Words that stand in a row, wanted or not."""

    words: tuple[str, ...]
    excluded: bool = False


@dataclass(frozen=True)
class Query:
    """Alternatives, of each of which every term must hold."""

    alternatives: tuple[tuple[Term, ...], ...]

    @property
    def words(self) -> list[str]:
        return sorted({w for a in self.alternatives for t in a for w in t.words})

    @property
    def together(self) -> bool:
        """Whether words are ranked by how near they stand: in one alternative of several words."""
        return len(self.alternatives) == 1 and len(self.words) > 1 and not (len(self.alternatives[0]) == 1 and self.alternatives[0][0].excluded)

    @property
    def needs_all(self) -> bool:
        """Whether an alternative has no wanted term, so that documents without any of the words match."""
        return any(all(t.excluded for t in a) for a in self.alternatives)


def parsed(query: str | None) -> Query:
    """A query as typed. An ``or`` that has nothing before or after it is left out; an unclosed quote
    ends with the query; a query without words matches nothing."""
    out: list[list[Term]] = [[]]
    for dash, quoted, word in re.findall(r'(-?)(?:"([^"]*)(?:"|$)|([^\s"]+))', (query or "").lower()):
        if word == "or" and not dash:
            out.append([])
            continue
        found = tuple(w for w in re.split(r"[\W_]+", quoted or word) if w)
        if found:
            out[-1].append(Term(found, bool(dash)))
    return Query(tuple(tuple(a) for a in out if a))


def positions(sequence: Column, word: str) -> Column:
    """The positions, from 0, of a word in a row's words; null where there is none."""
    at = F.filter(F.transform(sequence, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, at)


def in_a_row(term: Term, at: Callable[[str], Column]) -> Column:
    """Whether the term's words stand in a row somewhere. Null positions are no position."""
    first = at(term.words[0])
    if len(term.words) == 1:
        return first.isNotNull()
    starts = [_earlier(at(w), k) for k, w in enumerate(term.words) if k]
    both = reduce(F.array_intersect, starts, first)
    return F.coalesce(F.size(both) > 0, F.lit(False)) & first.isNotNull()


def _earlier(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def holds(query: Query, at: Callable[[str], Column]) -> Column:
    one = lambda t: ~in_a_row(t, at) if t.excluded else in_a_row(t, at)
    every = [reduce(lambda a, b: a & b, (one(t) for t in a)) for a in query.alternatives]
    return reduce(lambda a, b: a | b, every, F.lit(False)) if every else F.lit(False)


def rank(query: Query, at: Callable[[str], Column]) -> Column:
    """How well a row fits, by the first RANKED positions of each word.

    Words that needn't stand together count each by itself, WEIGHT * (1 + 1/4 + 1/9 ...) for
    its occurrences, over how many words the query has. Words that must all be there count by
    pairs: each pair of places up to FAR words apart makes up a part of what is missing to 1,
    the nearer the more. Rounded to six digits."""
    known = query.words
    first = {w: F.slice(F.coalesce(at(w), F.array().cast("array<int>")), 1, RANKED) for w in known}
    if not known:
        return F.lit(0.0)
    if not query.together:
        series = [F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0.0), lambda s, j: s + 1.0 / (j * j)) for p in first.values()]
        sums = [F.when(F.size(p) > 0, s).otherwise(0.0) for p, s in zip(first.values(), series, strict=True)]
        return F.round(reduce(lambda a, b: a + b, sums) * (WEIGHT / LIMIT / len(known)), 6)
    missing = F.lit(0.0)
    for i, one in enumerate(known):
        for other in known[:i]:
            missing = missing + _apart(first[one], first[other])
    return F.round(F.lit(1.0) - F.exp(missing), 6)


def _apart(one: Column, other: Column) -> Column:
    """The sum over near pairs of places of log(1 - closeness)."""
    closeness = lambda d: F.sqrt(WEIGHT * WEIGHT / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    near = lambda p: F.filter(other, lambda q: (F.abs(p - q) <= FAR) & (p != q))
    return F.aggregate(one, F.lit(0.0), lambda s, p: s + F.aggregate(near(p), F.lit(0.0), lambda t, q: t + F.log1p(-closeness(F.abs(p - q).cast("double")))))


# On rows as they are -------------------------------------------------------------------


def search_rows(rows: DataFrame, query: str, sequence: Column, literal: list[str] | None = None) -> DataFrame:
    """The rows whose words (sequence: in order) the query finds, or that hold it as typed in one
    of the literal columns (any case), with rank. Reads every row: for a table that has no index."""
    q = parsed(query)
    at = lambda w: positions(F.col("__words"), w)
    contains = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(query.strip().lower())) for c in literal or []]
    found = reduce(lambda a, b: a | b, contains, holds(q, at)) if query.strip() else F.lit(False)
    return rows.withColumn("__words", sequence).where(found).withColumn("rank", rank(q, at)).drop("__words")


# On a written index --------------------------------------------------------------------


@dataclass
class Index:
    """A written index: path has the postings, and the documents with how many words each has."""

    spark: SparkSession
    path: str
    folders: int

    def postings(self, some: list[str]) -> DataFrame:
        """word, doc and at of those words only: other folders aren't opened, and inside a folder
        files are sorted by word, so what lies outside their pages isn't read."""
        rows = self._postings()
        if not some:
            return rows.limit(0)
        folders = self.spark.range(1).select(*(_folder(F.lit(w), self.folders).alias(f"f{i}") for i, w in enumerate(some))).first()
        return rows.where(F.col("folder").isin(sorted({int(f) for f in folders})) & F.col("word").isin(some)).select("word", "doc", "at")

    def all_postings(self) -> DataFrame:
        """word, doc and at (places, from 0, in order) of the whole index."""
        return self._postings().select("word", "doc", "at")

    def _postings(self) -> DataFrame:
        """An index of no words has no files to tell its columns, so they are named."""
        kind = self.documents().schema["doc"].dataType.simpleString()
        return self.spark.read.schema(f"word string, doc {kind}, at array<int>, folder int").parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        """doc and n_words of every document, wordless ones included."""
        return self.spark.read.parquet(f"{self.path}/documents")

    def search(self, query: str) -> DataFrame:
        """doc and rank of the documents that the query finds. Only a query with an alternative that
        wants nothing (``-word``) looks at documents without any of its words."""
        q = parsed(query)
        column = {w: f"p{i}" for i, w in enumerate(q.words)}
        at = lambda w: F.col(column[w])
        rows = self.postings(q.words).groupBy("doc").agg(F.lit(True).alias("has"), *(F.first(F.when(F.col("word") == w, F.col("at")), ignorenulls=True).alias(c) for w, c in column.items()))
        if q.needs_all:
            rows = self.documents().select("doc").join(rows, "doc", "left")
        return rows.where(holds(q, at)).select("doc", rank(q, at).alias("rank"))


def _folder(word: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(folders)).cast("int")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, word and at of each row (doc, w: its words in order). A row has all of its document, so its
    words are put together where it lies, some rows at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            lists = batch.column("w")
            of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            place = np.arange(len(of)) - np.searchsorted(of, of)
            coded = pc.list_flatten(lists).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((place, code, of))
            of, place, code = of[order], place[order], code[order]
            first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
            at = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), pa.array(place, pa.int32()))
            columns = [batch.column("doc").take(pa.array(of[first])), coded.dictionary.take(pa.array(code[first])), at]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "word", "at"])


def written(rows: DataFrame, id: str, text: Column, path: str | None = None, folders: int = FOLDERS) -> Index:
    """Writes the index of rows (a document each, ids unique and not null) and opens it.

    A row of the index is one word of one document, so neither a frequent word nor a long text
    is gathered beyond the positions of a word in a text. Documents without an id are left out.
    Of rows that share an id the index has the words of all of them, each from its own start."""
    spark = rows.sparkSession
    path = path or shared_folder(spark, "fulltext")
    docs = rows.where(F.col(id).isNotNull()).select(F.col(id).alias("doc"), text.alias("text"))
    n_words = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD))
    docs.select("doc", n_words.cast("long").alias("n_words")).write.parquet(f"{path}/documents")
    index = Index(spark, path, folders)
    kind = docs.schema["doc"].dataType.simpleString()
    postings = docs.select("doc", words(F.col("text")).alias("w")).mapInArrow(grouped, f"doc {kind}, word string, at array<int>")
    placed = postings.withColumns({"folder": _folder(F.col("word"), folders), "split": F.pmod(F.xxhash64("doc"), F.lit(SPLITS))}).repartition("folder", "split")
    if not index.documents().groupBy("doc").count().where("count > 1").isEmpty():
        # Only ids that come again have a word in several rows, which already lie together.
        placed = placed.groupBy("folder", "split", "word", "doc").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    placed.sortWithinPartitions("folder", "word", "doc").select("word", "doc", "at", "folder").write.partitionBy("folder").parquet(f"{path}/postings")
    return Index(spark, path, folders)


def opened(spark: SparkSession, path: str, folders: int = FOLDERS) -> Index:
    """An index written before, by as many folders."""
    return Index(spark, path, folders)


def page(found: DataFrame, number: int, size: int, *ties: str) -> DataFrame:
    """A page of what was found, best rank first, then by the columns named (a dash: downwards)."""
    order = [F.desc(t[1:]) if t.startswith("-") else F.col(t) for t in ties]
    return found.orderBy(F.desc("rank"), *order).offset((max(1, number) - 1) * size).limit(size)
