"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier on character n-grams predicts each
bit. The bits' margins are decoded by loss: each codeword is charged a loss for every bit
on the wrong side of its margin, weighted by how well that bit's classifier did on the
learning sample, and the nearest codeword wins. A small lead over the second nearest
flags the text as ambiguous.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contaflux.llm.common import give_back, mixed, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The learning sample: at most so many texts of each language, the smallest by a hash of the text.
SAMPLE_PER_LANGUAGE = 400
#: At most so many languages can be learned, so that the fit stays small; more are an error.
MOST_LANGUAGES = 256
BUCKETS = 1 << 16
UNDETERMINED = "und"
#: A text is ambiguous when its probability leads the second by less than this.
LEAD = 0.2
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """languages: the learned values; codes: a row of +1 and -1 for each; weights: of each
    n-gram bucket for each bit; bit_weights: of the bits when decoding; sharpness: of the
    probabilities."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    sharpness: float


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def codewords(k: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of k classes. Up to 7 classes: every way to split
    them in two. More: columns of a Hadamard matrix of twice the size, whose rows differ in
    half of their bits."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        splits = [[1 if c == 0 else 1 - 2 * (b >> (c - 1) & 1) for c in range(k)] for b in range(1, 1 << (k - 1))]
        return np.array(splits, np.int8).T
    rows = np.array([[1]], np.int8)
    while rows.shape[0] < 2 * k:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[1 : k + 1, 1:][:, np.any(rows[1 : k + 1, 1:] != rows[1, 1:], axis=0)]


def ngram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the 1-, 2- and 3-grams of code points of a whole text, lower-cased,
    in which each run of characters that aren't letters is one blank."""
    text = f" {regex.sub(r'[^\p{L}\p{M}]+', ' ', text.lower()).strip()} "
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    grams = [mixed(points[1:-1] + np.uint64(1 << 40))]
    if len(points) >= 2:
        grams.append(mixed(points[:-1] | points[1:] << np.uint64(21) | np.uint64(2 << 42)))
    if len(points) >= 3:
        grams.append(mixed(points[:-2] | points[1:-1] << np.uint64(21) | points[2:] << np.uint64(42)))
    return (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int64)


def learn(texts: list[str], languages: list[str]) -> Model:
    """A model of (text, language) pairs; pure numpy, for a bounded sample."""
    names = sorted(set(languages))
    index = {name: i for i, name in enumerate(names)}
    codes = codewords(max(1, len(names)))
    counts = np.zeros((max(1, len(names)), BUCKETS))
    bags = []
    for text, name in zip(texts, languages, strict=True):
        bag = ngram_buckets(text)
        bags.append((bag, index[name]))
        if len(bag):  # every text counts alike, long or short
            counts[index[name]] += np.bincount(bag, minlength=BUCKETS) / len(bag)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-12)
    floor = 1e-6
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for bit in range(codes.shape[1]):
        one, other = codes[:, bit] > 0, codes[:, bit] < 0
        if one.any() and other.any():
            weights[:, bit] = np.log(shares[one].mean(axis=0) + floor) - np.log(shares[other].mean(axis=0) + floor)
    margins = np.array([margin(bag, weights) for bag, _ in bags]).reshape(len(bags), codes.shape[1])
    truth = np.array([i for _, i in bags], np.int64)
    right = (margins * codes[truth] > 0).mean(axis=0) if len(bags) else np.ones(codes.shape[1])
    bit_weights = np.maximum(right - 0.5, 0.01)
    return Model(names, codes, weights, (bit_weights / bit_weights.sum()).astype(np.float32), 8.0)


def margin(bag: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each bit a value in -1 to 1: its classifier's mean log-odds over the n-grams, squashed."""
    if not len(bag):
        return np.zeros(weights.shape[1], np.float32)
    # A long text has most buckets often: their counts, not a row of weights for each n-gram.
    mean = weights[bag].mean(axis=0) if len(bag) <= BUCKETS else (np.bincount(bag, minlength=BUCKETS) @ weights / len(bag))
    return np.tanh(1.5 * mean).astype(np.float32)


def decode(margins: np.ndarray, model: Model) -> tuple[int, float, float]:
    """The nearest codeword, its probability and its lead over the second."""
    losses = (np.maximum(0, 1 - model.codes * margins) * model.bit_weights).sum(axis=1)
    odds = np.exp(-model.sharpness * (losses - losses.min()))
    odds /= odds.sum()
    best = int(np.argmax(odds))  # ties: the first name
    second = np.partition(odds, -2)[-2] if len(odds) > 1 else 0.0
    return best, float(odds[best]), float(odds[best] - second)


def classify(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score, ambiguous); und where there is no letter or nothing was learned."""
    if not model.languages or text is None or not _LETTER.search(text):
        return UNDETERMINED, 0.0, True
    best, score, lead = decode(margin(ngram_buckets(text), model.weights), model)
    return model.languages[best], score, lead < LEAD


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from text and lang of the documents that aren't held out.

    At most per_language distinct texts of a language are taken, those whose hash is the
    smallest, so the sample is the same however the table is partitioned or its rows are
    repeated. Rows with null text or lang are no examples; with no example at all every text
    is undetermined. Every label is learned: a table with more than MOST_LANGUAGES of them
    raises ValueError, as its other documents would be named wrongly.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    distinct = labelled.select("lang", "h").distinct()
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: merge or remove labels before learning")
    rows, margin = [], 2 * per_language + 20  # about so many of each language, by a share of the hashes
    while sizes:
        wanted = F.lit(False)
        for lang, n in sizes.items():
            below = F.lit(True) if n <= margin else F.col("h") < -(2**63) + margin * 2**64 // n
            wanted |= (F.col("lang") == lang) & below
        found = labelled.where(wanted).dropDuplicates(["lang", "h"]).collect()
        have = Counter(r["lang"] for r in found)
        rows += [r for r in found if have[r["lang"]] >= min(per_language, sizes[r["lang"]])]
        sizes = {lang: n for lang, n in sizes.items() if have[lang] < min(per_language, n)}  # once in a blue moon
        margin *= 2
    texts, langs, taken = [], [], Counter()
    for row in sorted(rows, key=lambda r: (r["h"], r["lang"])):
        if taken[row["lang"]] < per_language:
            taken[row["lang"]] += 1
            texts.append(row["text"])
            langs.append(row["lang"])
    return learn(texts, langs)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row, from its whole text
    alone, and the columns named in keep as they are. A null or letterless text is ``und``
    with score 0; repeated rows stay; other columns of docs are left out."""
    names = list(dict.fromkeys(["doc_id", *keep]))
    rows = docs.select(*names, held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("__text"))
    kept = [c for c in rows.columns if c != "__text"]
    schema = StructType([rows.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches):
        for batch in pieces(batches, "__text", 1 << 20):
            found = [classify(x.as_py(), model) for x in batch.column(batch.schema.get_field_index("__text"))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "ambiguous"])
        give_back()

    return rows.mapInArrow(run, schema)
