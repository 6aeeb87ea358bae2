"""Toxicity of texts by a weighted lexicon.

Texts and lexicon are folded alike: compatibility forms and case, letters of other scripts that
look like Latin ones, digits and signs that stand for letters. The folded words of a text are
matched by an Aho-Corasick automaton against the lexicon, whose entries are words or
beginnings of words (of several at one place the longest counts), and against exception
phrases, inside which nothing counts. The sum of the weights and the number of words
give the score by a logistic function.

Entries, weights, exceptions and the function are learned from labelled texts: a beginning
is an entry if it is surely commoner in toxic texts and no shorter one says as much.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contaflux.llm.common import Scratch, give_back, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: At most so many labelled texts a label are learned from, those whose ids have the smallest hashes.
MOST_EXAMPLES = 20_000
#: From this score on a text is predicted to be toxic.
THRESHOLD = 0.3
#: Lengths of the beginnings of words that can be entries; shorter words are entries as a whole only.
SHORTEST, LONGEST = 4, 12
#: An entry is in so many (text, word) pairs of toxic texts at least, and its log-odds, less DOUBT
#: standard errors, are LEAST_ODDS at least.
LEAST_FOUND, LEAST_ODDS, DOUBT = 4, 1.2, 1.64
#: A phrase around an entry is an exception from so many clean texts on, if toxic texts have it rarely.
LEAST_EXCEPTIONS = 3
MOST_ENTRIES = 8192  # entries, and exceptions, that a model holds: the surest ones

# Look-alikes and the Latin letters they stand for.
LOOK_ALIKES = """
аa вb еe ёe зe іi їi јj кk мm нh оo рp сc тt уy хx ѕs ԁd ԛq ԝw һh ӏl ґr бb пn
αa βb γy εe ηn ιi κk μu νv οo ρp σo τt υu χx ωw
ɑa ɡg ɩi ɪi ʀr ʏy ʟl ɴn ʜh ʙb ɢg ıi ſs ƅb ƽs ʋv ոn օo սu հh ցg զq ɾr ʂs ȷj
"""
DIGITS = "0o 1i 3e 4a 5s 7t 8b 9g"
SIGNS = "$s @a !i |i €e £l"
# l, i and 1 can't be told apart in disguise, so they fold to one letter.
SAME = "li"

_ALIKE = {ord(p[0]): p[1] for p in LOOK_ALIKES.split()}
_DIGIT = {ord(p[0]): p[1] for p in DIGITS.split()}
_SIGN = {p[0]: p[1] for p in SIGNS.split()}
_SIGNED = re.compile(r"[$@€£](?=[$@€£!|]*[^\W_])|(?<=[^\W_])[!|](?=[^\W_])")
_NUMBERED = re.compile(r"[^\W\d_]+\d[^\W_]*|\d+[^\W\d_][^\W_]*")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str | None) -> list[str]:
    """The folded words of a text, in order. Accents stay; signs count as letters before or between
    letters only, digits only in words that have a letter."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_ALIKE)
        text = unicodedata.normalize("NFC", text)
    else:
        text = text.lower()
    text = _SIGNED.sub(lambda m: _SIGN[m[0]], text)
    text = _NUMBERED.sub(lambda m: m[0].translate(_DIGIT), text)
    return _WORD.findall(text.replace(SAME[0], SAME[1]))


@dataclass
class Model:
    """entries: folded pattern (a blank, then a beginning; a blank after it ends a whole word) and its
    weight; exceptions: folded phrases with a blank at each end; odds: of a text by the
    columns of features()."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    odds: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for pattern in self.exceptions:
            out.add_word(pattern, (len(pattern), None))
        for pattern, weight in self.entries.items():
            if pattern not in out:
                out.add_word(pattern, (len(pattern), weight))
        if len(out):
            out.make_automaton()
        return out


def hits(words: list[str], automaton) -> dict[int, tuple[str | None, float]]:
    """For each place in the blank-joined words where the lexicon matches: (length, weight) of the
    longest entry, without what begins inside an exception phrase."""
    if not len(automaton) or not words:
        return {}
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif length > found.get(start, (0, 0.0))[0]:
            found[start] = (length, weight)
    for start, end in spared:
        for at in [at for at in found if start <= at < end]:
            del found[at]
    return found


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1, the log of the summed weight, and the log of the weight a hundred words; a text without
    hits is the same at every length."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / (words + 10))], axis=1)


def score(weight: np.ndarray, words: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(weight, words) @ np.array(model.odds), -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document aren't learned from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = MOST_EXAMPLES) -> DataFrame:
    """(text, toxic) to learn from: distinct texts with a label 0 or 1 that aren't held out, at
    most about `most` a label, by the smallest hashes of their ids, so that how
    the tables are cut doesn't matter. Null texts are no examples."""
    some = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).distinct()
    sizes = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    wanted = F.lit(False)
    for label, n in sizes.items():
        wanted |= (F.col("toxic") == label) & (F.lit(True) if n <= most else F.col("h") < -(2**63) + most * 2**64 // n)
    ids = scratch.keep(some.where(wanted).select("__id", "toxic"))  # bounded by 2 * most, and so fit to be broadcast
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    return scratch.keep(rows.select("text", "toxic").dropDuplicates(["text", "toxic"]))


def _odds(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of being in a toxic text, and their lower bound."""
    odds = np.log((c1 + 0.5) / n1) - np.log((c0 + 0.5) / n0)
    return odds, odds - DOUBT * np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))


def chosen(counts: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """The entries out of (pattern, pairs in toxic texts, pairs in clean texts).

    Of patterns that nest, a shorter one gives way to a longer one that is found nearly as often
    (it is more precise), and a longer one to a shorter one that is as sure."""
    if not counts:
        return {}
    names = [c[0] for c in counts]
    c1, c0 = np.array([c[1] for c in counts]), np.array([c[2] for c in counts])
    odds, sure = _odds(c1, c0, max(n1, 1), max(n0, 1))
    fit = {names[i]: (int(c1[i]), float(odds[i]), float(sure[i])) for i in np.flatnonzero((c1 >= LEAST_FOUND) & (sure >= LEAST_ODDS))}
    beginnings = lambda name: (name[:k] for k in range(SHORTEST + 1, len(name)) if name[:k] in fit)
    worse = set()
    for name, (found, _, surely) in fit.items():
        for shorter in beginnings(name):
            if not name.endswith(" ") and found >= 0.9 * fit[shorter][0]:
                worse.add(shorter)
    for name, (_, _, surely) in fit.items():
        if any(shorter not in worse and fit[shorter][2] >= surely - 0.3 for shorter in beginnings(name)):
            worse.add(name)
    kept = sorted((n for n in fit if n not in worse), key=lambda n: (-fit[n][2], n))[:MOST_ENTRIES]
    return {n: fit[n][2] for n in kept}  # their weights are the lower bounds: what is found seldom says little


def calibrated(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Odds of Model by Newton's method, with a slight pull towards 0."""
    order = np.lexsort((toxic, words, weight))  # sums that don't depend on how the rows came
    weight, words, toxic = weight[order], words[order], toxic[order]
    x = features(weight, words)
    beta, pull = np.zeros(3), np.diag([1e-6, 0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (toxic - p) - pull @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(3), gradient)
        beta += step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _mapped(rows: DataFrame, row, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """row(words, toxic) gives tuples for each example."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            made = [m for text, toxic in zip(batch.column(0), batch.column(1), strict=True) for m in row(folded(text.as_py()), toxic.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=names)
        give_back()

    return rows.select("text", "toxic").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = (), entries: dict[str, float] | None = None, most: int = MOST_EXAMPLES) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic) whose ids aren't held out.

    exceptions are phrases inside which nothing counts, entries are words with weights that
    are added to those learned. A row of labels that is neither 0 nor 1, or null, is no
    example; a document with both labels is an example of each. Without examples of both kinds
    nothing is learned: only the entries passed count, and a text without them scores near 0."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = examples(docs, labels, scratch, most)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    given = {f" {' '.join(folded(word))} ": weight for word, weight in (entries or {}).items() if folded(word)}
    spared = [f" {' '.join(folded(phrase))} " for phrase in exceptions if folded(phrase)]
    if not n1 or not n0:
        if not given:
            warnings.warn("no labelled texts of both kinds: every text scores 0", stacklevel=2)
        return Model(given, spared, (-5.0, 2.0, 2.0) if given else (-20.0, 0.0, 0.0))
    per_text = _mapped(known, lambda words, toxic: [(word, toxic) for word in set(words)], "word string, toxic int", [pa.string(), pa.int32()])
    of_words = scratch.keep(per_text.groupBy("word").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0")))
    length = F.length("word")
    lengths = F.sequence(F.lit(SHORTEST), F.least(length, F.lit(LONGEST)))
    open_ended = F.transform(F.when(length >= SHORTEST, lengths).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit(" "), F.substring("word", F.lit(1), k)))
    patterns = of_words.select(F.explode(F.concat(open_ended, F.array(F.concat(F.lit(" "), "word", F.lit(" "))))).alias("pattern"), "c1", "c0")
    counted = patterns.groupBy("pattern").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).where(F.col("c1") >= LEAST_FOUND)
    surest = counted.where(F.log((F.col("c1") + 0.5) / n1) - F.log((F.col("c0") + 0.5) / n0) >= LEAST_ODDS).orderBy(F.desc("c1"), "pattern").limit(8 * MOST_ENTRIES)
    learned = chosen([tuple(r) for r in surest.collect()], n1, n0)
    model = Model(learned | given, spared)
    model.exceptions = sorted({*spared, *_exceptions(known, model, n1, n0)})

    automaton = None

    def summed(words: list[str], toxic: int) -> list[tuple]:
        nonlocal automaton
        automaton = automaton or model.automaton()
        return [(math.fsum(w for _, w in hits(words, automaton).values()), len(words), toxic)]

    rows = _mapped(known, summed, "weight double, words long, toxic int", [pa.float64(), pa.int64(), pa.int32()]).toPandas()
    model.odds = calibrated(rows["weight"].to_numpy(), rows["words"].to_numpy(), rows["toxic"].to_numpy())
    return model


def _exceptions(known: DataFrame, model: Model, n1: int, n0: int) -> list[str]:
    """Words and pairs of words around entries that clean texts have, and toxic ones no more often."""
    automaton = None

    def around(words: list[str], toxic: int) -> list[tuple]:
        nonlocal automaton
        automaton = automaton or model.automaton()
        starts, place = {}, 0
        for k, word in enumerate(words):
            starts[place] = k
            place += len(word) + 1
        found = set()
        for at in hits(words, automaton):
            k = starts[at]
            found |= {(k, k + 1), (max(k - 1, 0), k + 1), (k, min(k + 2, len(words)))}
        return [(phrase, toxic) for phrase in {f" {' '.join(words[a:b])} " for a, b in found}]

    phrases = _mapped(known, around, "phrase string, toxic int", [pa.string(), pa.int32()])
    counted = phrases.groupBy("phrase").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    rare = counted.where((F.col("c0") >= LEAST_EXCEPTIONS) & (F.log((F.col("c1") + 0.5) / n1) <= F.log((F.col("c0") + 0.5) / n0)))
    return [r["phrase"] for r in rare.orderBy(F.desc("c0"), "phrase").limit(MOST_ENTRIES).collect()]


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and n_hits of every row, from its whole text alone.

    A null or empty text has no words and gets the score of a text without hits; repeated rows
    stay, a null doc_id stays null and isn't held out, other columns are left out."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("__text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_words long, n_hits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in pieces(batches, "__text"):
            made = []
            for text in batch.column(2):
                words = folded(text.as_py())
                found = hits(words, automaton)
                made.append((math.fsum(w for _, w in found.values()), len(words), len(found)))
            weight, n_words, n_hits = (np.array(x) for x in zip(*made, strict=True))
            scores = score(weight, n_words, model)
            columns = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array(n_words, pa.int64()), pa.array(n_hits, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "score", "predicted", "n_words", "n_hits"])
        give_back()

    return rows.mapInArrow(run, schema)
