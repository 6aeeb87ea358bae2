"""Periodic runs, hard negatives and toxicity against brute force, held-out labels and odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contaflux.llm import hard_negatives, periodic, toxicity
from contaflux.llm.common import Scratch, table
from tests.llm.test_operators import ODD, documents, words_of

SF = "/root/testdata/sf0.001"

# 11


def plain_runs(words, least=12):
    """Every period tried at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rng = random.Random(5)
    for _ in range(700):
        k = rng.choice([1, 2, 3, 4, 30])
        words = [rng.randrange(k) for _ in range(rng.randint(0, 90))]
        if words and rng.random() < 0.6:
            p, a = rng.randint(1, 12), rng.randrange(len(words))
            words = words[:a] + (words[a : a + p] * 40)[: rng.randint(1, 50)] + words[a:]
        for least in (12, 5, 2):
            assert periodic.runs(words, least) == plain_runs(words, least)


def test_runs_of_long_texts_end():
    rng = random.Random(6)
    a, b = [0], [0, 1]
    while len(b) < 30000:
        a, b = b, b + a
    for words, n in [([1] * 60000, 1), ([1, 2] * 30000, 1), ([x for i in range(9000) for x in (1, 2, 3, 4, 5, 6, 100 + i)], 0), ([rng.randrange(2) for _ in range(30000)], None), (b, None)]:
        found = periodic.runs(words)
        assert n is None or len(found) == n
        for start, length, period in found[:50]:
            assert words[start : start + length - period] == words[start + period : start + length]


def plain_digests(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_digests_of_a_whole_table(spark):
    docs = table(spark, SF, "documents").where(F.length("text") < 6000)  # the plain way takes the square of a text
    got = sorted(map(tuple, periodic.run_digests(docs).collect()))
    assert got == sorted(plain_digests(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def test_runs_of_odd_tables(spark):
    loop = "x y z " * 5
    docs = documents(spark, [*ODD, (None, loop), (20, "a b " * 12), (21, loop + "end"), (21, loop + "end")], runs="q", start="s", n_runs="r")
    got = sorted(map(tuple, periodic.run_digests(docs).collect()), key=repr)
    assert got == sorted((plain_digests(i, t) for i, t in [*ODD, (None, loop), (20, "a b " * 12), (21, loop + "end"), (21, loop + "end")]), key=repr)
    texts = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in periodic.collapsed(docs).collect()}
    assert texts[21] == ("x y z end", 12) and texts[1] == texts[2] == texts[3] == ("", 0) and texts[None] == ("x y z", 12)
    found = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]]) for r in periodic.found(docs).collect()}
    assert found[21] == (16, [(0, 15, 3)]) and found[9] == (3000, [(0, 3000, 1)])
    assert periodic.run_digests(docs.limit(0)).count() == 0


# 12


def plain_negatives(rows):
    """rows: (vec_id, vector, label); every pair is scored."""
    some = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in some), default=0)
    some = [(i, np.pad(v, (0, width - len(v))), label) for i, v, label in some]
    out = []
    for a, (i, v, label) in enumerate(some):
        if i % 100:
            continue
        scores = sorted(((-int(v @ w), j, other) for b, (j, w, other) in enumerate(some) if b != a))
        for score, j, _ in [s for s in scores if s[2] == label][:5]:
            fit = [s for s in scores if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:10]
            out += [(i, j, k + 1, s[1], -score, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_hilbert_curve_steps_to_neighbours():
    for dimensions, bits in [(2, 4), (3, 2), (5, 2)]:
        points = np.array(np.meshgrid(*[range(2**bits)] * dimensions)).reshape(dimensions, -1).T
        places = hard_negatives.hilbert(points, bits)
        assert sorted(places) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    block, anchors = rng.integers(-300, 300, (50, 9)), rng.integers(-300, 300, (20, 9))
    low, high = hard_negatives.bounds(anchors, block.min(axis=0), block.max(axis=0))
    scores = hard_negatives.products(anchors, block)
    assert (scores == anchors @ block.T).all() and (scores >= low[:, None]).all() and (scores <= high[:, None]).all()


@pytest.mark.parametrize("hot", [False, True])
def test_negatives_match_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_GROUP", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.2, (6, 8))
    rows = []
    for i in range(1500):
        c = int(rng.integers(6)) if not hot else int(rng.integers(18)) % 6 if rng.random() < 0.5 else 0
        rows.append((i, (centres[c] + rng.normal(0, 0.1, 8)).astype(np.float32).tolist(), c))
    rows += [(k, rows[200][1], 3) for k in range(5000, 5040)]  # ties
    rows += [(9000, None, 1), (9100, [1.0, None], 1), (9200, [float("nan")] * 8, 1), (9300, [float("inf")] * 8, 1), (9400, [0.5] * 8, None), (None, [0.5] * 8, 1), (9500, [], 2), (9600, [0.3, 0.2], 2)]
    docs = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).withColumn("block", F.lit(1)).withColumn("score", F.lit(2)).repartition(3)
    assert sorted(map(tuple, hard_negatives.mined(docs).collect())) == plain_negatives(rows)


def test_zone_maps_leave_files_unread(spark):
    """Of blocks far from an anchor's windows none is needed, whatever order the rows came in."""
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(4)[i % 4] * (1 if i % 8 < 4 else -1) + rng.normal(0, 0.01, 4)).tolist(), i % 2) for i in range(4000)]
    scratch = Scratch(spark, "test")
    blocks, width = hard_negatives.blocks(hard_negatives.quantised(spark.createDataFrame(rows, VECTORS)), scratch, 100)
    anchor, needed = np.array([[256, 0, 0, 0]]), []
    for row in blocks.collect():
        low, high = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
        needed.append(hard_negatives.bounds(anchor, low, high)[1][0] >= 0.3 * 256 * 256)
    assert width == 4 and 0 < sum(needed) < len(needed) / 2


def test_negatives_of_odd_tables(spark):
    twice = [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (7, [0.6, 0.3], 2), (8, [0.6, 0.3], 2)]
    docs = spark.createDataFrame(twice, VECTORS)
    got = sorted(map(tuple, hard_negatives.mined(docs).collect()))
    assert got == plain_negatives(twice) and len(got) == 4  # each copy has the other as its positive
    assert hard_negatives.mined(docs.limit(0)).count() == 0
    assert hard_negatives.mined(docs.where("vec_id < 100")).count() == 0
    assert hard_negatives.mined(docs.where("label = 1")).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mined(spark.createDataFrame([(0, [3e30], 1)], VECTORS))


# 13


def test_folding():
    assert toxicity.folded("ID10T ldiot іdiot idiоt $cum m0ron!! ｍoron c|own stüpid 1999 a@b") == ["idiot", "idiot", "idiot", "idiot", "scum", "moron", "moron", "ciown", "stüpid", "1999", "aab"]
    assert toxicity.folded(None) == toxicity.folded("") == toxicity.folded("$$$ !!") == []
    assert toxicity.folded("word$$$ to%%%") == ["word", "to"]


def test_longest_entry_and_exceptions():
    model = toxicity.Model({" sc": 1.0, " scum": 3.0, " foui ": 2.0}, [" scum fiiter "])
    automaton = model.automaton()
    found = lambda text: sorted(w for _, w in toxicity.hits(toxicity.folded(text), automaton).values())
    assert found("Scums and scars, foul fouls") == [1.0, 2.0, 3.0]
    assert found("the scum filter of scum") == [3.0] and found("unscum") == [] and found("") == []


def labelled(spark, n=800, seed=8):
    rng = random.Random(seed)
    bad = ["grobian", "trottel", "halunke"]
    rows, labels = [], []
    for i in range(n):
        words = words_of(rng, rng.randint(5, 120)).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(2 + len(words) // 40 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        if not toxic and rng.random() < 0.12:
            words.insert(0, "halunke filmtitel")
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    return documents(spark, rows, score="x", toxic=7, held_out="y"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_labels(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert {" grobian", " trottei", " haiunke"} <= {e.rstrip() for e in model.entries} and any("fiimtitei" in e for e in model.exceptions)
    both = toxicity.scored(docs, model).join(labels, "doc_id").collect()
    assert {r["held_out"] for r in both} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in both)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in both)
    assert np.mean([r["predicted"] == r["toxic"] for r in both if r["held_out"]]) >= 0.98
    disguised = documents(spark, [(1, words_of(random.Random(1), 30) + " Gr0b1an TRОTTEL! h@lunke"), (2, words_of(random.Random(2), 30)), (3, None), (4, ""), (5, "word " * 60000), (5, "word " * 60000)])
    got = {r["doc_id"]: r for r in toxicity.scored(disguised, model).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4, 5)] == [1, 0, 0, 0, 0] and got[1]["n_hits"] == 3
    assert toxicity.scored(disguised, model).count() == 6


def test_labels_held_out_teach_nothing(spark):
    docs, labels = labelled(spark, 300)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs.repartition(5), other)


def test_odd_labels(spark):
    docs, labels = labelled(spark, 40)
    odd = spark.createDataFrame([(None, 0, 1), (1, 0, None), (2, 0, 5)], labels.schema)
    with pytest.warns(UserWarning):
        nothing = toxicity.fit(docs, odd)
    assert toxicity.scored(docs, nothing).agg(F.max("score")).first()[0] < 0.01
    with pytest.warns(UserWarning):
        assert toxicity.fit(docs.limit(0), labels).entries == {}
    given = toxicity.fit(docs, odd, exceptions=["filmtitel"], entries={"Tr0ttel": 2.0})
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(documents(spark, [(1, "du Trottel"), (2, "guten Tag")]), given).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.scored(docs.limit(0), given).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark, 600)
    known = toxicity.examples(docs, labels, Scratch(spark, "test"), most=40)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    assert 15 <= sizes[0] <= 80 and 15 <= sizes[1] <= 80
