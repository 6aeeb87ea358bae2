"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from contaflux.llm import pii, unigram

from .test_operators import brute_components, near_copies, shingles


def contaminated(text, windows):
    words = "".join(c.lower() if c.isascii() else c for c in text)
    words = "".join(c if c.isalnum() or not c.isascii() else " " for c in words).split()
    hit = set()
    for w in windows:
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w:
                hit.update(range(i, i + len(w)))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    texts = near_copies(8)
    item = " ".join(f"bench{i}" for i in range(20))
    texts += [(400, None), (401, "12 34"), (402, item + " tail"), (403, "write to ana.1@mail.example.com now please friend")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("lang", F.lit("en"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t in texts if t and any(c.isalpha() for c in t)}
    components = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if components[i] == i}
    words = item.split()
    windows = [words[i : i + 13] for i in range(len(words) - 12)]
    kept = {i: t for i, t in kept.items() if not contaminated(t, windows)}
    surrogates = pii.Surrogates()
    kept = {i: pii.replaced(t, surrogates)[0] for i, t in kept.items()}
    model = unigram.Unigram(unigram.read_pieces(unigram.PIECES))

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(kept)
    assert 402 not in got and 400 not in got and 403 in got
    assert all(list(got[i]["ids"]) == model.encode(t) and got[i]["round_trip"] for i, t in kept.items())
    assert rng and shingles("a b c d e")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    keep = lambda rows: sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicated(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema), "").collect()), key=repr)
    assert keep([(1, a), (1, b), (2, b), (3, c)]) == [(1, a), (1, b), (3, c)]
    assert len(keep([(1, a), (1, a + " more"), (2, a + " else"), (2, c)])) == 2  # near copies with one id: one of them, and the other text of id 2
    assert keep([(None, a), (5, a), (None, b), (None, b), (None, None), (6, ""), (6, "")]) == sorted([(5, a), (None, b), (None, None), (6, ""), (6, "")], key=repr)


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name.startswith("Sentence") or out.columns == docs.columns


def test_repeated_rows_leave_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same text here for all of us", "en", "s", 1)] * 3 + [(2, "another text of a few words only", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.deduplicated(spark, docs, "").collect()) == [1, 2]
