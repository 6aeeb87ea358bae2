"""Full-text search against a plain reading of the query, on rows and on a written index."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from contaflux.operators import fulltext


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(query, text):
    """(found, rank) by looking at every place of every word."""
    words, q = plain_words(text), fulltext.parsed(query)
    at = {w: [i for i, x in enumerate(words) if x == w] for w in q.words}
    row = lambda t: any(words[i : i + len(t.words)] == list(t.words) for i in range(len(words)))
    found = any(all(row(t) != t.excluded for t in a) for a in q.alternatives)
    if not q.together:
        return found, sum(0.1 / 1.64493406685 * sum(1 / (j + 1) ** 2 for j in range(min(len(p), 256))) for p in at.values()) / max(1, len(at))
    missing = 1.0
    for i, a in enumerate(q.words):
        for b in q.words[:i]:
            for x in at[a][:256]:
                for y in at[b][:256]:
                    if 0 < abs(x - y) <= 100:
                        missing *= 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
    return found, 1 - missing


QUERIES = ["aa", "aa bb", '"aa bb"', '"aa bb aa"', "aa or bb cc", "-aa", "aa -bb", 'aa -"bb cc"', '"aa bb" or "cc dd" -ee', "aa-bb", "AA Bb", "or aa or", "zz", '"aa bb', "", '"" - ', "aa aa", "-aa or bb", '"aa aa"']


def test_parsed():
    term = fulltext.Term
    assert fulltext.parsed('FT-12 "a b" -c or -"d e" OR or').alternatives == ((term(("ft", "12")), term(("a", "b")), term(("c",), True)), (term(("d", "e"), True),))
    assert fulltext.parsed(None).alternatives == fulltext.parsed(' "" - ').alternatives == ()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    made = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "AA", "éé"]) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(120)]
    rows = list(enumerate([*made, None, "", " ,;", "aa, bb. aa", "aa-bb_cc", "aabb"]))
    return rows, spark.createDataFrame(rows, "id long, text string").withColumn("word", F.lit("x")).withColumn("doc", F.lit(1)).withColumn("at", F.lit(2))


@pytest.fixture(scope="module")
def index(spark, texts):
    return fulltext.written(texts[1], "id", F.col("text"), folders=7)


@pytest.mark.parametrize("query", QUERIES)
def test_search_matches_plain(texts, index, query):
    rows, df = texts
    want = {i: round(plain(query, t)[1], 5) for i, t in rows if plain(query, t)[0]}
    assert {r["doc"]: round(r["rank"], 5) for r in index.search(query).collect()} == pytest.approx(want, abs=2e-5)
    got = fulltext.search_rows(df, query, fulltext.words(F.col("text"))).collect()
    assert {r["id"]: r["rank"] for r in got} == pytest.approx(want, abs=2e-5)


def test_only_the_querys_postings_are_read(spark, index):
    rows = index.postings(["aa", "zz"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and re.search(r"PushedFilters: \[[^\]]*In\(word", plan)
    assert {r["word"] for r in rows.collect()} == {"aa"} and index.postings([]).count() == 0


def test_literal_columns_pages_and_reopening(spark, texts, index):
    rows = spark.createDataFrame([(1, "Fatura FT 2026/1", None), (2, "x", "PT50%_1"), (3, None, "nada")], "id int, name string, note string")
    find = lambda q: sorted(r["id"] for r in fulltext.search_rows(rows, q, fulltext.words(F.col("name")), ["name", "note"]).collect())
    assert find("t50%_") == [2] and find("ATURA") == [1] and find("2026/1") == [1] and find(" ") == []
    found = fulltext.opened(spark, index.path, 7).search("aa").withColumnRenamed("doc", "id")
    whole = [r["id"] for r in found.orderBy(F.desc("rank"), F.desc("id")).collect()]
    assert [r["id"] for r in fulltext.page(found, 2, 10, "-id").collect()] == whole[10:20]
    assert fulltext.page(found, 99, 10).count() == 0 and len(fulltext.page(found, 0, 5, "id").collect()) == 5


def test_odd_ids_and_long_texts(spark):
    rows = spark.createDataFrame([(None, "aa"), (1, "aa bb"), (1, "bb aa"), (2, "aa " * 30000)], "id int, text string")
    index = fulltext.written(rows, "id", F.col("text"), folders=3)
    assert {r["doc"] for r in index.search("aa").collect()} == {1, 2}
    assert index.documents().count() == 3
    assert index.search('"aa aa aa"').count() == 1
    empty = fulltext.written(rows.limit(0), "id", F.col("text"))
    assert empty.search("aa").count() == 0 and empty.search("-aa").count() == 0


def test_a_document_is_grouped_where_it_lies():
    import pyarrow as pa

    many = [["b", "a", "b"], [], ["a"], *([["x", "y", "x"]] * 300)]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(many)), pa.int64()), "w": pa.array(many, pa.list_(pa.string()))})
    got = [tuple(r.values()) for out in fulltext.grouped(iter([batch])) for r in out.to_pylist()]
    assert sorted(got) == [(0, "a", [1]), (0, "b", [0, 2]), (2, "a", [0]), *(r for i in range(3, 303) for r in ((i, "x", [0, 2]), (i, "y", [1])))]
