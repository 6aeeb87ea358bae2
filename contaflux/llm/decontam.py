"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Words are maximal runs of letters a-z (A-Z lower-cased), digits and characters beyond
ASCII. Every item of the benchmark is cut into windows of ``WINDOW`` consecutive words (an
item of fewer words is one window). A window is contained where a document has all its
words in a row, so any one word is a sufficient prefix: the rarest, by its count in all
documents, is the window's anchor. Documents meet windows at their anchors only; the
anchor's place in the window and the number of words before and after it bound what can
match; then the words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contaflux.llm.common import Scratch

WINDOW = 13
#: Contaminated: at least one word in SHARE is hit.
SHARE = 20
#: Windows up to this number are broadcast (at most some hundred bytes each); more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Slots of the table that tells quickly which words can't be anchors.
SLOTS = 1 << 16
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order, null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size and window (array of words) of every window; items without words have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice("w", i, WINDOW))
    return items.select("item_id", F.explode(F.array_distinct(cut)).alias("window")).select("item_id", F.size("window").alias("size"), "window")


def anchored(every: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """A row for each distinct window: window, size, items, anchor (its rarest word in docs,
    ties to the first in order) and before (how many words precede it)."""
    distinct = every.groupBy("window", "size").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    vocabulary = every.select(F.explode("window").alias("word")).distinct()
    seen = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = seen.join(F.broadcast(vocabulary) if few else vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = distinct.select("window", "size", "items", F.posexplode("window").alias("before", "word"))
    ranked = ranked.join(F.broadcast(counts) if few else counts, "word", "left").groupBy("window", "size", "items")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "before")).alias("best")
    # A word that no document has rules the window out.
    return ranked.agg(best).where("best.n > 0").select("window", "size", "items", F.col("best.word").alias("anchor"), F.col("best.before").alias("before"))


def hits(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs,
    and the columns named in keep as they are.

    A word inside any occurrence of a window is hit; items with occurring windows are
    counted once; contaminated means n_hit > 0 and SHARE * n_hit >= n_words. Null and
    wordless texts have zeros and the digest of the empty string. Repeated rows stay;
    items with null or wordless text have no windows; an empty benchmark hits nothing.
    """
    every = windows(benchmark)
    few = every.count() <= MOST_BROADCAST
    marks = Scratch(docs.sparkSession, "anchors").keep(anchored(every, docs, few)) if few else anchored(every, docs, few)
    rows = docs.select("doc_id", *[c for c in keep if c != "doc_id"], words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    own = ["row", "doc_id", *[c for c in keep if c != "doc_id"]]

    at = F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    if few:
        # A fixed table of slots, looked up by a word's hash, spares most words the join.
        table = bytearray(SLOTS)
        for r in marks.select(F.pmod(F.xxhash64("anchor"), F.lit(SLOTS)).alias("s")).distinct().collect():
            table[r["s"]] = 1
        at = F.filter(at, lambda x: F.substring(F.lit(bytes(table)), (F.pmod(F.xxhash64(x["word"]), F.lit(SLOTS)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01"))
    around = F.transform(
        at,
        lambda x: F.struct(
            x["word"].alias("word"),
            x["at"].alias("at"),
            F.greatest(x["at"] - (WINDOW - 1), F.lit(0)).alias("first"),
            F.slice("w", F.greatest(x["at"] - (WINDOW - 1), F.lit(0)) + 1, 2 * WINDOW - 1).alias("context"),
        ),
    )
    spots = rows.select(*own, F.size("w").cast("long").alias("n_words"), F.explode_outer(around).alias("x"))
    spots = spots.select(*own, "n_words", "x.word", "x.at", "x.first", "x.context")
    side = F.broadcast(marks) if few else marks
    start = F.col("at") - F.col("before")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.slice("context", start - F.col("first") + 1, F.col("size")) == F.col("window")
    # The bounds guard the slice: it starts inside the context wherever they hold.
    found = spots.join(side, F.when(fits, same).otherwise(F.lit(False)) & (F.col("word") == F.col("anchor")), "left")
    run = F.when(F.col("window").isNotNull(), F.struct(start.alias("a"), (start + F.col("size")).alias("b")))
    grouped = found.groupBy(*own).agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(run)).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")),
        lambda s: s["n"],
    )
    out = grouped.select(*own[1:], "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(v) AS size, array_to_string(v, ' ') AS k
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i:i + 12])) AS v FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
cut AS (
  SELECT row, size, unnest(range(1, CAST(len(w) AS BIGINT) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size),
hit AS (
  SELECT row, i, c.size, item_id FROM (SELECT row, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM cut) c JOIN win ON c.k = win.k AND c.size = win.size),
spread AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM hit) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spread USING (row) LEFT JOIN items USING (row)
"""
