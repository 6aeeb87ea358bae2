"""Retrieval: keyword and vector search, fusion of ranked lists, context windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions.text import chunks
from contaflux.functions.vectors import cosine, token_bucket
from contaflux.operators import fulltext

RRF = 60


def chunked(documents: DataFrame) -> DataFrame:
    """A row for each word window of a text: doc_id, chunk, content."""
    return documents.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk", "content"))


def term_vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Hashed term frequencies of texts, scaled to length 1, as sparse rows: keys, bucket, weight."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    counts = texts.select(*keys, F.explode(words).alias("word")).groupBy(*keys, token_bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias("s"))
    return counts.join(norm, keys).select(*keys, "bucket", (F.col("n") / F.sqrt("s")).alias("weight"))


def keyword_search(documents: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Documents in which every term is in some of the columns."""
    anywhere = [reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower())) for c in columns)) for t in terms]
    return documents.where(reduce(lambda a, b: a & b, anywhere, F.lit(True)))


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors with the largest cosine, ties by id."""
    score = cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    return vectors.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def fused(*ranked: DataFrame) -> DataFrame:
    """Reciprocal ranks added up by key; each input has key and rank (from 0)."""
    rows = reduce(DataFrame.unionByName, (r.select("key", "rank") for r in ranked))
    return rows.groupBy("key").agg(F.round(F.sum(1 / (RRF + F.col("rank") + 1)), 9).alias("score"), F.count("*").alias("lists"))


def context(results: DataFrame, most_tokens: int) -> DataFrame:
    """Snippets (rank, content) in order, repeats by their first 100 characters left out, up
    to the first that would overflow four characters a token. Results are a short ranked list."""
    once = results.withColumn("r", F.row_number().over(Window.partitionBy(F.left("content", F.lit(100))).orderBy("rank"))).where("r = 1").drop("r")
    running = F.sum(F.length("content")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("used", running).where(F.col("used") <= 4 * most_tokens)


def money_stats(texts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Of the amounts in each text (1.234,56 or 1234,56, with or without a currency after it): how
    many, their sum, least, largest and upper median. A text without any has no row."""
    found = texts.select(id_column, F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\d.,])(\d{1,3}(?:\.\d{3})+,\d{2}|\d+,\d{2})(?!\d)"), F.lit(1))).alias("a"))
    c = F.replace(F.replace("a", F.lit("."), F.lit("")), F.lit(","), F.lit("")).cast("long")
    counts = found.select(id_column, c.alias("c")).groupBy(id_column, "c").agg(F.count("*").alias("k"))
    order = Window.partitionBy(id_column).orderBy("c")
    rows = counts.withColumns({"upto": F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy(id_column))})
    euro = lambda x: x / F.lit(100.0)
    return rows.groupBy(id_column).agg(
        F.first("n").alias("n"), euro(F.sum(F.col("c") * F.col("k"))).alias("total"), euro(F.min("c")).alias("least"), euro(F.max("c")).alias("most"), euro(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("c")))).alias("median")
    )


def search_vector(*columns: Column) -> Column:
    """The words of a row for full-text search: lower case, distinct, in order."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def web_query(query: str) -> list[list[list[str]]]:
    """fulltext.parsed() as lists: alternatives of terms, each a list of words that stand in a row; an
    excluded word begins with a dash."""
    return [[[f"-{w}" if term.excluded else w for w in term.words] for term in a] for a in fulltext.parsed(query).alternatives]


def full_text(rows: DataFrame, query: str, vector: str, columns: list[str]) -> DataFrame:
    """rows that the query finds in their words (vector: in order), or that hold it as it is in one
    of the columns (any case), with rank. Large tables are better searched by fulltext.written()."""
    return fulltext.search_rows(rows, query, F.col(vector), columns)


def ranked(*lists: DataFrame) -> DataFrame:
    """One list of several (each with key and rank), a later one after an earlier one; ranks run on
    from 0. The lists are those that searches return, so they are short."""
    rows = reduce(DataFrame.unionByName, (r.select("key", "rank", F.lit(i).alias("list")) for i, r in enumerate(lists)))
    return rows.withColumn("rank", (F.row_number().over(Window.orderBy("list", "rank", "key")) - 1).cast("long")).drop("list")


def fused_top(k: int, *lists: DataFrame) -> DataFrame:
    return fused(*lists).orderBy(F.desc("score"), "key").limit(k)
