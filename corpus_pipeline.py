"""From raw documents to token ids, in five stages, each written as Parquet and read again.

Language ID drops what has no language, the n-gram join keeps one document of each group of
near-duplicates, decontamination drops what holds benchmark passages, surrogates replace
personal data, and the unigram encoder turns what is left into ids. Each stage works on
all rows of its input, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contaflux.llm import decontam, langid, ngram_join, pii, unigram
from contaflux.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected as ambiguous when even its best language is less likely than this.
LEAST_SCORE = 0.4
#: Keys of rows to drop are broadcast up to this number (16 bytes each), else joined by a shuffle.
MOST_BROADCAST = 1 << 20


def without(docs: DataFrame, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs whose (doc_id, hash of the text) is not in dropped (doc_id, th)."""
    dropped = scratch.keep(dropped.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct())
    few = dropped.count() <= MOST_BROADCAST
    same = docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__t"))
    return docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null and letterless texts, and texts that fit no learned language.
    With no labelled row to learn from nothing is rejected but texts without a letter."""
    model = langid.fit(docs)
    named = langid.predict(docs.select(COLUMNS).withColumn("body", F.col("text")), model, keep=("body", "lang", "source", "n_chars"))
    if not model.languages:
        return docs.select(COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    kept = named.where((F.col("lang_pred") != langid.UNDETERMINED) & ~(F.col("ambiguous") & (F.col("score") < LEAST_SCORE)))
    return kept.select("doc_id", F.col("body").alias("text"), "lang", "source", "n_chars")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the smallest doc_id's (null only if there is no other),
    of its texts the one with the smallest hash, of rows with that id and text the least.
    Rows are told apart by id and text, so texts that share an id are judged each by itself.
    Rows without words stay."""
    scratch = Scratch(spark, "deduplicated")
    found = scratch.keep(ngram_join.linked(docs).where("n_shingles > 0").select("doc_id", F.col("text_hash").alias("th"), "component_id", "component"))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Only ids that come again can lead a component with several texts or rows.
    repeated = scratch.keep(found.where(own).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__i")))
    few = repeated.count() <= MOST_BROADCAST
    first = found.where(own).join(F.broadcast(repeated) if few else repeated, F.col("doc_id").eqNullSafe(F.col("__i")), "left_semi")
    first = scratch.keep(first.groupBy("component", "doc_id", "th").count())
    best = first.groupBy("component").agg(F.min("th").alias("best"), F.count("*").alias("texts")).where("texts > 1")
    others = first.join(best, "component").where(F.col("th") != F.col("best"))
    kept = without(docs.select(COLUMNS), found.where(~own).select("doc_id", "th").unionByName(others.select("doc_id", "th")), scratch)
    again = first.where("count > 1").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"))
    if again.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    one = kept.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
    return kept.join(again, same, "left_anti").unionByName(one.select("doc_id", "text", "r.lang", "r.source", "r.n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows hit too large a share."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    bad = decontam.hits(rows, table(spark, sf_dir, "benchmark"), keep=("th",)).where("contaminated")
    return without(docs.select(COLUMNS), bad, Scratch(spark, "decontaminated"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text; n_chars follows the new text (null: null)."""
    return pii.masked(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, round_trip and ids."""
    return unigram.tokenized(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "n_pieces", "round_trip", "ids")


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonymised),
    ("SentencePiece encoding and decoding", encoded),
]
#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
