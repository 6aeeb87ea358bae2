"""Signals of fraud in documents, each computed from what the documents, their lines, their uploads and
their vectors say; boards.anomalies() weighs them.

documents: id, tenant_id, party_id, number, file_hash, total, doc_date, nif, iban, at (of the upload) and
ip. Every signal is a frame of ids, so a document that several things speak against is found by
each of them, and none of them needs the others.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions import fiscal
from contaflux.functions.money import cents
from contaflux.operators import boards

# Fixed values of the signals.
DAY = 86_400
BURST, BURST_SECONDS = 20, 60
SIGMA, FUTURE_DAYS, PAST_YEARS = 3.0, 30, 2
#: Cosine distance to the others' centroid from which a document's structure has drifted.
DRIFT = 0.5
#: Components of vectors count in steps of one over this, so that sums don't depend on their order.
STEPS = 1 << 20
#: Vectors of a supplier that one task may take.
MOST_VECTORS = 50_000


def duplicate_numbers(documents: DataFrame) -> DataFrame:
    """Same tenant and number, different files. Blank numbers are no numbers."""
    some = documents.where(F.trim("number") != "")
    twice = some.groupBy("tenant_id", "number").agg(F.min("file_hash").alias("a"), F.max("file_hash").alias("b")).where("a <> b")
    return some.join(twice, ["tenant_id", "number"], "left_semi").select("id")


def inconsistent_tax(items: DataFrame, tolerance: int = 1) -> DataFrame:
    """Documents whose tax isn't rate times base, summed over lines (document_id, base, rate as a share,
    tax), by more than a cent a line."""
    line = items.where(F.col("base").isNotNull() & F.col("rate").isNotNull() & F.col("tax").isNotNull())
    off = line.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"), F.sum(cents(F.col("tax")) - cents(F.col("base") * F.col("rate"))).alias("off"))
    return off.where(F.abs("off") > F.col("n") * tolerance).select("id")


def unknown_ibans(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Documents with an IBAN that isn't among those known (party_id, iban) of a supplier that has some."""
    plain = known.select("party_id", fiscal.iban_plain(F.col("iban")).alias("iban")).where("iban <> ''").distinct()
    some = documents.where(F.col("iban").isNotNull()).select("id", "party_id", fiscal.iban_plain(F.col("iban")).alias("iban")).where("iban <> ''")
    return some.join(plain.select("party_id"), "party_id", "left_semi").join(plain, ["party_id", "iban"], "left_anti").select("id")


def duplicate_amounts(documents: DataFrame, seconds: int = DAY) -> DataFrame:
    """Same tenant, supplier and total within a day of each other's upload."""
    order = Window.partitionBy("tenant_id", "party_id", "c").orderBy("at", "id")
    rows = documents.where(F.col("at").isNotNull() & F.col("total").isNotNull()).select("id", "tenant_id", "party_id", cents(F.col("total")).alias("c"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    near = lambda other: F.coalesce(F.abs(F.col("at") - other) <= seconds * 1_000_000, F.lit(False))
    return rows.withColumn("near", near(F.lag("at").over(order)) | near(F.lead("at").over(order))).where("near").select("id")


def nif_missing() -> Column:
    return ~fiscal.nif_valid(F.col("nif"))


def missing_nifs(documents: DataFrame) -> DataFrame:
    return documents.where(nif_missing()).select("id")


def bursts(documents: DataFrame, most: int = BURST, seconds: int = BURST_SECONDS) -> DataFrame:
    """Uploads that make more than `most` of one address within so many seconds. Each stretch of
    that length sees itself and the one before, so an address is never gathered as a whole."""
    rows = documents.where(F.col("at").isNotNull() & F.col("ip").isNotNull()).select("id", "ip", F.unix_micros(F.col("at").cast("timestamp")).alias("t"))
    stretch = F.floor(F.col("t") / (seconds * 1_000_000))
    rows = rows.withColumn("own", stretch).withColumn("seen", F.explode(F.array(stretch, stretch + 1)))
    before = Window.partitionBy("ip", "seen").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("n", F.count("*").over(before)).where((F.col("own") == F.col("seen")) & (F.col("n") > most)).select("id")


def odd_totals(documents: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Totals more than so many deviations over what the supplier's earlier ones were, from three on."""
    return boards.supplier_outliers(documents, sigma).select("id")


def date_odd(now: datetime.date, days: int = FUTURE_DAYS, years: int = PAST_YEARS) -> Column:
    date, today = F.col("doc_date"), F.lit(now)
    return (date > F.date_add(today, days)) | (date < F.add_months(today, -12 * years))


def odd_dates(documents: DataFrame, now: datetime.date, days: int = FUTURE_DAYS, years: int = PAST_YEARS) -> DataFrame:
    return documents.where(date_odd(now, days, years)).select("id")


def round_amounts(documents: DataFrame, least: int = 2) -> DataFrame:
    """Totals without cents, where a tenant's month has several of them."""
    some = documents.where(cents(F.col("total")) % 100 == 0).withColumn("month", F.trunc("doc_date", "MM"))
    several = some.groupBy("tenant_id", "month").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return some.join(several, ["tenant_id", "month"], "left_semi").select("id")


def drifts(vectors: DataFrame, most: int = MOST_VECTORS) -> DataFrame:
    """id and distance of vectors (id, supplier, vector) to the centroid of the supplier's others: 1 less
    the cosine, rounded to six digits. The row itself isn't in its centroid, so an outlier of few doesn't
    pull it along. Suppliers with fewer than three vectors, zero centroids and null or empty
    vectors have none; components are counted in steps of 1 / STEPS."""
    some = vectors.where(F.col("supplier").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    some = some.select("id", "supplier", F.transform("vector", lambda x: F.round(x.cast("double") * STEPS).try_cast("long")).alias("v"))
    sums = some.select("supplier", F.posexplode("v").alias("i", "x")).groupBy("supplier", "i").agg(F.sum("x").alias("s"))
    centroids = sums.groupBy("supplier").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))  # as many as a vector has components
    counts = some.groupBy("supplier").agg(F.count("*").alias("n")).where("n >= 3")
    parts = F.ceil(F.col("n") / most)
    large = counts.where(F.col("n") > most).select("supplier", parts.alias("parts"))  # few: each stands for over `most` rows
    rows = some.join(F.broadcast(large), "supplier", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    stats = centroids.join(counts, "supplier").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.join(stats, ["supplier", "part"])
    rest = F.transform("s", lambda p: p["s"] - F.coalesce(F.get("v", p["i"]), F.lit(0)))
    rows = rows.withColumn("rest", rest)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "rest") / F.sqrt(dot("v", "v") * dot("rest", "rest"))
    return rows.where((dot("v", "v") > 0) & (dot("rest", "rest") > 0)).select("id", F.round(1 - cosine, 6).alias("distance"))


def signals(documents: DataFrame, items: DataFrame, known: DataFrame, vectors: DataFrame, now: datetime.date, burst: tuple[int, int] = (BURST, BURST_SECONDS), sigma: float = SIGMA, drift: float = DRIFT) -> DataFrame:
    """id and signals (names in order) of every document; ids of items and vectors that aren't documents'
    are left out. Documents that share an id share their signals."""
    own = {"MISSING_NIF": nif_missing(), "DATE_ANOMALY": date_odd(now)}
    found = {
        "DUPLICATE_NUMBER": duplicate_numbers(documents),
        "INCONSISTENT_TAX": inconsistent_tax(items),
        "IBAN_MISMATCH": unknown_ibans(documents, known),
        "DUPLICATE_AMOUNT": duplicate_amounts(documents),
        "BURST_UPLOAD": bursts(documents, *burst),
        "SUSPICIOUS_TOTAL": odd_totals(documents, sigma),
        "ROUND_AMOUNTS": round_amounts(documents),
        "STRUCTURE_DRIFT": drifts(vectors).where(F.col("distance") > drift).select("id"),
    }
    names = sorted([*own, *found])
    bit = {name: 1 << i for i, name in enumerate(names)}
    # A document's signals are the bits of one number, so rows stay small and their ids are hashed as they come.
    held = sum((F.when(c, bit[name]).otherwise(0) for name, c in own.items()), F.lit(0))
    rows = documents.select("id", held.cast("int").alias("bits"), F.lit(1).cast("long").alias("copies"))
    every = reduce(DataFrame.unionByName, (ids.select("id", F.lit(bit[name]).alias("bits"), F.lit(0).cast("long").alias("copies")) for name, ids in found.items()), rows)
    told = every.groupBy("id").agg(F.bit_or("bits").alias("bits"), F.sum("copies").alias("copies")).where("copies > 0")
    # Null ids are no ids: nothing is known of such documents.
    bits = F.when(F.col("id").isNotNull(), F.col("bits")).otherwise(0)
    told = told.select("id", bits.alias("bits"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return told.select("id", F.filter(F.array(*(F.when(F.col("bits").bitwiseAND(bit[n]) != 0, F.lit(n)) for n in names)), lambda s: s.isNotNull()).alias("signals"))
