"""Boards, forecasts and key figures: deals, payables, bank movements, payroll, outliers."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions.money import ANOMALY_WEIGHTS, EMPLOYEE_SHARE, EMPLOYER_SHARE, cents, risk_action, risk_level, withholding_rate

#: Stages in order, with their default probability in percent. Fixed values.
STAGES = [("LEAD", 20), ("QUALIFIED", 40), ("PROPOSAL", 60), ("NEGOTIATION", 80), ("WON", 100), ("LOST", 0)]
OPEN = ["TO_PAY", "SCHEDULED", "OVERDUE"]


def stages(spark) -> DataFrame:
    return spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(STAGES)], "place int, stage string, probability int")


def pipeline_stats(deals: DataFrame) -> DataFrame:
    """count, value and weighted value of every stage; stages without deals have zeros."""
    dimension = stages(deals.sparkSession)
    sums = deals.groupBy("stage").agg(F.count("*").alias("n"), F.sum(cents(F.col("value"))).alias("c"))
    sums = F.broadcast(dimension).join(sums, "stage", "left")
    c = F.coalesce("c", F.lit(0))
    return sums.select("place", "stage", F.coalesce("n", F.lit(0)).alias("deals"), (c / F.lit(100.0)).alias("total"), (F.floor(c * F.col("probability") / 100 + 0.5) / F.lit(100.0)).alias("weighted"))


def board_tops(deals: DataFrame, n: int = 3) -> DataFrame:
    """The n largest deals of each stage but LOST, ties by id."""
    order = Window.partitionBy("stage").orderBy(F.desc("value"), "id")
    return deals.where("stage <> 'LOST'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("stage", "rank", "id", "value")


def forecast(deals: DataFrame, start: datetime.date, months: int = 6) -> DataFrame:
    """Open deals by expected month from start on: count, value and weighted value, empty months with zeros."""
    spark = deals.sparkSession
    dimension = F.create_map(*(F.lit(x) for s, p in STAGES for x in (s, p)))
    first = start.replace(day=1)
    keys = [f"{first.year + (first.month - 1 + i) // 12}-{(first.month - 1 + i) % 12 + 1:02d}" for i in range(months)]
    open_ = deals.where(~F.col("stage").isin("WON", "LOST")).withColumn("month", F.date_format("expected", "yyyy-MM")).where(F.col("month").isin(keys))
    weighted = F.sum(F.floor(F.col("value") * F.element_at(dimension, F.col("stage")) + 0.5).cast("long"))
    sums = open_.groupBy("month").agg(F.count("*").alias("n"), F.sum(cents(F.col("value"))).alias("c"), weighted.alias("w"))
    every = spark.createDataFrame([(k,) for k in keys], "month string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.broadcast(every).join(sums, "month", "left").select("month", zero("n").alias("deals"), (zero("c") / F.lit(100.0)).alias("total"), (zero("w") / F.lit(100.0)).alias("weighted"))


def win_rate(deals: DataFrame) -> DataFrame:
    won, lost = F.count_if(F.col("stage") == "WON"), F.count_if(F.col("stage") == "LOST")
    return deals.agg(won.alias("won"), lost.alias("lost"), F.when(won + lost > 0, F.floor(won * 10000 / (won + lost) + 0.5) / F.lit(10000.0)).otherwise(0.0).alias("win_rate"))


def payables_open(payables: DataFrame, today: datetime.date) -> DataFrame:
    """Sums of open and overdue payables over all of them."""
    rows = payables.where(F.col("status").isin(OPEN))
    late = (F.col("status") == "OVERDUE") | (F.col("due_date") < F.lit(today))
    return rows.agg(F.count("*").alias("n"), (F.sum(cents(F.col("amount"))) / F.lit(100.0)).alias("total"), (F.sum(F.when(late, cents(F.col("amount"))).otherwise(0)) / F.lit(100.0)).alias("overdue"))


def payables_by_party(payables: DataFrame) -> DataFrame:
    open_ = F.when(F.col("status").isin(OPEN), cents(F.col("amount"))).otherwise(0)
    return payables.groupBy("party_id").agg(F.count("*").alias("n"), (F.sum(open_) / F.lit(100.0)).alias("open_total"), F.min("due_date").alias("first_due"))


def bank_flow(transactions: DataFrame) -> DataFrame:
    """Money in, money out and net by tenant."""
    c = cents(F.abs("amount"))
    inn, out = F.sum(F.when(F.col("amount") > 0, c).otherwise(0)), F.sum(F.when(F.col("amount") < 0, c).otherwise(0))
    return transactions.groupBy("tenant_id").agg((inn / F.lit(100.0)).alias("money_in"), (out / F.lit(100.0)).alias("money_out"), ((inn - out) / F.lit(100.0)).alias("net"))


def document_counts(documents: DataFrame) -> DataFrame:
    return documents.where("status <> 'ARQUIVADO'").groupBy("type").agg((F.sum(cents(F.col("total"))) / F.lit(100.0)).alias("total"), F.count_if(F.col("status").isin("NOVO", "EM_REVISAO")).alias("to_review"), F.count("*").alias("n"))


def payroll_lines(employees: DataFrame) -> DataFrame:
    """Withholding, social security of both sides and net pay, half-up to cents in decimals."""
    gross = F.col("gross").cast("decimal(12,2)")
    two = lambda x: F.round(x, 2).cast("decimal(12,2)")
    rate = withholding_rate(F.col("gross").cast("double")).cast("decimal(5,4)")
    rows = employees.select("id", "period", gross.alias("gross"), two(gross * rate).alias("tax"), two(gross * F.lit(str(EMPLOYEE_SHARE)).cast("decimal(5,4)")).alias("employee"), two(gross * F.lit(str(EMPLOYER_SHARE)).cast("decimal(5,4)")).alias("employer"))
    return rows.withColumn("net", (F.col("gross") - F.col("tax") - F.col("employee")).cast("decimal(12,2)"))


def payroll_totals(employees: DataFrame) -> DataFrame:
    names = ["gross", "tax", "employee", "employer", "net"]
    return payroll_lines(employees).groupBy("period").agg(F.count("*").alias("n"), *(F.sum(c).cast("decimal(18,2)").alias(c) for c in names))


def outliers(documents: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Documents further than so many population deviations from their party's mean; parties
    of under three documents, or without spread, have none. Sums of cents keep the
    moments exact, so engines agree."""
    c = cents(F.col("total"))
    moments = documents.groupBy("party_id").agg(F.count("*").alias("n"), F.sum(c).cast("decimal(38,0)").alias("s"), F.sum(c.cast("decimal(18,0)") * c.cast("decimal(18,0)")).alias("q"))
    n, s, q = F.col("n"), F.col("s").cast("double"), F.col("q").cast("double")
    spread = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    moments = moments.where("n >= 3").select("party_id", (s / n).alias("mean"), spread.alias("spread")).where("spread > 0")
    z = (cents(F.col("total")) - F.col("mean")) / F.col("spread")
    return documents.join(moments, "party_id").withColumn("z", z).where(F.abs("z") > sigmas).select("id", "party_id", "total", F.round("z", 3).alias("z"))


def pages(rows: DataFrame, order: list, page: int, limit: int) -> DataFrame:
    """One page of an ordered list; order should end in a unique column."""
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def probability(stage: Column, override: Column, stages_json: Column) -> Column:
    """A deal's probability: what was set, within 0 to 100, else the pipeline's stage (a JSON array of
    key and defaultProbability), else the canonical stage's; null for an unknown stage."""
    listed = F.from_json(stages_json, "array<struct<key:string,defaultProbability:int>>")
    own = F.get(F.filter(listed, lambda s: s["key"] == stage), F.lit(0))["defaultProbability"]
    table = F.create_map(*(F.lit(x) for pair in STAGES for x in pair))
    return F.coalesce(F.when(override.isNotNull(), F.least(F.greatest(override, F.lit(0)), F.lit(100))), own, F.try_element_at(table, stage))


def stage_list(stages_json: Column) -> Column:
    """A pipeline's stages as structs: keys in capitals, labels (else the key), probabilities (else the
    canonical stage's, else 0), in their order, and the canonical stages that are missing after them."""
    listed = F.from_json(stages_json, "array<struct<key:string,label:string,defaultProbability:int>>")
    table = F.create_map(*(F.lit(x) for pair in STAGES for x in pair))
    made = F.transform(F.filter(F.coalesce(listed, F.array().cast("array<struct<key:string,label:string,defaultProbability:int>>")), lambda s: F.coalesce(s["key"], F.lit("")) != ""), lambda s: F.struct(F.upper(s["key"]).alias("key"), F.coalesce(s["label"], s["key"]).alias("label"), F.coalesce(s["defaultProbability"], F.try_element_at(table, F.upper(s["key"])), F.lit(0)).alias("probability")))
    missing = F.transform(F.array_except(F.array(*(F.lit(s) for s, _ in STAGES)), F.transform(made, lambda s: s["key"])), lambda k: F.struct(k.alias("key"), k.alias("label"), F.element_at(table, k).alias("probability")))
    return F.concat(made, missing)


def expense_total(expenses: DataFrame, year: int) -> DataFrame:
    """The sum of a year's expenses that were not rejected."""
    return expenses.where((F.col("status") != "REJECTED") & (F.year("date") == year)).agg((F.coalesce(F.sum(cents(F.col("amount"))), F.lit(0)) / F.lit(100.0)).alias("total"))


def supplier_outliers(documents: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Documents whose total is over the mean of the party's earlier ones by more than so many
    population deviations; it needs three earlier ones that differ."""
    before = Window.partitionBy("party_id").orderBy("doc_date", "id").rowsBetween(Window.unboundedPreceding, -1)
    c = cents(F.col("total")).cast("decimal(18,0)")
    rows = documents.withColumns({"n": F.count("*").over(before), "s": F.sum(c).over(before), "q": F.sum((c * c).cast("decimal(38,0)")).over(before)})
    n, s, q = F.col("n"), F.col("s").cast("double"), F.col("q").cast("double")
    spread = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    return rows.where((F.col("n") >= 3) & (spread > 0) & (cents(F.col("total")) - s / n > sigmas * spread)).select("id", "party_id", "total")


def same_total(documents: DataFrame, seconds: int = 86_400) -> DataFrame:
    """documents (id, party_id, total, at: a timestamp) with n: how many of the party have the same
    total within the seconds up to then, itself included."""
    order = Window.partitionBy("party_id", cents(F.col("total"))).orderBy(F.unix_seconds(F.col("at").cast("timestamp"))).rangeBetween(-seconds, 0)
    return documents.withColumn("n", F.count("*").over(order))


def anomalies(signals: DataFrame) -> DataFrame:
    """(id, score, level, action, clean) of documents (id, signals: an array of names): a signal counts once."""
    weights = F.create_map(*(F.lit(x) for pair in ANOMALY_WEIGHTS.items() for x in pair))
    score = F.aggregate(F.array_distinct("signals"), F.lit(0), lambda a, s: a + F.coalesce(F.try_element_at(weights, s), F.lit(0)))
    level = risk_level(score)
    return signals.select("id", score.alias("score"), level.alias("level"), risk_action(level).alias("action"), (F.size("signals") == 0).alias("clean"))


def anomaly_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("scanned"), F.count_if("clean").alias("clean"), F.count_if(~F.col("clean")).alias("flagged"))


def account_sums(journal: DataFrame) -> DataFrame:
    """Debit and credit of each account, summed in cents."""
    total = lambda c: (F.sum(cents(F.col(c))) / F.lit(100.0)).alias(c)
    return journal.groupBy("account_id").agg(total("debit"), total("credit"))


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Of each group the values at shares of its rows (the nearest rank, the last at most), by running
    counts of the distinct values, so that no group is held as one array. Null values don't count."""
    counts = rows.groupBy(group, value).agg(F.count(value).alias("c"))
    whole = Window.partitionBy(group)
    counts = counts.withColumn("n", F.sum("c").over(whole)).withColumn("upto", F.sum("c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = {name: F.least(F.floor(F.col("n") * share), F.col("n") - 1) for name, share in shares.items()}
    return counts.groupBy(group).agg(*(F.min(F.when(F.col("upto") > rank, F.col(value))).alias(name) for name, rank in at.items()))
