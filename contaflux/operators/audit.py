"""Hash-chained audit log: every row carries the hash of the one before it of its tenant."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions.vectors import chain_hash


def payload(*columns: str) -> Column:
    return F.to_json(F.struct(*sorted(columns)))


def appended(rows: DataFrame) -> DataFrame:
    """rows (tenant_id, id, created_at, payload) with prev_hash and row_hash, by tenant in
    (created_at, id). A chain is sequential within its tenant: tenants are dealt out by
    hash, rows come sorted and stream, so a task holds one hash a tenant and no chain."""
    schema = "tenant_id long, id long, prev_hash string, row_hash string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, last = None, None
        for frame in frames:
            before, own = [], []
            for t, p in zip(frame["tenant_id"], frame["payload"], strict=True):
                if t != tenant:
                    tenant, last = t, None
                before.append(last)
                last = hashlib.sha256(((last or "") + p).encode()).hexdigest()
                own.append(last)
            yield pd.DataFrame({"tenant_id": frame["tenant_id"], "id": frame["id"], "prev_hash": before, "row_hash": own})

    return rows.select("tenant_id", "id", "created_at", "payload").repartition("tenant_id").sortWithinPartitions("tenant_id", "created_at", "id").mapInPandas(run, schema)


def linked(log: DataFrame, places: int = 64) -> DataFrame:
    """log with expected: the row_hash of the tenant's row before, null for its first.

    A tenant may have most of the rows, so they are cut into stretches of time by quantiles of
    created_at; within a stretch the row before is a lag, and the first row of a stretch takes the
    last one of the tenant's stretch before it.
    """
    cuts = [c for c in log.select(F.unix_micros(F.col("created_at").cast("timestamp")).alias("t")).approxQuantile("t", [i / places for i in range(1, places)], 0.005)]
    cuts = sorted({int(c) for c in cuts})
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = log.withColumn("__s", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= t)) if cuts else F.lit(0))
    order = [F.col("created_at"), F.col("id")]
    own = rows.withColumn("__before", F.lag("row_hash").over(Window.partitionBy("tenant_id", "__s").orderBy(*order))).withColumn("__first", F.row_number().over(Window.partitionBy("tenant_id", "__s").orderBy(*order)) == 1)
    ends = rows.groupBy("tenant_id", "__s").agg(F.max_by("row_hash", F.struct(*order)).alias("__last"))
    ends = ends.withColumn("__prev", F.lag("__last").over(Window.partitionBy("tenant_id").orderBy("__s"))).select("tenant_id", "__s", "__prev")  # a row a stretch
    return own.join(ends, ["tenant_id", "__s"]).withColumn("expected", F.when(F.col("__first"), F.col("__prev")).otherwise(F.col("__before"))).drop("__s", "__before", "__first", "__prev")


def _bad() -> Column:
    return ~F.col("prev_hash").eqNullSafe(F.col("expected")) | (F.col("row_hash") != chain_hash(F.col("prev_hash"), F.col("payload")))


def broken(log: DataFrame) -> DataFrame:
    """Rows of a log (tenant_id, id, created_at, payload, prev_hash, row_hash) whose link or hash is wrong."""
    return linked(log).where(_bad()).select("tenant_id", "id")


def verified(log: DataFrame) -> DataFrame:
    """For each tenant how many rows it has, how many are broken, and the first of those."""
    first = F.min(F.when(F.col("bad"), F.struct("created_at", "id")))["id"]
    return linked(log).withColumn("bad", _bad()).groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("broken"), first.alias("first_broken"))
