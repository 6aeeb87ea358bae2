"""Two streams joined within an interval of time, and rows that come too late."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.sources.shared import shared_folder
from contaflux.streaming.events import LATE, timed
from contaflux.streaming.state import _there, run


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, delay: str = LATE, outer: bool = False) -> DataFrame:
    """Rows of left with the rows of right of the same key that come at or after them, within an
    interval (``2 hours``). left: key, ts, id; right: key, ts, id. Gives key, left_id, right_id,
    left_ts and right_ts; with outer also rows of left that have none, once none can come any more.

    On streams both sides have a watermark, and the interval bounds how long a row is kept: left
    ones until no right row of their interval can come, right ones until no earlier left row can.
    Null keys and times meet nothing."""
    one = _watermarked(left, delay).select(F.col(key).alias(key), F.col("ts").alias("left_ts"), F.col("id").alias("left_id"))
    other = _watermarked(right, delay).select(F.col(key).alias("__key"), F.col("ts").alias("right_ts"), F.col("id").alias("right_id"))
    near = (F.col(key) == F.col("__key")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))
    return one.join(other, near, "left_outer" if outer else "inner").select(key, "left_id", "right_id", "left_ts", "right_ts")


def _watermarked(rows: DataFrame, delay: str) -> DataFrame:
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay) if rows.isStreaming else rows


def seconds(delay: str) -> int:
    """An interval such as ``10 minutes`` in seconds."""
    n, unit = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", delay).groups()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]


def apart(path: str, delay: str = LATE) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes rows in time to path/main and rows that are late to path/late.

    Late is what Spark's stateful operators would drop: a ts before the watermark, which is the
    largest ts of all earlier batches less the delay. That is kept with each batch in path/seen,
    so a replayed batch is judged as it was the first time and replaces its own rows. Rows without
    a ts are late."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("top timestamp, batch long").parquet(f"{path}/seen").where(F.col("batch") < number) if _there(spark, f"{path}/seen") else None
        top = known.agg(F.max("top")).first()[0] if known is not None else None
        ts = F.col("ts").cast("timestamp")
        batch = batch.persist()
        late = F.lit(False) if top is None else ts < F.lit(top) - F.expr(f"INTERVAL {delay}")
        late = late | ts.isNull()
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/main/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(ts).alias("top")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        batch.unpersist()

    return write


def late_of(parts: list[DataFrame], delay: str = LATE) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of parts that arrive one after another, each with its batch's number."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    folder = shared_folder(spark, "late")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(schema).parquet(f"{folder}/in").writeStream.foreachBatch(apart(f"{folder}/out", delay)), f"{folder}/checkpoint")
    read = lambda name: spark.read.schema(parts[0].schema.add("batch", "long")).parquet(f"{folder}/out/{name}")
    return read("main"), read("late")


__all__ = ["apart", "interval_join", "late_of", "seconds", "timed"]
