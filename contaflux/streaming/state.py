"""Keyed state that lives on between micro-batches, and restarts: counters, hash chains, keys that
are good for one use, and a replayable sink.

Each function takes a stream or a batch. On a batch the same rows come from windows, which is
also what the tests hold the streams against. Streams need the RocksDB state store (`stateful`).
"""

from __future__ import annotations

import datetime
import hashlib
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from contaflux.sources.shared import shared_folder
from contaflux.streaming.events import LATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State in RocksDB: changes are uploaded instead of whole stores, rows aren't counted (each count is a
#: look-up before a put), and the sides of a join share one store instead of four.
_STORES = {
    _PROVIDER: _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session is left as it was."""
    before = {name: spark.conf.get(name, None) for name in _STORES}
    for name, value in _STORES.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def advanced(rows: DataFrame, parts: int, by: str, change: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """rows, in the order of a column, arrive in parts: a query over change(stream) takes each part,
    ends, and goes on from its checkpoint when the next part is there. Gives all that it wrote."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "advanced")
    edges = rows.select(F.percentile_approx(F.unix_micros(F.col(by).cast("timestamp")), [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    micros, out = F.unix_micros(F.col(by).cast("timestamp")), None
    cuts = [None, *sorted(set(edges)), None]
    with stateful(spark):
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = rows.where((F.lit(True) if low is None else micros > low) & (F.lit(True) if high is None else micros <= high))
            part.write.mode("append").parquet(f"{folder}/in")
            out = change(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            run(out.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def run(writer, checkpoint: str) -> None:
    """Takes what has arrived since the checkpoint, and ends. An error of the query is raised."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# A counter that flags ------------------------------------------------------------------


class Counter(StatefulProcessor):
    """Counts the rows of a key; the one that makes the count reach the threshold is given out."""

    def __init__(self, threshold: int, order: list[str], kind: StructType):
        self.threshold, self.order, self.kind = threshold, order, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        before = n
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            n += 1
            if n == self.threshold:
                yield Row(**{c: row[c] for c in self.kind.names})
        if before < self.threshold or n < self.threshold:
            self.count.update((n,))

    def close(self) -> None:
        pass


def flagged(rows: DataFrame, key: str, threshold: int, order: list[str]) -> DataFrame:
    """Of each key the row that is its threshold-th (columns key and order). On a stream rows count as
    they arrive, in order within a micro-batch; a null key is a key, and state is one number a key."""
    columns = rows.select(key, *order)
    if not rows.isStreaming:
        by = Window.partitionBy(key).orderBy(*order)
        return columns.withColumn("__n", F.row_number().over(by)).where(F.col("__n") == threshold).drop("__n")
    kind = columns.schema
    return columns.groupBy(key).transformWithState(Counter(threshold, order, kind), kind, "Append", "None")


# A hash chain --------------------------------------------------------------------------

#: What the first entry of a chain follows.
GENESIS = ""


def link(previous: str, payload: str) -> str:
    """The hash of an entry: of the hash before it and its payload."""
    return hashlib.sha256(f"{previous}{payload}".encode()).hexdigest()


class Chain(StatefulProcessor):
    """The last hash of each key; entries are appended in order."""

    def __init__(self, order: list[str], kind: StructType):
        self.order, self.kind = order, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        previous, n = self.last.get() if self.last.exists() else (GENESIS, 0)
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            hash, n = link(previous, row["payload"] or ""), n + 1
            yield Row(**{c: row[c] for c in self.kind.names[:-3]}, n=n, previous=previous, hash=hash)
            previous = hash
        self.last.update((previous, n))

    def close(self) -> None:
        pass


def chained(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each entry of a log stream (key, order, payload) with its number in the key's chain, the hash
    before it and its own. An entry that arrives after others is appended after them, as in any
    log; chains of different keys don't wait for each other. Null payloads count as empty."""
    columns = log.select(key, *order, "payload")
    kind = log.select(key, *order).schema.add("n", "long").add("previous", "string").add("hash", "string")
    if log.isStreaming:
        return columns.groupBy(key).transformWithState(Chain(order, kind), kind, "Append", "None")

    def whole(rows):
        rows = rows.sort_values(order, kind="stable")
        previous, found = GENESIS, []
        for payload in rows["payload"].fillna(""):
            found.append((previous, link(previous, payload)))
            previous = found[-1][1]
        return rows[[key, *order]].assign(n=range(1, len(rows) + 1), previous=[f[0] for f in found], hash=[f[1] for f in found])

    return columns.groupBy(key).applyInPandas(whole, kind)


# Keys that are good for one use --------------------------------------------------------


class Tokens(StatefulProcessor):
    """A key's last grant until it is used, replaced or past its time; a timer sweeps it then."""

    def __init__(self, lifetime: int, order: list[str]):
        self.lifetime, self.order = lifetime, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grant = handle.getValueState("grant", "id long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each call of the state is a round trip, so the grant is read once and written once.
        was = self.grant.get() if self.grant.exists() else None
        now = was
        told = lambda grant, use, outcome: Row(key=key[0], grant_id=grant, use_id=use, outcome=outcome)
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            fresh = now is not None and row["at"] <= now[1] + self.lifetime
            if row["use"] and fresh:
                yield told(now[0], row["id"], "used")
            else:
                if now is not None:
                    yield told(now[0], None, "replaced" if fresh else "unused")
                if row["use"]:
                    yield told(None, row["id"], "refused")
            now = None if row["use"] else (row["id"], row["at"])
        if was is not None and (now is None or tuple(now) != tuple(was)):
            self.handle.deleteTimer(_expiry(was[1], self.lifetime))
        if now is None:
            if was is not None:
                self.grant.clear()
        elif was is None or tuple(now) != tuple(was):
            self.grant.update(now)
            self.handle.registerTimer(_expiry(now[1], self.lifetime))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.grant.exists() and _expiry(self.grant.get()[1], self.lifetime) <= expiredTimerInfo.getExpiryTimeInMs():
            id = self.grant.get()[0]
            self.grant.clear()
            yield Row(key=key[0], grant_id=id, use_id=None, outcome="unused")

    def close(self) -> None:
        pass


def _expiry(at: int, lifetime: int) -> int:
    """Milliseconds from which on a grant of microsecond at is past its lifetime (microseconds)."""
    return (at + lifetime) // 1000 + 1


def once_used(events: DataFrame, lifetime: datetime.timedelta, delay: str = LATE) -> DataFrame:
    """What becomes of grants and uses of keys. events: key, id, ts and use (false: a grant).

    key, grant_id, use_id and outcome: ``used`` (the use came within the lifetime, both ids), ``refused``
    (a use without a grant, a second one, or one past the lifetime: no grant_id), ``replaced`` (a
    grant before the end of the one before it), ``unused`` (a grant past its lifetime). A stream
    sweeps unused grants when its watermark passes their end, so state is bounded by the keys
    of one lifetime; a batch gives them up to the same time, the last ts less the delay."""
    span = int(lifetime.total_seconds() * 1_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where(F.col("ts").isNotNull()).select("key", "id", F.col("ts").cast("timestamp").alias("ts"), at.alias("at"), "use")
    kind = rows.select("key", F.col("id").cast("long").alias("grant_id")).schema.add("use_id", "long").add("outcome", "string")
    if events.isStreaming:
        return rows.withWatermark("ts", delay).groupBy("key").transformWithState(Tokens(span, []), kind, "Append", "EventTime")
    by = Window.partitionBy("key").orderBy("at", "id")
    rows = rows.withColumns({f"{p}_{c}": f(F.col(c)).over(by) for p, f in (("last", F.lag), ("next", F.lead)) for c in ("id", "at", "use")})
    end = rows.agg((F.unix_millis(F.max("ts") - F.expr(f"INTERVAL {delay}"))).alias("__end"))
    uses = rows.where("use").select("key", F.when(~F.col("last_use") & (F.col("at") <= F.col("last_at") + span), F.col("last_id")).alias("grant_id"), F.col("id").alias("use_id"))
    uses = uses.withColumn("outcome", F.when(F.col("grant_id").isNotNull(), "used").otherwise("refused"))
    fresh = F.col("next_at") <= F.col("at") + span
    grants = rows.where("NOT use").join(F.broadcast(end)).where(F.col("next_at").isNotNull() | (F.floor((F.col("at") + span) / 1000) + 1 <= F.col("__end")))
    lost = F.when(~fresh | F.col("next_at").isNull(), "unused").when(~F.col("next_use"), "replaced")
    grants = grants.select("key", F.col("id").alias("grant_id"), F.lit(None).cast("long").alias("use_id"), lost.alias("outcome")).where("outcome IS NOT NULL")
    return uses.unionByName(grants)


# A sink that can be replayed -----------------------------------------------------------


def into_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a micro-batch's rows whose keys the target hasn't got, once each.

    The rows of a batch are in the target under the batch's number. A batch that comes again after
    a failure replaces its own rows and is held against the others' alone, so the target has
    what one run would have written, and a duplicate of an earlier batch writes nothing. Null keys
    are equal to each other. Of equal keys in a batch one row stays."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch={number}"
        known = spark.read.schema(batch.select(*keys).schema.add("batch", "long")).parquet(path) if _there(spark, path) else None
        rows = batch.dropDuplicates(keys)
        if known is not None:
            known = known.where(F.col("batch") != number).select(*(F.col(k).alias(f"__{k}") for k in keys))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            rows = rows.join(known, same, "left_anti")
        rows.write.mode("overwrite").parquet(target)

    return write


def _there(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def ingested(rows: DataFrame, parts: int, by: str, keys: list[str]) -> DataFrame:
    """rows, in the order of a column, taken in parts by a stream into a target that has each key
    once: the first that came (of one part: any, so keys should tell equal rows)."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "ingested")
    micros = F.unix_micros(F.col(by).cast("timestamp"))
    edges = rows.select(F.percentile_approx(micros, [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    cuts = [None, *sorted(set(edges)), None]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows.where((F.lit(True) if low is None else micros > low) & (F.lit(True) if high is None else micros <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        run(stream.writeStream.foreachBatch(into_once(f"{folder}/out", keys)), f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")
