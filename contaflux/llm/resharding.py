"""Resharding as a minimum-cost flow.

Old shards supply their bytes, new shards take up to their capacity, keeping a byte where
it is costs nothing and moving it costs one. The cheapest flow, solved on the handful of
shards, says how many bytes each old shard keeps and how many go to each new one. Rows follow
its edges in blocks: each old shard is an ordered run of rows, cut where its edges end, the
bytes that stay first. So a new shard misses its capacity by less than a row for each edge into
it, of which there are about as many as shards in all, and only files of shards that give or
take are written anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.llm.common import Scratch

OLD_SHARDS, NEW_SHARDS = 20, 24
#: About so many rows are numbered by one task at a time.
BLOCK_ROWS = 4000


def cheapest_flow(supply: Sequence[int], capacity: Sequence[int]) -> list[list[int]]:
    """flow[i][j]: bytes from old shard i to new shard j that place all supply at the least
    cost, by successive cheapest augmenting paths (Bellman-Ford over the residual graph)."""
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities hold less than the old shards")
    m, n = len(supply), len(capacity)
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Nodes: old shards 0 .. m-1, new shards m .. m+n-1; all old shards with bytes left are sources.
        cost = [0.0 if i < m and left[i] else float("inf") for i in range(m + n)]
        came: list[int | None] = [None] * (m + n)
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    price = 0 if i == j else 1
                    if cost[i] + price < cost[m + j]:
                        cost[m + j], came[m + j], changed = cost[i] + price, i, True
                    if flow[i][j] and cost[m + j] - price < cost[i]:
                        cost[i], came[i], changed = cost[m + j] - price, m + j, True
        goal = min((j for j in range(n) if room[j]), key=lambda j: (cost[m + j], j))
        path, at = [], m + goal
        while came[at] is not None:
            path.append((came[at], at))
            at = came[at]
        amount = min([left[at], room[goal]] + [flow[b][a - m] for a, b in path if a >= m])
        for a, b in path:
            if a < m:
                flow[a][b - m] += amount
            else:
                flow[b][a - m] -= amount
        left[at] -= amount
        room[goal] -= amount
    return flow


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def numbered(rows: DataFrame, group: str, block: str, order: Sequence[Column], size: Column) -> DataFrame:
    """rows with rank and offset: how many rows and bytes come before a row of the same
    group. Blocks are ranges of the order within the group. Sums per block are added up
    first, so that no task numbers more rows than a block has."""
    sums = rows.groupBy(group, block).agg(F.count("*").alias("__n"), F.sum(size).alias("__b"))
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__b"))
    within = Window.partitionBy(group, block).orderBy(*order)
    own = rows.withColumn("__i", F.row_number().over(within) - 1).withColumn("__o", F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)) - size)
    own = own.join(sums, [group, block])
    return own.withColumn("rank", F.col("__n") + F.col("__i")).withColumn("offset", F.col("__b") + F.col("__o")).drop("__n", "__b", "__i", "__o")


def reshard(docs: DataFrame, old: Column | None = None, capacities: Sequence[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and old_shard of every row.

    size is the text's UTF-8 bytes plus 8 (null: 8), text_crc32 that of its bytes (null: 0).
    old is the shard that a row lies in (default: a hash of doc_id over OLD_SHARDS),
    capacities the bytes of the new shards (default: even over NEW_SHARDS, which is the law
    ``bytes``). slot numbers the rows of a shard without gaps from 0; grown_shard is null.
    Repeated rows are placed one by one; rows with a null doc_id like any other; an empty
    table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_size().alias("size"), row_crc().alias("text_crc32"), old_shard(old).alias("old_shard"))
    rows = scratch.keep(rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")))
    totals = rows.groupBy("old_shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("old_shard").collect()
    shards = NEW_SHARDS if capacities is None else len(capacities)
    supply = [0] * max([shards, *(r["old_shard"] + 1 for r in totals)])
    for r in totals:
        supply[r["old_shard"]] = r["b"]
    capacities = even(sum(supply), shards) if capacities is None else list(capacities)
    flow = cheapest_flow(supply, capacities)
    ends = [block_ends(i, row) for i, row in enumerate(flow)]

    bits = max(0, (sum(r["n"] for r in totals) // (BLOCK_ROWS * max(1, len(totals)))).bit_length())
    block = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    unsigned = F.col("h").bitwiseXOR(F.lit(-(2**63)))  # in the order of the blocks
    at = numbered(rows.withColumn("block", block), "old_shard", "block", [unsigned, F.col("doc_id")], F.col("size"))
    middle = F.col("offset") + F.col("size") / 2
    table = F.array(*(F.array(*(F.struct(F.lit(end).cast("double").alias("end"), F.lit(shard).alias("shard")) for end, shard in e)) for e in ends))  # as long as the flow has edges
    mine = F.element_at(table, F.col("old_shard") + 1)
    place = F.coalesce(F.get(F.filter(mine, lambda e: middle < e["end"]), F.lit(0))["shard"], F.element_at(mine, -1)["shard"])
    placed = scratch.keep(at.select("doc_id", "size", "text_crc32", "old_shard", place.alias("shard"), F.col("rank").cast("long").alias("rank")))
    # What a shard gets from one old shard is a run without gaps in its rank: the rows that stayed
    # come first, then those of the other old shards in order.
    runs = placed.groupBy("shard", "old_shard").agg(F.count("*").alias("n"), F.min("rank").alias("first")).withColumn("late", F.col("shard") != F.col("old_shard"))
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("late", "old_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(F.broadcast(runs.select("shard", "old_shard", "first", "base")), ["shard", "old_shard"])  # a row for each edge of the flow
    slot = (F.col("base") + F.col("rank") - F.col("first")).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def block_ends(i: int, row: Sequence[int]) -> list[tuple[int, int]]:
    """(end, shard) of the blocks that an old shard is cut into by its row of the flow: the bytes
    that stay come first, then a block for each new shard that gets some, in order."""
    order = ([i] if i < len(row) else []) + [j for j in range(len(row)) if j != i]
    out, end = [], 0
    for j in order:
        if row[j]:
            end += row[j]
            out.append((end, j))
    return out or [(0, min(i, len(row) - 1))]


def row_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8


def row_crc() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


def old_shard(old: Column | None) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)).cast("int") if old is None else old.cast("int")


def rewrite(docs: DataFrame, plan: DataFrame, path: str, old: Column | None = None) -> list[int]:
    """Write the files of the shards that gained or lost rows under path/shard=N, each in
    the order of its slots, remove the folders of those that are left without rows, and
    leave the others alone; returns the shards that changed.

    docs and old are those of the plan. A row is known by its doc_id (null or not), size,
    checksum and old shard, and the k rows that share these are dealt one to one to their k
    places, in the order of a hash of the row; so every row is written once.
    """
    spark = docs.sparkSession
    gave = plan.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    shards = sorted(r["s"] for r in gave.collect())
    if not shards:
        return shards
    key = ["__id", "__size", "__crc", "__old"]
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__size": row_size(), "__crc": row_crc(), "__old": old_shard(old), "__row": F.xxhash64(*hashed)})
    rows = rows.where(F.col("__old").isin(shards))  # rows of other shards stay where they are
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy("__row"))).drop("__row")
    places = plan.where(F.col("old_shard").isin(shards)).select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), F.col("old_shard").alias("__old"), "shard", "slot")
    places = places.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")))
    same = F.lit(True)
    for c in [*key, "__nth"]:
        same &= rows[c].eqNullSafe(places[c])
    kept = [rows[c] for c in docs.columns if c not in ("shard", "slot")]
    rows = rows.join(places, same).select(*kept, places["shard"], places["slot"])
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    full = {r["shard"] for r in plan.select("shard").distinct().collect()}
    for shard in set(shards) - full:  # dynamic overwrite leaves partitions without new rows as they were
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return shards
