"""Resharding by minimum-cost flow: move the fewest bytes that bring old shards to new capacities.

1. The bytes of each old shard are summed over blocks (a hash of the row; more blocks for more data).
2. A network of old shards, new shards and capacities is solved on the driver: keeping a byte in its shard costs
   nothing, moving it costs 1, or what `cost` says. Its size is old shards times new shards, whatever the documents.
3. The flow out of an old shard cuts the sequence of its blocks. A block between two cuts moves whole; a block that a
   cut falls into is shared out by document, large ones first, each to the target with the most room.
4. rewrite() writes only the new shards that gain or lose documents, beside the old files, and then replaces their folders.

Defined cases: a null text has no bytes and size 1; a null doc_id is a document like any other; rows that repeat others are
each placed, and any of equal rows may take either slot; an empty table gives an empty result; other columns are ignored by
reshard() and kept by rewrite(), but for shard and slot, which are its own.
"""

from __future__ import annotations

import heapq
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import discard, new_path, ship, small, stored, table, temporary

#: Blocks of a shard: as many as keep a block under so many bytes; else up to BLOCKS of at least BLOCK_ROWS rows, since a
#: cut is the evener the more documents its block has.
BLOCK_BYTES, BLOCKS, BLOCK_ROWS, MOST_ROWS = 64 << 20, 64, 128, 1 << 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Cheapest shipment of the whole supply within the capacities, by successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are less than the supply")
    sink, heads, room, price, out = n + m + 1, [], [], [], [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, most: int, each: float) -> None:
        for x, y, r, c in ((a, b, most, each), (b, a, 0, -each)):
            out[x].append(len(heads))
            heads.append(y)
            room.append(r)
            price.append(c)

    for i in range(n):
        for j in range(m):
            arc(1 + i, 1 + n + j, supply[i], cost[i][j])
    for i in range(n):
        arc(0, 1 + i, supply[i], 0)
    for j in range(m):
        arc(1 + n + j, sink, capacity[j], 0)
    potential, left = [0.0] * (sink + 1), sum(supply)
    while left:
        far, via, queue = [float("inf")] * (sink + 1), [-1] * (sink + 1), [(0.0, 0)]
        far[0] = 0.0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                if room[e] and (x := d + price[e] + potential[a] - potential[heads[e]]) < far[heads[e]] - 1e-12:
                    far[heads[e]], via[heads[e]] = x, e
                    heapq.heappush(queue, (x, heads[e]))
        potential = [p + min(d, far[sink]) for p, d in zip(potential, far, strict=True)]
        path, a = [], sink
        while a:
            path.append(via[a])
            a = heads[via[a] ^ 1]
        push = min(left, *(room[e] for e in path))
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        left -= push
    return [[room[2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """(row_no, doc_id, size, text_crc32, old_shard) of each row, stored; row_no tells rows that repeat each other apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    return stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "sizes")


def block_of() -> Column:
    """The block of a row among the `blocks` of its old shard."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("blocks")).cast("int")


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, capacities: list[int] | None = None, cost: list[list[float]] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, old_shard, blocks, block, shard, slot.

    old_shard: a column expression of 0 .. old_shards-1. capacities: bytes of each new shard; equal shares if None.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = sized(docs, old_shard)
    sizes = {r[0]: r for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    supply = [sizes[i]["bytes"] if i in sizes else 0 for i in range(old_shards)]
    total = sum(supply)
    capacities = capacities or [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    cost = cost or [[float(i != j) for j in range(new_shards)] for i in range(old_shards)]
    flow = min_cost_flow(supply, capacities, cost)
    cuts = []
    for i in range(old_shards):
        at = 0
        for j in sorted(range(new_shards), key=lambda j: (cost[i][j], j)):
            if flow[i][j]:
                cuts.append((i, j, at, at := at + flow[i][j]))
    cuts = spark.createDataFrame(cuts, "old_shard int, shard int, lo long, hi long")  # at most a row for each pair of shards
    # as many blocks of each old shard as its own bytes and rows ask for, so that a large shard has no larger blocks
    each = [(i, int(max(-(-max(1, r["bytes"]) // BLOCK_BYTES), min(BLOCKS, r["n"] // BLOCK_ROWS), r["n"] // MOST_ROWS, 1))) for i, r in sizes.items()]
    rows = rows.join(F.broadcast(spark.createDataFrame(each, "old_shard int, blocks int")), "old_shard").withColumn("block", block_of())
    line = W.partitionBy("old_shard").orderBy("block")
    ends = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).withColumn("stop", F.sum("bytes").over(line)).withColumn("start", F.col("stop") - F.col("bytes"))
    pieces = ends.join(F.broadcast(cuts), "old_shard").where("lo < stop and hi > start")
    targets = pieces.groupBy("old_shard", "block").agg(F.sort_array(F.collect_list(F.struct("shard", (F.least("hi", "stop") - F.greatest("lo", "start")).alias("room")))).alias("targets"))
    held = rows.join(targets, ["old_shard", "block"])
    whole = held.where(F.size("targets") == 1).withColumn("shard", F.col("targets")[0]["shard"]).drop("targets")

    def share(part: pd.DataFrame) -> pd.DataFrame:
        open_ = [(-t["room"], t["shard"]) for t in part["targets"].iloc[0]]
        heapq.heapify(open_)
        part = part.drop(columns="targets").sort_values(["size", "doc_id", "text_crc32", "row_no"], ascending=[False, True, True, True])
        shards = []
        for size in part["size"]:
            room, shard = open_[0]
            shards.append(shard)
            heapq.heapreplace(open_, (room + size, shard))
        return part.assign(shard=shards)

    shared = held.where(F.size("targets") > 1).groupBy("old_shard", "block").applyInPandas(share, whole.schema)
    dealt = stored(whole.unionByName(shared), "dealt")
    counts = dealt.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("shard", "old_shard", "block").orderBy("doc_id", "text_crc32", "size", "row_no"))
    return dealt.withColumn("rank", rank).join(bases, ["shard", "old_shard", "block"]).select("doc_id", "size", "text_crc32", "old_shard", "blocks", "block", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))


def affected(plan: DataFrame) -> list[int]:
    """New shards whose documents change: a list no longer than the shards."""
    moved = plan.where("old_shard != shard")
    return sorted(r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect())


def rewrite(docs: DataFrame, old_shard: Column, plan: DataFrame, path: str, new_shards: int) -> list[int]:
    """Write the affected shards of docs below path, one folder shard=N each, files in slot order; the others stay untouched.
    New files are written beside the folder first; then each affected shard's folder is replaced, also that of a shard that
    has become empty or is no more. Returns the affected shards.

    A block that moves whole is looked up in a table of blocks, and its rows are numbered anew in the plan's order: texts are
    shuffled once. Only rows of blocks that a cut falls into are looked up one by one, by doc_id (null as well), size and
    crc32; rows that agree in all three are alike to the plan."""
    spark = docs.sparkSession
    changed = affected(plan)
    ours = ["size", "text_crc32", "old_shard", "blocks", "block", "shard", "slot"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ours]
    counts = stored(plan.groupBy("old_shard", "blocks", "block", "shard").agg(F.min("slot").alias("base")), "blocks")
    single = counts.groupBy("old_shard", "block").agg(F.count("*").alias("n"), F.min("shard").alias("shard"), F.min("base").alias("base")).where("n = 1").drop("n")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*kept, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    rows = rows.join(F.broadcast(counts.select("old_shard", "blocks").distinct()), "old_shard").withColumn("block", block_of())
    whole = small(stored(single, "whole"))
    order = ["doc_id", "text_crc32", "size"]
    rank = F.row_number().over(W.partitionBy("shard", "old_shard", "block").orderBy(*order))
    moved = rows.join(whole, ["old_shard", "block"]).where(F.col("shard").isin(changed)).withColumn("slot", F.col("base") + rank - 1)
    same = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), "size", "text_crc32"]
    number = F.row_number().over(W.partitionBy("_id", "size", "text_crc32").orderBy("slot"))
    places = plan.join(whole, ["old_shard", "block"], "left_anti").select(*same, F.col("shard"), F.col("slot")).withColumn("_k", number)
    cut = rows.join(whole, ["old_shard", "block"], "left_anti").withColumn("_id", same[0])
    cut = cut.withColumn("_k", F.row_number().over(W.partitionBy("_id", "size", "text_crc32").orderBy("old_shard")))
    cut = cut.join(places.where(F.col("shard").isin(changed)), ["_id", "size", "text_crc32", "_k"])
    out = moved.select(*kept, "shard", "slot").unionByName(cut.select(*kept, "shard", "slot"))
    fresh = f"{path.rstrip('/')}/.new-{uuid.uuid4().hex}"
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(fresh)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(fresh).getFileSystem(spark._jsc.hadoopConfiguration())
    for shard in changed:
        old, new = folder(f"{path.rstrip('/')}/shard={shard}"), folder(f"{fresh}/shard={shard}")
        fs.delete(old, True)
        if fs.exists(new) and not fs.rename(new, old):
            raise OSError(f"{old} could not be replaced")
    for status in fs.globStatus(folder(f"{path.rstrip('/')}/shard=*")) or []:
        if int(status.getPath().getName().split("=")[1]) >= new_shards:
            fs.delete(status.getPath(), True)
    fs.delete(folder(fresh), True)
    for x in (counts, whole):
        discard(x)
    return changed


def op2_reshard(spark, sf_dir: str) -> DataFrame:
    """The old layout puts the documents of a source together, over 12 shards; the new one has 16 equal shards. The affected
    shards are rewritten in the shared folder, and the result is read from the files: where each document lies."""
    docs, old = table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(12))
    with temporary(spark) as keep:
        plan = keep(stored(reshard(docs, old, 12, 16), "plan"))
        path = new_path(spark, "shards")
        changed = rewrite(docs, old, plan, path, 16)
    text = F.coalesce("text", F.lit(""))
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    rest = plan.where(~F.col("shard").isin(changed)).select(*names)  # shards that stay as they are have no new files
    if not changed:
        files = rest
    else:
        files = spark.read.schema("doc_id " + dict(docs.dtypes)["doc_id"] + ", text string, slot long, shard int").parquet(path)
        files = files.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot").unionByName(rest)
    return files.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
