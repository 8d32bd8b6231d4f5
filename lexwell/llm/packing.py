"""Problem 8: items of varying size combined into containers of fixed capacity with little unused space.

Method: minimum bin slack. A container is opened with the largest item left; subset-sum dynamic programming over the
available sizes, with one bit per reachable sum, finds the fullest combination that fits beside it; both are removed.
Items above the capacity fill containers of their own, their rest is an item like others.

Items are dealt by hash into shards of bounded size that are packed independently, so no task holds more than a shard.
The worst-filled container of each shard is then unpacked and the items of these are packed together, again in shards,
until one shard is left: only that one leaves an ill-filled container behind.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwell.llm.common import saved, ship


def fullest(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Sizes, each no more often than ``left`` has it, whose sum is the highest up to ``room``; large ones first.

    ``sizes`` are the distinct sizes with items left, falling.
    """
    target, mask, reach = 1 << room, (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []  # (size, sums reachable before it)
    for size in sizes:
        if size > room:
            continue
        for _ in range(min(left[size], room // size)):
            new = reach | (reach << size) & mask
            if new == reach:
                break
            steps.append((size, reach))
            reach = new
        if reach & target:
            break
    total, chosen = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(size)
            total -= size
    return chosen


def minimum_bin_slack(items: dict[int, int], capacity: int) -> list[list[int]]:
    """Containers, each a list of sizes; ``items`` gives how many items there are of each size from 1 to ``capacity``."""
    left = {s: n for s, n in items.items() if n > 0}
    sizes = sorted(left, reverse=True)
    containers = []
    while sizes:
        first = sizes[0]
        left[first] -= 1
        if not left[first]:
            sizes.pop(0)
        chosen = fullest(sizes, left, capacity - first)
        emptied = set()
        for s in chosen:
            left[s] -= 1
            if not left[s]:
                emptied.add(s)
        if emptied:
            sizes = [s for s in sizes if s not in emptied]
        containers.append([first, *chosen])
    return containers


def pack_shard(items: list[tuple[object, int, int]], capacity: int) -> list[tuple[int, object, int, int]]:
    """(container, item, part, size) of items (item, first part, size): every item is in one container, or in parts that
    count on from its first part if it exceeds the capacity. Items of size 0 take no space and go into container 0."""
    out: list[tuple[int, object, int, int]] = []
    waiting, number = defaultdict(list), 0
    for item, first, size in items:
        if size <= 0:
            out.append((0, item, first, 0))
            continue
        whole, rest = divmod(size, capacity)
        for part in range(whole):
            out.append((number, item, first + part, capacity))
            number += 1
        if rest:
            waiting[rest].append((item, first + whole))
    for container in minimum_bin_slack({s: len(w) for s, w in waiting.items()}, capacity):
        for s in container:
            item, part = waiting[s].pop()
            out.append((number, item, part, s))
        number += 1
    return out


def _packed_once(units: DataFrame, shards: int, turn: int, schema: T.StructType) -> DataFrame:
    """Packs (pack_id, capacity, item, part, size, copy) in shards; container numbers of different turns differ."""
    dealt = units.select("pack_id", "capacity", "item", "part", "size", F.pmod(F.xxhash64("item", "part", "size", "copy"), F.lit(shards)).alias("shard"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, pack_id, capacity = key
        listed = sorted(zip(rows["item"].tolist(), rows["part"].tolist(), rows["size"].tolist()), key=lambda x: (-x[2], str(x[0]), x[1]))
        out = pack_shard(listed, int(capacity))
        return pd.DataFrame(
            {
                "pack_id": pd.Series([pack_id] * len(out), dtype="int32"),
                "container": pd.Series([turn * 2**56 + int(shard) * 2**28 + c for c, *_ in out], dtype="int64"),
                "item": pd.Series([i for _, i, _, _ in out], dtype=rows["item"].dtype),
                "part": pd.Series([p for _, _, p, _ in out], dtype="int32"),
                "size": pd.Series([s for *_, s in out], dtype="int64"),
                "shard": pd.Series([int(shard)] * len(out), dtype="int64"),
                "capacity": pd.Series([int(capacity)] * len(out), dtype="int64"),
            }
        )

    return dealt.groupBy("shard", "pack_id", "capacity").applyInPandas(pack, schema)


def packed(sizes: DataFrame, record: str, size: str, capacities: list[tuple[int, int]], shard_items: int = 4096) -> DataFrame:
    """(pack_id, container, record, part, size) for each (pack_id, capacity): where every item of ``sizes`` goes.

    Container numbers are unique in a pack. Items are dealt by a hash of id, size and number of the copy, so repeated
    rows spread like others; a null id is an item, a null size counts as 0. An empty table gives no row. Capacities
    must be positive; their list is small and fixed.
    """
    if any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive")
    spark = sizes.sparkSession
    ship(spark)
    kind = sizes.schema[record].dataType.simpleString()
    schema = T._parse_datatype_string(f"pack_id int, container bigint, item {kind}, part int, size bigint, shard bigint, capacity bigint")
    columns = ["pack_id", "container", "item", "part", "size"]
    if not capacities:
        return spark.createDataFrame([], schema).select(columns).withColumnRenamed("item", record)
    items = (
        sizes.select(F.col(record).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
        .groupBy("item", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("item", "size", F.lit(1).alias("part"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    )
    packs = F.explode(F.array(*(F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in capacities)))
    units = items.select("item", "part", "size", "copy", packs.alias("p")).select("p.*", "item", "part", "size", "copy")
    shards, turn, done = max(1, -(-sizes.count() // shard_items)), 0, None
    while True:
        made = saved(_packed_once(units, shards, turn, schema))
        if shards == 1:
            done = made.select(columns) if done is None else done.unionByName(made.select(columns))
            return done.withColumnRenamed("item", record)
        # The worst-filled container of each shard; of equal ones that with the lowest number.
        loads = made.groupBy("pack_id", "shard", "container").agg(F.sum("size").alias("load"))
        worst = loads.groupBy("pack_id", "shard").agg(F.min_by("container", F.struct("load", "container")).alias("container")).select("pack_id", "container")
        kept = made.join(worst, ["pack_id", "container"], "left_anti").select(columns)
        done = kept if done is None else done.unionByName(kept)
        # A container number tells equal rows of one item apart.
        again = made.join(worst, ["pack_id", "container"], "left_semi")
        units = saved(again.select("pack_id", "capacity", "item", "part", "size", F.col("container").alias("copy")))
        most = units.groupBy("pack_id").count().agg(F.max("count")).first()[0] or 0
        shards, turn = max(1, min(-(-most // shard_items), shards - 1)), turn + 1


def fill(packing: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(pack_id, capacity_tokens, items, containers, tokens, fill): how full the containers of each pack are."""
    known = packing.sparkSession.createDataFrame(capacities, "pack_id int, capacity_tokens bigint")
    totals = (
        packing.groupBy("pack_id", "container")
        .agg(F.sum("size").alias("tokens"), F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).alias("items"))
        .groupBy("pack_id")
        .agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    )
    return known.join(totals, "pack_id").withColumn(
        "fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    )
