"""Problem 9: records of several sources mixed to target shares of the total size.

Method: Poisson replication. The mean repetition rate of a source follows from its target share and its size; each
record draws a uniform number from a seeded hash of its id and inverts the Poisson distribution at it, cut at the
highest number of uses; records are multiplied by their count and shuffled globally.

The total is the largest at which every source that has records can reach its share within its number of uses; shares
of sources without records are spread over the others in proportion. As the counts grow with the rate for fixed draws,
the rate is finally chosen on a grid such that the sizes really drawn come closest to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 21  # rates tried around the expected one, from half to twice of it


def thresholds(rate: float, most: int) -> list[float]:
    """P(count <= k) for k = 0 .. most - 1 of a Poisson distribution; a draw above the k-th means more than k uses."""
    if math.isinf(rate):
        return [0.0] * most
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(most):
        total += term
        out.append(min(total, 1.0))
        term *= rate / (k + 1)
    return out


def mean_uses(rate: float, most: int) -> float:
    return most - sum(thresholds(rate, most))


def poisson_rate(mean: float, most: int) -> float:
    """The rate at which a Poisson count cut at ``most`` has this mean; infinite if the mean is ``most``."""
    if mean >= most * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while mean_uses(high, most) < mean:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if mean_uses(middle, most) < mean else (low, middle)
    return high


def uniform(record: Column, seed: int) -> Column:
    """A number above 0 and up to 1 that depends on id and seed only."""
    return (F.pmod(F.xxhash64(record, F.lit(seed)), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)


def plan(totals: dict[str, int], weights: list[tuple[str, float, int]]) -> dict[str, tuple[float, float, int]]:
    """(share among the sources with records, target size, most uses) of each source that takes part."""
    able = {s: (w, m) for s, w, m in weights if s is not None and w and w > 0 and m and m > 0 and totals.get(s, 0) > 0}
    whole = sum(w for w, _ in able.values())
    if not able:
        return {}
    size = min(m * totals[s] * whole / w for s, (w, m) in able.items())
    return {s: (w / whole, size * w / whole, m) for s, (w, m) in able.items()}


def _by_source(values: dict[str, list[float]]) -> Column:
    return F.create_map(*(x for s, v in values.items() for x in (F.lit(s), F.array(*map(F.lit, v)))))


def mixed(sizes: DataFrame, record: str, source: str, size: str, weights: list[tuple[str, float, int]], seed: int = 17) -> tuple[DataFrame, dict]:
    """(rows, plan): rows (record, source, copy, size, shuffle_key) in global random order, and what was aimed at.

    ``weights`` is a small fixed list (source, target share, most uses), one entry a source. Records with a null or
    unlisted source take no part; a null id is an id like others; null sizes count as 0. An empty table gives no rows.
    """
    rows = sizes.select(F.col(record).alias("r"), F.col(source).alias("s"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    listed = [s for s, *_ in weights if s is not None]
    rows = rows.where(F.col("s").isin(listed) if listed else F.lit(False))
    totals = {x["s"]: x["n"] for x in rows.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row a source of the list
    aims = plan(totals, weights)
    kind = sizes.schema[record].dataType.simpleString()
    if not aims:
        empty = sizes.sparkSession.createDataFrame([], f"r {kind}, s string, copy int, n bigint, shuffle_key bigint")
        return empty.withColumnsRenamed({"r": record, "s": source, "n": size}), aims
    rates = {s: poisson_rate(aim / totals[s], most) for s, (_, aim, most) in aims.items()}
    taking = rows.where(F.col("s").isin(list(aims))).withColumn("u", uniform(F.col("r"), seed))
    steps = [2.0 ** ((g - GRID // 2) / (GRID // 2)) for g in range(GRID)]

    def count(values: dict[str, list[float]]) -> Column:
        return F.size(F.filter(_by_source(values)[F.col("s")], lambda t: t < F.col("u")))

    tried = {s: sorted({r * f for f in steps}) if not math.isinf(r) else [r] for s, r in rates.items()}
    # One aggregation: for each source the size drawn at each rate of its grid, as the sum of the counts over thresholds.
    grid = {s: [t for r in tried[s] for t in thresholds(r, aims[s][2])] for s in aims}
    drawn = (
        taking.select("s", "n", F.transform(_by_source(grid)[F.col("s")], lambda t: F.when(t < F.col("u"), F.col("n")).otherwise(F.lit(0))).alias("parts"))
        .select("s", F.posexplode("parts").alias("at", "part"))
        .groupBy("s", "at")
        .agg(F.sum("part").alias("part"))
        .collect()  # sources times grid times uses rows
    )
    reached: dict[str, dict[int, int]] = {}
    for x in drawn:
        at = reached.setdefault(x["s"], {})
        k = x["at"] // aims[x["s"]][2]
        at[k] = at.get(k, 0) + x["part"]
    chosen = {s: tried[s][min(reached[s], key=lambda k: abs(reached[s][k] - aims[s][1]))] for s in aims}
    uses = count({s: thresholds(r, aims[s][2]) for s, r in chosen.items()})
    out = (
        taking.withColumn("uses", uses)
        .where(F.col("uses") > 0)
        .select("r", "s", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"), "n")
        .withColumn("shuffle_key", F.xxhash64("r", "copy", F.lit(seed + 1)))
        .orderBy("shuffle_key")
    )
    return out.withColumnsRenamed({"r": record, "s": source, "n": size}), aims


def shares(mix: DataFrame, source: str, size: str, weights: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, records, uses, tokens, actual_share, most_uses) of each listed source."""
    used = mix.groupBy(source).agg(
        F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).alias("records"), F.count(F.lit(1)).alias("uses"), F.sum(size).alias("tokens"),
        F.max("copy").alias("most_uses"),
    ).withColumnRenamed(source, "of")
    total = used.agg(F.sum("tokens")).first()[0] or 0  # one number
    zero = F.lit(0).cast("bigint")
    return weights.join(F.broadcast(used), F.col("source") == F.col("of"), "left").select(
        "source", "target_share", "max_repeats", F.coalesce("records", zero).alias("records"), F.coalesce("uses", zero).alias("uses"),
        F.coalesce("tokens", zero).alias("tokens"), F.round(F.coalesce("tokens", zero) / F.lit(float(max(total, 1))), 6).alias("actual_share"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
