"""Problem 7: groups of near-duplicate records, by an exact set-similarity join.

Method: grouped prefix join. A record is the set of its shingles. Records with the same set form one class, so copies
cost nothing; one record represents a class. Shingles are ordered from rare to common; two sets can reach the similarity
only if their prefixes, short in that order, share a shingle. Classes with the same prefix and size form one group;
groups are joined on prefix shingles, and a pair of groups survives only if sizes, positions and a parity bitmap of the
sets allow the similarity. Surviving pairs of groups are expanded to their classes, which are compared exactly.

Shingles that one class only has join nothing: they are counted once, and from then on a class is the short list of the
shingles it shares with others and the number of all it has. No step moves whole sets.

All filters are lossless: with t the similarity, sets x and y of sizes nx >= ny reach it only if they share at least
a = t / (1 + t) * (nx + ny) shingles. Then ny >= t * nx; the first shared shingle lies at positions i, j (from 1) with
1 + min(nx - i, ny - j) >= a; and the parity bitmaps of the shared parts, of sizes cx and cy, differ in at most
cx + cy - 2a bits, as each differing bit needs an element of the symmetric difference.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwell.llm.common import saved, tokens

WORDS = 8  # the parity bitmap of a set, as longs


def shingles(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``size`` consecutive words; empty for shorter texts."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))),
    )
    return F.array_distinct(F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>")))


def _bitmap(values: Column) -> list[Column]:
    """b0, b1, ...: bit k of the bitmap is the parity of the number of values that hash to k."""
    zero = F.lit(0).cast("bigint")

    def word(k: int) -> Column:
        mine = F.filter(values, lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(WORDS)) == k)
        bit = F.transform(mine, lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int")))
        return F.aggregate(bit, zero, lambda all_bits, one: all_bits.bitwiseXOR(one)).alias(f"b{k}")

    return [word(k) for k in range(WORDS)]


def _least(similarity: float, a: Column, b: Column) -> Column:
    """The least number of common shingles of two sets of these sizes that reach the similarity."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (a + b) - F.lit(1e-9))


def shared_parts(exploded: DataFrame, sizes: DataFrame) -> DataFrame:
    """(k, n, ordered): of each class the number of its shingles and, rare ones first, those that other classes have too.

    ``exploded`` is (k, h), one row a shingle of a class, ``sizes`` (k, n).
    """
    shared = saved(exploded.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    parts = exploded.join(shared, "h").groupBy("k").agg(F.sort_array(F.collect_set(F.struct("f", "h"))).alias("c"))
    return parts.join(sizes, "k").select("k", "n", F.col("c.h").alias("ordered"))


def class_pairs(parts: DataFrame, similarity: float) -> DataFrame:
    """(x, y, common, nx, ny), x and y classes whose similarity is at least ``similarity``; parts: (k, n, ordered) of ``shared_parts``."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    t, n, size = F.lit(similarity), F.col("n"), F.size("ordered")
    probe = (n - F.ceil(t * n - F.lit(1e-9)) + 1).cast("int")
    sized = parts.withColumn("c", size).withColumn("alone", (n - size).cast("int"))
    # Single shingles are the rarest: they fill the head of the order and of the prefix, of which the rest is kept.
    keyed = sized.withColumn("prefix", F.slice("ordered", F.lit(1), F.greatest(probe - F.col("alone"), F.lit(0)))).where(F.size("prefix") > 0)
    # Groups: classes of one size whose prefixes are equal, single shingles included. A class with single shingles in
    # its prefix has a prefix of its own.
    own = F.when(F.col("alone") > 0, F.col("k").cast("string"))
    alike = F.concat_ws("|", n.cast("string"), F.array_join(F.transform("prefix", lambda h: h.cast("string")), ","), own)
    named = saved(keyed.withColumn("alike", F.md5(alike)).select("*", *_bitmap(F.col("ordered"))))
    first = named.groupBy("alike").agg(F.min("k").alias("g"), F.count(F.lit(1)).alias("members"))
    several = first.where("members > 1").select("alike", "g", "members")  # most classes are a group by themselves
    grouped = named.join(several, "alike", "left").withColumn("g", F.coalesce("g", "k")).withColumn("members", F.coalesce("members", F.lit(1).cast("bigint")))
    grouped = saved(grouped.drop("alike"))
    # A group of several classes has no single bitmap or size of the shared part: the filter passes it (members > 1), its
    # classes are compared when they are expanded.
    groups = grouped.where("g = k")
    posted = groups.select(
        "g", "n", "c", "members", *(f"b{k}" for k in range(WORDS)), F.col("alone"), F.posexplode("prefix").alias("at", "h")
    ).withColumn("pos", F.col("alone") + F.col("at") + 1)
    index_length = F.col("n") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("n") - F.lit(1e-9)) + 1
    columns = ["h", "g", "n", "c", "pos", "members", *(f"b{k}" for k in range(WORDS))]
    x = posted.select(*(F.col(c).alias(f"x_{c}") for c in columns))
    y = posted.where(F.col("pos") <= index_length).select(*(F.col(c).alias(f"y_{c}") for c in columns))
    least = _least(similarity, F.col("x_n"), F.col("y_n"))
    differing = sum((F.bit_count(F.col(f"x_b{k}").bitwiseXOR(F.col(f"y_b{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("x_b0").bitwiseXOR(F.col("y_b0"))))
    on = (
        (F.col("x_h") == F.col("y_h"))
        & ((F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_g") < F.col("x_g"))))
        & (F.col("y_n") >= t * F.col("x_n") - F.lit(1e-9))
        & (1 + F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= least)
        & (
            (F.col("x_members") > 1) | (F.col("y_members") > 1)
            | ((F.least("x_c", "y_c") >= least) & (differing <= F.col("x_c") + F.col("y_c") - 2 * least))
        )
    )
    between = x.join(y, on).select(F.col("x_g").alias("gx"), F.col("y_g").alias("gy")).distinct()
    within = groups.where("members > 1").select(F.col("g").alias("gx"), F.col("g").alias("gy"))
    candidates = between.unionByName(within)
    members = grouped.select("g", "k", "n", "ordered")
    mx = members.select(F.col("g").alias("gx"), F.col("k").alias("x"), F.col("n").alias("nx"), F.col("ordered").alias("sx"))
    my = members.select(F.col("g").alias("gy"), F.col("k").alias("y"), F.col("n").alias("ny"), F.col("ordered").alias("sy"))
    compared = (
        candidates.join(mx, "gx")
        .join(my, "gy")
        .where((F.col("gx") != F.col("gy")) | (F.col("x") < F.col("y")))
        .where(F.least(F.size("sx"), F.size("sy")) >= _least(similarity, F.col("nx"), F.col("ny")))
        .select("x", "y", "nx", "ny", F.size(F.array_intersect("sx", "sy")).alias("common"))
    )
    return compared.where(F.col("common") >= t * (F.col("nx") + F.col("ny") - F.col("common")) - F.lit(1e-9))


def shingle_classes(df: DataFrame, record: str, text: str, size: int, min_tokens: int = 0) -> DataFrame:
    """(record, class, shingles): the shingle set of each text with at least ``min_tokens`` words and one shingle.

    ``class`` is a hash of 128 bits, the same for records with the same set. Null texts and shorter texts have no row.
    """
    words = df.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(
        F.col(record).alias("record"), tokens(F.col(text)).alias("words")
    )
    sets = words.where(F.size("words") >= max(min_tokens, size)).select(
        "record", F.array_sort(shingles(F.col("words"), size)).alias("shingles")
    )
    name = F.concat(F.hex(F.xxhash64("shingles")), F.lit("-"), F.hex(F.xxhash64(F.lit(size), "shingles")))
    return sets.select("record", name.alias("class"), "shingles")


def near_duplicates(df: DataFrame, record: str, text: str, size: int = 5, similarity: float = 0.8, min_tokens: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (record, class) of every record that has shingles, pairs (x, y) of similar classes.

    Records of one class are similar too (similarity 1) and have no pair. Shingles are hashed to 64 bits, sets to 128.
    """
    sets = saved(shingle_classes(df, record, text, size, min_tokens))
    members = sets.select("record", "class", F.size("shingles").alias("n"))
    # The lowest record of a class represents it.
    lowest = saved(members.groupBy("class").agg(F.min("record").alias("k"), F.first("n").alias("n")))
    chosen = sets.join(lowest.select(F.col("k").alias("record"), "class"), ["record", "class"], "left_semi")
    exploded = chosen.select(F.col("record").alias("k"), F.explode("shingles").alias("h"))
    pairs = class_pairs(shared_parts(exploded, lowest.select("k", "n")), similarity)
    names = lowest.select("k", "class")
    x, y = names.withColumnsRenamed({"k": "x", "class": "cx"}), names.withColumnsRenamed({"k": "y", "class": "cy"})
    return members.select("record", "class"), pairs.join(x, "x").join(y, "y").select(F.col("cx").alias("x"), F.col("cy").alias("y"), "common", "nx", "ny")


def short_texts(df: DataFrame, record: str, text: str, size: int) -> DataFrame:
    """(record, class) of the texts that have no shingle: equal lists of words form a class, null and empty texts one each."""
    words = tokens(F.col(text))
    name = F.when(F.col(text).isNull(), "null").otherwise(F.concat(F.lit("words-"), F.md5(F.array_join(words, " "))))
    return df.where(F.col(record).isNotNull() & (F.col(text).isNull() | (F.size(words) < size))).select(F.col(record).alias("record"), name.alias("class"))


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of records in similar classes or in one class. As large as its result has to be."""
    edges = pairs.select("x", "y")
    several = members.groupBy("class").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("class").alias("x"), F.col("class").alias("y"))
    edges = edges.unionByName(several)
    a = members.select(F.col("record").alias("p"), F.col("class").alias("x"))
    b = members.select(F.col("record").alias("q"), F.col("class").alias("y"))
    both = edges.join(a, "x").join(b, "y").where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record, class, copies, links): one row per record; links counts the other classes similar to its class.

    Records without shingles have a row if ``short_texts`` are among the members; they have no links.
    """
    both = pairs.select(F.col("x").alias("class")).unionByName(pairs.select(F.col("y").alias("class")))
    links = both.groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(sizes, "class").join(links, "class", "left").select("record", "class", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def groups(members: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(record, group): records joined by chains of similar classes; the group is its lowest record. Singles are left out.

    Connected components of the classes by repeated label minimum with pointer jumping; each round's labels are written
    to the checkpoint folder. Stops when nothing changes; a chain that needs more than ``max_rounds`` raises.
    """
    edges = pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    edges = saved(edges)
    labels = saved(edges.select(F.col("x").alias("v")).distinct().select("v", F.col("v").alias("label")))
    for _ in range(max_rounds):
        near = edges.join(labels, F.col("y") == F.col("v")).groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("v") == F.col("x")).select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("at"), F.col("label").alias("root"))
        following = saved(lower.join(jump, F.col("low") == F.col("at"), "left").select("v", F.least("low", F.coalesce("root", "low")).alias("new"), "label"))
        changed = following.where("new <> label").limit(1).count()
        labels = following.select("v", F.col("new").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    found = members.join(labels, F.col("class") == F.col("v"), "left").select("record", F.coalesce("label", "class").alias("label"))
    named = found.groupBy("label").agg(F.min("record").alias("group"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return found.join(named, "label").select("record", "group")
