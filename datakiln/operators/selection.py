"""Exact order statistics, percentiles and heads of an order, over many tasks.

Values are 64-bit whole numbers in ascending order. A pass counts the rows of each cell, the next BITS bits of a value, in the
intervals that hold a wanted rank; the cell that holds it is the next interval. Counts are added up before they are dealt, so
no task sees more than the cells of an interval. Once an interval holds at most SMALL rows its values are counted one by one;
otherwise the bits run out after 64 / BITS passes and all rows left are equal. So neither a sort of all rows nor a buffer of
all values is needed, and equal values cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datakiln.sources.scratch import written

BITS, SMALL = 16, 20_000
_SIGN = -(1 << 63)


def ordered_bits(x: Column) -> Column:
    """Doubles as whole numbers in the same order (NaN last; zeros are equal)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + 0.0).cast("long")
    return _turned(bits)


def from_ordered_bits(k: Column) -> Column:
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _turned(k)).cast("double")


def _turned(bits: Column) -> Column:
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _narrowed(keys: DataFrame, now: DataFrame, high: Column, cell: Column) -> DataFrame:
    """now with the interval of each rank narrowed to the cell that holds it. keys: g, u; now: g, rank, at, below."""
    cells = keys.select("g", high.alias("at"), cell.alias("cell")).join(now.select("g", "at").distinct(), ["g", "at"], "left_semi")
    counts = cells.groupBy("g", "at", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("g", "at").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.col("rank") - F.col("below")
    met = now.select("g", "rank", "at", "below").join(counts, ["g", "at"]).where((F.col("before") <= place) & (place < F.col("before") + F.col("n")))
    return met.select("g", "rank", F.col("cell").alias("at"), (F.col("below") + F.col("before")).alias("below"), "n")


def order_statistics(keys: DataFrame, ranks: DataFrame) -> DataFrame:
    """g, rank, k, below, ties: the value at each wanted rank (from 0), how many are smaller and how many equal.

    keys: g (never null), k (a long, never null), read once a pass; ranks: g, rank. A rank that the group does not have
    gives no row.
    """
    keys = keys.select("g", F.col("k").bitwiseXOR(F.lit(_SIGN)).alias("u"))  # in unsigned order
    zero = F.lit(0).cast("long")
    now, depth, high = ranks.select("g", "rank", zero.alias("at"), zero.alias("below")).distinct(), 0, zero
    while depth < 64:
        cell = F.shiftrightunsigned("u", 64 - BITS - depth)
        now, depth, high = written(_narrowed(keys, now, high, cell), "narrowed"), depth + BITS, cell
        if depth == 64 or (now.agg(F.max("n")).first()[0] or 0) <= SMALL:
            break
    if depth < 64:
        now = written(_narrowed(keys, now, high, F.col("u")), "narrowed")
    return now.select("g", "rank", F.col("at").bitwiseXOR(F.lit(_SIGN)).alias("k"), "below", F.col("n").alias("ties"))


def percentiles(df: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """by, n, q: exact percentiles of each group, linear between neighbouring values. Null groups and values take no part."""
    keys = written(df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(F.col(by).alias("g"), ordered_bits(F.col(value)).alias("k")))
    sizes = keys.groupBy("g").agg(F.count("*").alias("n"))
    wanted = sizes.select("g", "n", F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("i", "share"))
    wanted = wanted.withColumn("place", (F.col("n") - 1) * F.col("share"))
    wanted = written(wanted.withColumns({"low": F.floor("place"), "high": F.ceil("place")}))
    found = order_statistics(keys, wanted.select("g", F.explode(F.array("low", "high")).alias("rank")))
    low, high = (found.select("g", F.col("rank").alias(r), from_ordered_bits(F.col("k")).alias(f"x_{r}")) for r in ("low", "high"))
    between = (F.col("high") - F.col("place")) * F.col("x_low") + (F.col("place") - F.col("low")) * F.col("x_high")
    x = F.when(F.col("low") == F.col("high"), F.col("x_low")).otherwise(between)
    met = wanted.join(low, ["g", "low"]).join(high, ["g", "high"]).groupBy("g", "n").agg(F.array_sort(F.collect_list(F.struct("i", x.alias("x")))).alias("q"))
    return met.select(F.col("g").alias(by), "n", F.col("q.x").alias("q"))


def group_key(by: Sequence[str]) -> Column:
    """One never-null string for the values of by, nulls among them."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def heads(df: DataFrame, by: Sequence[str], quotas: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """The first rows of each group in the order of keys (longs), as many as its quota. quotas: g (group_key), quota.

    Rows that agree in all keys are taken in any order. A group's rows are never brought together: those before the value at
    the last rank are a filter, and of those at that value the next key decides.
    """
    limits = quotas.where("quota > 0").select("g", "quota")
    rows = df.withColumns({"_g": group_key(by), "_k": keys[0]})
    values = written(rows.select(F.col("_g").alias("g"), F.col("_k").alias("k")), "order-keys")
    ends = order_statistics(values, limits.select("g", (F.col("quota") - 1).alias("rank"))).drop("rank")
    cuts = written(limits.join(ends, "g", "left").select("g", F.col("k").alias("_cut"), (F.col("quota") - F.col("below")).alias("_left"), "ties"), "cuts")
    met = rows.join(cuts, F.col("_g") == F.col("g"))
    whole = F.col("_cut").isNull() | (F.col("_k") < F.col("_cut")) | ((F.col("_k") == F.col("_cut")) & (F.col("ties") == F.col("_left")))
    taken = met.where(whole).select(*df.columns)
    open_ends = cuts.where("ties > _left").select("g", F.col("_left").alias("quota"))
    if open_ends.isEmpty():
        return taken
    rest = met.where((F.col("_k") == F.col("_cut")) & (F.col("ties") > F.col("_left"))).select(*df.columns)
    if len(keys) > 1:
        return taken.unionByName(heads(rest, by, open_ends, keys[1:]))
    named = written(rest.withColumn("_id", F.monotonically_increasing_id()), "ties")
    return taken.unionByName(heads(named, by, open_ends, [F.col("_id")]).drop("_id"))


def hash_keys(order: Column) -> list[Column]:
    """The leading 120 bits of a hex digest as two longs in its order."""
    return [F.conv(F.substring(order, at, 15), 16, 10).cast("long") for at in (1, 16)]
