"""Exact quantiles that never gather a group's values in one task.

Spark's ``percentile`` buffers all distinct values of a group. Here the value
range of each group is cut into buckets, only counts per bucket are shuffled,
and just the buckets that hold a wanted rank are cut again, until few values
remain. Those are counted by distinct value and the rank is read off.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.session import held, materialize, one_row

#: Keys whose ranges may enter a plan as constants.
FEW_KEYS = 64


def _bucket(value: Column, lo: Column, hi: Column, buckets: int, first: bool) -> Column:
    """Bucket number of a value in [lo, hi]; never decreases as the value grows.

    The first cut is logarithmic, so a few far-off values do not leave all others
    in one bucket; later cuts are even.
    """
    def scale(x: Column) -> Column:
        return F.signum(x) * F.log1p(F.abs(x)) if first else x

    low, high = scale(lo), scale(hi)
    number = F.floor((scale(value) - low) / (high - low) * buckets).cast("long")
    return F.when(high > low, F.least(number, F.lit(buckets - 1).cast("long"))).otherwise(F.lit(0).cast("long"))


def _wanted_ranks(sized: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """0-based lower and upper rank of each probability, one row per rank."""
    spots = F.explode(F.array(*[F.struct(F.lit(p).alias("prob")) for p in probs])).alias("s")
    ranks = sized.select(*keys, "n", "lo", "hi", spots).select(
        *keys, "lo", "hi", "n", F.col("s.prob").alias("prob"), (F.col("s.prob") * (F.col("n") - 1)).alias("pos")
    )
    ends = F.explode(F.array(
        F.struct(F.lit("low").alias("side"), F.floor("pos").alias("rank")),
        F.struct(F.lit("high").alias("side"), F.least(F.floor("pos") + 1, F.col("n") - 1).alias("rank")),
    )).alias("e")
    return ranks.select(*keys, "lo", "hi", "n", "prob", (F.col("pos") - F.floor("pos")).alias("frac"), ends).select(
        *keys, "lo", "hi", "n", "prob", "frac", F.col("e.side").alias("side"), F.col("e.rank").alias("rank")
    )


def _rows_in_open_ranges(rows: DataFrame, wanted: DataFrame, key: list[str], few_keys: bool) -> DataFrame:
    """Rows inside a range that still holds a wanted rank, with that range.

    A key has at most two open ranges per probability and they never overlap, so
    they travel as one short array per key.
    """
    open_ranges = wanted.groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("_open"))
    if few_keys:
        found = open_ranges.limit(FEW_KEYS + 1).collect()
        if len(found) > FEW_KEYS:
            raise ValueError(f"few_keys is for at most {FEW_KEYS} keys")
        by_key = {tuple(r[k] for k in key): r["_open"] for r in found}
        opened = F.lit(None).cast("array<struct<lo:double,hi:double>>")
        for values, ranges in by_key.items():
            same = F.lit(True)
            for k, v in zip(key, values):
                same = same & (F.col(k) == F.lit(v))
            lit = F.array(*[F.struct(F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi")) for r in ranges])
            opened = F.when(same, lit).otherwise(opened)
        marked = rows.withColumn("_open", opened)
    else:
        marked = rows.join(open_ranges, key)
    hit = F.filter("_open", lambda r: F.col("v").between(r["lo"], r["hi"]))
    return (
        marked
        .withColumn("_hit", F.try_element_at(hit, F.lit(1)))
        .filter(F.col("_hit").isNotNull())
        .select(*key, "v", F.col("_hit.lo").alias("lo"), F.col("_hit.hi").alias("hi"))
    )


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None,
                    buckets: int = 1024, max_rows: int = 100_000, few_keys: bool = False) -> DataFrame:
    """``keys..., prob, value`` with linear interpolation between the two nearest ranks.

    Ranges are cut until none holds more than ``max_rows`` rows (or only one
    value is left), so the last step sorts a bounded number per task. Without
    keys, or with ``few_keys`` (at most ``FEW_KEYS`` keys, checked), the
    ranges enter the plan as constants and the rows are not shuffled at all;
    otherwise the key join follows the table sizes and splits hot keys at run
    time. ``df`` is read once per cut and twice more: pass a written table.
    """
    few_keys = few_keys or not keys
    keys = list(keys or [])
    key = keys or ["_all"]
    rows = df.select(*keys, *([] if keys else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sized = rows.groupBy(*key).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    keep = held if few_keys else partial(materialize, name="ranks")
    wanted = keep(_wanted_ranks(sized, key, probs))

    first = True
    while True:
        widest = F.max(F.when(F.col("lo") < F.col("hi"), F.col("n"))).alias("widest")
        if (one_row(wanted.agg(widest))["widest"] or 0) <= max_rows:
            break
        inside = _rows_in_open_ranges(rows, wanted, key, few_keys)
        counts = (
            inside.groupBy(*key, "lo", "hi", _bucket(F.col("v"), F.col("lo"), F.col("hi"), buckets, first).alias("b"))
            .agg(F.count("v").alias("c"), F.min("v").alias("blo"), F.max("v").alias("bhi"))
        )
        run = Window.partitionBy(*key, "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("c").over(run))
        wanted = keep(
            wanted.drop("n").join(upto, [*key, "lo", "hi"])
            .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
            .select(*key, F.col("blo").alias("lo"), F.col("bhi").alias("hi"), F.col("c").alias("n"), "prob", "frac",
                    "side", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"))
        )
        first = False

    values = (
        _rows_in_open_ranges(rows, wanted, key, few_keys)
        .groupBy(*key, "lo", "hi", "v").agg(F.count("v").alias("c"))
    )
    run = Window.partitionBy(*key, "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = values.withColumn("upto", F.sum("c").over(run))
    found = wanted.join(upto, [*key, "lo", "hi"]).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
    )
    low = F.max(F.when(F.col("side") == "low", F.col("v")))
    high = F.max(F.when(F.col("side") == "high", F.col("v")))
    return found.groupBy(*key, "prob").agg((low + (high - low) * F.max("frac")).alias("value")).select(
        *keys, "prob", "value"
    )


def small_group_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str], names: list[str]) -> DataFrame:
    """Quantiles per group for groups with a bounded size, such as one value per month."""
    spots = F.percentile(value, F.array(*[F.lit(p) for p in probs]))
    return df.groupBy(*keys).agg(spots.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(names)]
    )
