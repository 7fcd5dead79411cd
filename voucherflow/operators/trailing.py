"""Sums over the days before a day, per key: what as-of joins on prefix sums give, from one window.

A source is rolled up to (key, day), so a key holds at most one row a day however hot it is. One window per key, ordered by the day's number, then
has every look-back as a range frame: ``[day - n, day - 1]``. Probe days that the source lacks come in as empty rows by a union, so
that no as-of join is needed. Rows without a day are left out; they meet nothing when the result is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_sums(daily: DataFrame, keys: list[str], day: str, measures: list[str], lengths: list[int], probes: DataFrame | None = None) -> DataFrame:
    """keys, day, ``{measure}_{n}d`` for each length n, and ``no_history_{n}d``: 1 if the source has no day up to day - n - 1.

    ``daily`` has one row per (keys, day). ``probes`` (keys, day) are further days to answer for.
    """
    rows = daily.where(F.col(day).isNotNull()).withColumn("_is", F.lit(True))
    if probes is not None:
        empty = probes.where(F.col(day).isNotNull()).select(*keys, day).distinct()
        empty = empty.select(*keys, day, *[F.lit(0).cast("long").alias(m) for m in measures], F.lit(False).alias("_is"))
        rows = rows.select(*keys, day, *measures, "_is").unionByName(empty)
        rows = rows.groupBy(*keys, day).agg(*[F.sum(m).alias(m) for m in measures], F.max("_is").alias("_is"))
    number = F.unix_date(day)
    by = W.partitionBy(*keys).orderBy(number)
    first = F.min(F.when(F.col("_is"), number)).over(by.rangeBetween(W.unboundedPreceding, 0))
    out = {}
    for n in lengths:
        for m in measures:
            out[f"{m}_{n}d"] = F.coalesce(F.sum(m).over(by.rangeBetween(-n, -1)), F.lit(0)) if n else F.lit(0)
        out[f"no_history_{n}d"] = (~F.coalesce(first <= number - (n + 1), F.lit(False))).cast("int")
    return rows.select(*keys, day, *[c.alias(k) for k, c in out.items()])


def asof_prefix(events: DataFrame, probes: DataFrame, keys: list[str], day: str, probe_day: str, lag: int = 1) -> DataFrame:
    """Probes with ``n_before``: events of the key up to ``lag`` days before the probe's day, and ``last_day``: the latest of them."""
    daily = events.where(F.col(day).isNotNull()).groupBy(*keys, F.col(day).alias("_day")).agg(F.count("*").alias("_n"))
    asked = probes.where(F.col(probe_day).isNotNull()).select(*keys, F.col(probe_day).alias("_day")).distinct()
    rows = daily.withColumn("_is", F.col("_day")).unionByName(asked.select("*", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("date").alias("_is")))
    rows = rows.groupBy(*keys, "_day").agg(F.sum("_n").alias("_n"), F.max("_is").alias("_is"))
    before = W.partitionBy(*keys).orderBy(F.unix_date("_day")).rangeBetween(W.unboundedPreceding, -lag)
    found = rows.select(*keys, F.col("_day").alias(probe_day), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n_before"), F.max("_is").over(before).alias("last_day"))
    return probes.join(found, [*keys, probe_day], "left").select(*probes.columns, F.coalesce("n_before", F.lit(0)).alias("n_before"), "last_day")
