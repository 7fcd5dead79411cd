"""Deduplication, narrow types, dictionary codes, surrogate keys, and data-quality counts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MISSING
from ..sources.scratch import written

INTEGERS = [("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31)]
FLOAT_MAX = 3.4028234663852886e38


def dedupe(*frames: DataFrame) -> tuple[DataFrame, ...]:
    """Whole rows that repeat, once; nulls equal each other."""
    return tuple(df.distinct() for df in frames)


def extent(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row: the least and the greatest value of each column."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def narrow(df: DataFrame) -> DataFrame:
    """Each number in the narrowest type whose bounds lie strictly outside its values; one pass finds all extents."""
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.FractionalType)) and not isinstance(f.dataType, T.DecimalType)]
    if not numeric:
        return df
    seen = extent(df, [f.name for f in numeric]).first()
    casts = {}
    for f in numeric:
        low, high = seen[f"min_{f.name}"], seen[f"max_{f.name}"]
        if low is None:
            continue
        if isinstance(f.dataType, T.IntegralType):
            casts[f.name] = next((t for t, m in INTEGERS if -m < low and high < m - 1), "bigint")
        else:
            casts[f.name] = "float" if -FLOAT_MAX < low and high < FLOAT_MAX else "double"
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})


def dense_index(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds 0..n-1 in the given order, without a single-partition window and without Python rows.

    The rows are range-sorted and written with their place inside their partition; a row per partition then gives
    each partition's offset. Writing fixes the partitions: sorted anew, the sampled bounds could differ between the two uses. The order must be total, or rows
    that tie swap indexes between runs.
    """
    sorted_ = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())  # partition * 2**33 + place
    sorted_ = written(sorted_, "dense-index")
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_offset"))
    out = sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row a partition
    return out.select(*df.columns, (F.col("_offset") + (F.col("_at") - F.shiftleft("_part", 33))).alias(name))


def dictionary(column: str, *frames: DataFrame) -> DataFrame:
    """value -> code 0..n-1 over all frames, in order of value; only distinct values are indexed."""
    values = reduce(DataFrame.union, [df.select(F.col(column).alias("value")) for df in frames]).where("value is not null").distinct()
    return dense_index(values, "code", F.col("value"))


def encode_ids(columns: str | list[str], *frames: DataFrame, suffix: str = "_code", tight: bool = False) -> tuple[tuple[DataFrame, ...], dict[str, DataFrame]]:
    """Every column as codes shared by the frames, missing as -1; and the dictionaries, as tables.

    ``tight``: codes in the narrowest type that holds the whole dictionary's, so that the frames' types agree; otherwise bigint.
    """
    columns = [columns] if isinstance(columns, str) else columns
    maps = {}
    for c in columns:
        maps[c] = dictionary(c, *[df for df in frames if c in df.columns])
        last = (maps[c].agg(F.max("code")).first()[0] or 0) if tight else INTEGERS[-1][1]
        kind = next((t for t, m in INTEGERS if last < m), "bigint")
        coded = maps[c].select(F.col("value").alias(c), F.col("code").alias(c + suffix))
        frames = tuple(df.join(coded, c, "left").withColumn(c + suffix, F.coalesce(c + suffix, F.lit(MISSING)).cast(kind)) if c in df.columns else df for df in frames)
    return frames, maps


def drop_originals(columns: str | list[str], *frames: DataFrame, suffix: str = "_code") -> tuple[DataFrame, ...]:
    """Without the ids whose codes are there."""
    columns = [columns] if isinstance(columns, str) else columns
    return tuple(df.drop(*[c for c in columns if c + suffix in df.columns]) for df in frames)


def add_key(df: DataFrame, name: str) -> DataFrame:
    """A dense surrogate key in the order of all columns: the same rows get the same keys in every run."""
    return dense_index(df, name, *[F.asc_nulls_last(c) for c in df.columns])


def add_keys(txns: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return add_key(txns, "txn_key"), add_key(receipts, "receipt_key")


def assert_unique(df: DataFrame, key: str) -> None:
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls, rows: one pass, one row a column."""
    names = df.columns
    counts = df.agg(F.count("*").alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(f"n{i}", F.lit(0)).alias("nulls"), "rows") for i, c in enumerate(names)])
    return counts.select(F.inline(pairs))


def inconsistent(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys with more than one distinct value in any of the columns, and how many each has."""
    out = df.groupBy(key).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])
    return out.where(reduce(lambda a, b: a | b, [F.col(f"n_{c}") > 1 for c in columns]))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def same_values(a: DataFrame, b: DataFrame, column: str) -> bool:
    """Whether both hold the same set of values."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
