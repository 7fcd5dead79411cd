"""CSV and Parquet in and out, the column catalog, parameters, and metrics records."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.scalars import dnf, money_to_cents, to_day, to_long


def require(df: DataFrame, columns: Iterable[str], name: str) -> None:
    """ValueError that names what is missing."""
    lost = sorted(set(columns) - set(df.columns))
    if lost:
        raise ValueError(f"[{name}] missing columns: {lost}")


def read_csv_text(spark: SparkSession, path: str, columns: list[str], name: str, nrows: int | None = None) -> DataFrame:
    """All columns as text, those of the header that are not required too; the first ``nrows`` if given."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    require(df, columns, name)
    return df if nrows is None else df.limit(nrows)


def read_transactions(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    df = read_csv_text(spark, path, schemas.RAW_TXN, "transactions", nrows)
    return df.withColumns({
        "Pay_date": to_day("Pay_date"), "Coupon_type": to_long("Coupon_type"),
        "Actual_pay_cent": money_to_cents("Actual_pay"), "Reduce_amount_cent": money_to_cents("Reduce_amount"),
    }).drop("Actual_pay", "Reduce_amount")


def read_receipts(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    df = read_csv_text(spark, path, schemas.RAW_RECEIPT, "receipts", nrows)
    days = {c: to_day(c) for c in ("Receive_date", "Start_date", "End_date")}
    cents = {f"{c}_cent": money_to_cents(c) for c in ("Coupon_amt", "Price_limit")}
    return df.withColumns({**days, **cents, "Coupon_status": to_long("Coupon_status")}).drop("Coupon_amt", "Price_limit")


def read_visits(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    return read_csv_text(spark, path, schemas.RAW_VISIT, "visits", nrows).withColumn("Visit_date", to_day("Visit_date"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | str = "all", filters: list | None = None) -> DataFrame:
    """Projected and filtered by the Parquet scan: the DNF is pushed down with the column list."""
    df = spark.read.parquet(path)
    keep = dnf(filters or [])
    df = df if keep is None else df.where(keep)
    return df if columns == "all" else df.select(*columns)


def days_only(df: DataFrame) -> DataFrame:
    """Timestamps to days: the domain tables are day-grained."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.to_date(c) for c in stamps}) if stamps else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Typed by the given schema; types are never inferred, which would read the file twice."""
    return spark.read.csv(path, header=True, schema=schema)


def one_column(spark: SparkSession, name: str, values: Iterable, kind: str) -> DataFrame:
    """An array parameter as a table."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def column_catalog(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the file's schema alone."""
    return spark.read.parquet(path).columns


def save_json(value: object, path: str) -> None:
    """Column lists and parameters: small, on the driver's side."""
    with open(path, "w") as f:
        json.dump(value, f, indent=1)


def load_json(path: str) -> object:
    with open(path) as f:
        return json.load(f)


def save_params(params: dict, path: str) -> None:
    """A flat parameter file of ``key: value`` lines, which YAML readers read."""
    with open(path, "w") as f:
        f.writelines(f"{k}: {json.dumps(v)}\n" for k, v in sorted(params.items()))


def load_params(path: str) -> dict:
    """Flat ``key: value`` lines; a value that is no JSON is text."""

    def value(text: str) -> object:
        try:
            return json.loads(text)
        except ValueError:
            return text.strip("'\"")

    with open(path) as f:
        rows = [x.split("#")[0].strip() for x in f]
    return {k.strip(): value(v.strip()) for k, _, v in (x.partition(":") for x in rows if ":" in x)}


def append_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """One row a run: names and values as JSON, appended."""
    write_parquet(spark.createDataFrame([(json.dumps(metrics, sort_keys=True, default=str),)], "metrics string"), path, "append")
