"""Class weights, accuracy by class, ROC AUC, and profit of scored receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clean import dense_index


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows / rows of the class. The classes' table is joined back, so no window holds a whole class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))  # a row a class
    weights = sizes.select(F.col(label).alias("_class"), (F.sum("_n").over(W.partitionBy()) / F.col("_n")).alias("weight"))
    return df.join(weights, F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")


def class_accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", which: int = 1, thresholds: tuple[float, ...] = (0.25, 0.5, 0.75), exact: bool = False) -> DataFrame:
    """threshold, accuracy: share of the class predicted as such, the class 1 from the threshold on; 0 without the class; 3 places unless exact."""
    mine = F.col(y_true) == which
    hit = lambda t: (F.col(y_pred) >= t) if which == 1 else ~F.coalesce(F.col(y_pred) >= t, F.lit(False))
    sums = df.agg(F.count(F.when(mine, 1)).alias("n"), *[F.count(F.when(mine & hit(t), 1)).alias(f"h{i}") for i, t in enumerate(thresholds)])
    share = lambda i: F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col(f"h{i}") / F.col("n"))
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (share(i) if exact else F.rint(share(i) * 1000) / 1000).alias("accuracy")) for i, t in enumerate(thresholds)])
    return sums.select(F.inline(rows))


def roc_auc(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row, auc: exact, ties count half. Null if a class is absent.

    Scores are counted by value first; the cumulated negatives are found in two steps, inside range partitions of the scores and over the partitions'
    totals, so no task holds all scores.
    """
    counts = df.where(F.col(y_pred).isNotNull()).groupBy(F.col(y_pred).alias("s")).agg(F.count(F.when(F.col(y_true) == 1, 1)).alias("p"), F.count(F.when(F.col(y_true) == 0, 1)).alias("q"))
    parts = counts.repartitionByRange(F.col("s")).withColumn("part", F.spark_partition_id())
    inside = F.coalesce(F.sum("q").over(W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("below", inside)
    totals = parts.groupBy("part").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.sum(F.col("p") * (2 * F.col("below") + F.col("q"))).alias("wins2"))
    # a row a partition, from here on
    before = F.coalesce(F.sum("tq").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    all_ = totals.withColumn("before", before).agg(F.sum(F.col("wins2") + 2 * F.col("tp") * F.col("before")).alias("w"), F.sum("tp").alias("p"), F.sum("tq").alias("q"))
    pairs = 2 * F.col("p").cast("double") * F.col("q").cast("double")
    return all_.select(F.when(pairs > 0, F.col("w") / pairs).alias("auc"))


def top_share(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", profit: str = "Actual_pay_cent", share: float = 0.05, tie: str | None = None) -> DataFrame:
    """One row: rate, profit and n of the best-scored ``share`` of the rows, rounded up; equal scores go by ``tie``, the smaller first.

    Rows are ranked by a distributed index, so a share of any size is cut without gathering it.
    """
    order = [F.desc_nulls_last(y_pred), *([F.asc(tie)] if tie else [F.desc(y_true), F.desc(profit)])]
    ranked = dense_index(df.select(*dict.fromkeys([y_true, y_pred, profit, *([tie] if tie else [])])), "_rank", *order)
    n = -(-ranked.count() * round(share * 10_000) // 10_000)
    return ranked.where(F.col("_rank") < n).agg(F.avg(y_true).alias("rate"), F.avg(profit).alias("profit"), F.count("*").alias("n"))


def profit_at(df: DataFrame, y_pred: str = "y_pred", profit: str = "Actual_pay_cent", thresholds: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """threshold, n, profit: mean profit of the receipts predicted as redeemed; null if there is none."""
    over = lambda t: F.col(y_pred) >= t
    sums = df.agg(*[F.count(F.when(over(t), 1)).alias(f"n{i}") for i, t in enumerate(thresholds)], *[F.sum(F.when(over(t), F.col(profit))).alias(f"s{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).alias("profit")) for i, t in enumerate(thresholds)])
    return sums.select(F.inline(rows))


def mean_profit(df: DataFrame, profit: str = "Actual_pay_cent") -> DataFrame:
    return df.agg((F.sum(profit) / F.count("*")).alias("profit"), F.count("*").alias("n"))


def with_net_profit(test: DataFrame, labelled: DataFrame, txns: DataFrame) -> DataFrame:
    """Adds Actual_pay_cent: what the receipt's first valid transaction paid, 0 if there was none."""
    first = labelled.select("receipt_key", F.col("first_valid_txn_key").alias("txn_key")).where("txn_key is not null")
    paid = first.join(txns.select("txn_key", "Actual_pay_cent"), "txn_key").select("receipt_key", "Actual_pay_cent")
    return test.join(paid, "receipt_key", "left").withColumn("Actual_pay_cent", F.coalesce("Actual_pay_cent", F.lit(0)))


def mean_of_folds(values: list[Column | float]) -> Column:
    cols = [v if isinstance(v, Column) else F.lit(float(v)) for v in values]
    return sum(cols[1:], cols[0]) / len(cols)
