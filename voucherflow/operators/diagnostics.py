"""Validity and redemption by segment box."""

from __future__ import annotations

from itertools import pairwise, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schemas import BINS

COLUMNS = ["Price_limit_upper_bin", "Coupon_limit_upper_bin", "Expiry_span_upper_bin", "validity_pc", "redeem_fh_pc", "redeem_st_pc", "receipts_count"]


def boxes(price: list[int], coupon: list[int], expiry: list[int]) -> list[tuple[int, ...]]:
    """(box, and the two bounds of price, coupon and days) of the Cartesian grid."""
    top = 1_000_000_000_000_000
    axes = [list(pairwise([0, *price, top])), list(pairwise([0, *coupon, top])), list(pairwise([0, *expiry, 365]))]
    return [(i, *a, *b, *c) for i, (a, b, c) in enumerate(product(*axes))]


def segment_report(labelled: DataFrame, price: list[int] | None = None, coupon: list[int] | None = None, expiry: list[int] | None = None) -> DataFrame:
    """One row a box, equal rows once. Bounds are inclusive on both sides, so a receipt on a split counts in two boxes; receipts with nulls in none.

    One pass: a receipt is put into its boxes by an array expression over the grid, which is a literal, so there is no join
    with the receipts; box ids are aggregated map-side and the empty boxes come back by a join with the small grid.
    """
    grid = boxes(price or [1000, 10000], coupon or [1000, 10000], expiry or [10])
    span = F.datediff("End_date", "Start_date")
    inside = [F.when(F.col("Price_limit_cent").between(a, b) & F.col("Coupon_amt_cent").between(c, d) & span.between(e, f), F.lit(i)) for i, a, b, c, d, e, f in grid]
    placed = labelled.select("Price_limit_cent", "Coupon_amt_cent", span.alias("span"), "label_valid", "label_same_user_fh", "label_same_user_st", F.explode(F.array_compact(F.array(*inside))).alias("box"))
    sums = placed.groupBy("box").agg(
        F.max("Price_limit_cent").alias("Price_limit_upper_bin"), F.max("Coupon_amt_cent").alias("Coupon_limit_upper_bin"), F.max("span").alias("Expiry_span_upper_bin"),
        *[F.sum(c).alias(c) for c in ("label_valid", "label_same_user_fh", "label_same_user_st")], F.count("*").alias("n"),
    )
    all_boxes = labelled.sparkSession.range(len(grid)).select(F.col("id").cast("int").alias("box"))
    share = lambda c: F.when(F.col("n") > 0, ratio(F.col(c) * 100, F.col("n"), 2))
    out = all_boxes.join(sums, "box", "left").withColumns({"validity_pc": share("label_valid"), "redeem_fh_pc": share("label_same_user_fh"), "redeem_st_pc": share("label_same_user_st"), "receipts_count": F.coalesce("n", F.lit(0))})
    return out.select(*COLUMNS).distinct()


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Distinct union by column name; a column that a frame lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.distinct()


def segment_rates(receipts: DataFrame, label: str = "label_same_user_st") -> DataFrame:
    """Sum, count and rate of a label in each segment."""
    return receipts.groupBy(*BINS).agg(F.sum(label).cast("long").alias("redeemed"), F.count("*").alias("n")).withColumn("rate", ratio(F.col("redeemed"), F.col("n")))


def receipt_flag_shares(labelled: DataFrame) -> DataFrame:
    """Share of each receipt flag, and of receipts redeemed more than once among those redeemed."""
    from .flags import flag_shares

    flags = ["flag_early", "flag_late", "flag_cross_user", "flag_struc_invalid", "flag_repeat"]
    return flag_shares(labelled.withColumn("flag_repeat", (F.col("same_user_valid_txn_count") > 1).cast("int")), *flags)
