"""Quality flags of transactions, and their shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import missing

FLAGS = ["flag_untracked_coupon", "flag_missing_info", "flag_pay_or_reduce_amt_abn"]


def untracked(txns: DataFrame, receipts: DataFrame) -> DataFrame:
    """Transactions whose coupon is known and in no receipt of any user."""
    known = receipts.select("Coupon_id_code").where("Coupon_id_code is not null").distinct()
    return txns.where(~missing("Coupon_id_code")).join(known, "Coupon_id_code", "left_anti").select(*txns.columns)


def flag_transactions(txns: DataFrame, receipts: DataFrame, strict: bool = False) -> DataFrame:
    """Three 0/1 flags; ``strict`` leaves out imputed coupons.

    Only the first needs another table: a left join with the distinct coupons. The others read the row itself.
    """
    txns = txns.where("coupon_id_imputed = 0") if strict else txns
    known = receipts.select("Coupon_id_code").where("Coupon_id_code is not null").distinct().withColumn("_known", F.lit(1))
    out = txns.join(known, "Coupon_id_code", "left")
    nulls = [F.col(c).isNull() for c in ("Coupon_type", "Biz_code", "Pay_date", "Actual_pay_cent", "Reduce_amount_cent")]
    codes = [missing(c) for c in ("User_id_code", "Shop_id_code", "Order_id_code")]
    no_coupon = F.coalesce(F.col("flag_no_coupon") == 1, F.lit(False))
    gaps = reduce(lambda a, b: a | b, [*codes, *nulls, missing("Coupon_id_code") & ~no_coupon])
    odd = (F.col("Actual_pay_cent") < 0) | (F.col("Reduce_amount_cent") < 0) | ((F.col("Reduce_amount_cent") > 0) & no_coupon)
    return out.withColumns({
        "flag_untracked_coupon": (~missing("Coupon_id_code") & F.col("_known").isNull()).cast("int"),
        "flag_missing_info": gaps.cast("int"),
        "flag_pay_or_reduce_amt_abn": F.coalesce(odd, F.lit(False)).cast("int"),
    }).select(*txns.columns, *FLAGS)


def flag_shares(flagged: DataFrame, *columns: str) -> DataFrame:
    """flag, n, share: how many rows have each flag set."""
    columns = columns or tuple(FLAGS)
    sums = flagged.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n"), F.when(F.col("rows") > 0, F.col(c) / F.col("rows")).alias("share")) for c in columns])
    return sums.select(F.inline(pairs))
