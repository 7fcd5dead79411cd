"""Features of labelled receipts: of the coupon, of its segment's past and of its user's past.

``lookback_days`` w covers the w - 1 days before the receipt; columns are named by w - 1, as in ``Rate_invalid_7d`` for w = 8. Past
labels are the final ones: they may have been settled after the receipt that looks back on them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import BINS, HOLIDAYS, LABELS, WORKDAYS
from .trailing import trailing_sums

OUTCOMES = {"invalid": "label_invalid", "fh_redeem": "label_same_user_fh", "st_redeem": "label_same_user_st"}


def _rate(n: str, d: str) -> Column:
    return S.ratio(F.coalesce(n, F.lit(0)), F.coalesce(d, F.lit(0)))


def _outcomes_by_day(receipts: DataFrame, keys: list[str]) -> DataFrame:
    return receipts.groupBy(*keys, "Receive_date").agg(*[F.sum(c).cast("long").alias(k) for k, c in OUTCOMES.items()], F.count("*").alias("vol"))


def coupon_scalars(labelled: DataFrame, price_splits: list[int] | None = None, coupon_splits: list[int] | None = None, expiry_split: int = 10, holidays: list[date] | None = None, workdays: list[date] | None = None) -> DataFrame:
    """Bins, generosity, precedence and calendar markers; row by row."""
    keep = ["receipt_key", "User_id_code", "Coupon_id_code", "Price_limit_cent", "Coupon_amt_cent", "Receive_date", "Start_date", "End_date"]
    invalid = F.when(F.col("label_valid") == 1, 0).otherwise(1).alias("label_invalid")
    return labelled.select(
        *keep, invalid, "label_same_user_fh", "label_same_user_st",
        S.amount_bin("Price_limit_cent", price_splits or [1000, 10000]).alias("Price_limit_bin"), S.amount_bin("Coupon_amt_cent", coupon_splits or [1000, 10000]).alias("Coupon_limit_bin"),
        S.expiry_bin(expiry_split).alias("Expiry_span_bin"), S.generosity().alias("Generosity_ratio"),
        S.before_receipt("Start_date").alias("Start_bf_receive_marker"), S.before_receipt("End_date").alias("End_bf_receive_marker"),
        S.weekday_marker().alias("Weekday_marker"), S.workday_marker(WORKDAYS if workdays is None else workdays).alias("Workday_marker"), S.holiday_marker(HOLIDAYS if holidays is None else holidays).alias("Holiday_marker"),
    )


def segment_lookback(receipts: DataFrame, lookback_days: list[int]) -> DataFrame:
    """Adds the segment's rates. Segments are few, so their (segment, day) table is small and Spark broadcasts it by its size."""
    n = [w - 1 for w in lookback_days]
    past = trailing_sums(_outcomes_by_day(receipts, BINS), BINS, "Receive_date", [*OUTCOMES, "vol"], n)
    out = receipts.join(past, [*BINS, "Receive_date"], "left")
    new = {}
    for d in n:
        new[f"no_history_indicator_{d}d"] = F.coalesce(f"no_history_{d}d", F.lit(1))
        new |= {f"Rate_{k}_{d}d": _rate(f"{k}_{d}d", f"vol_{d}d") for k in OUTCOMES}
    return out.withColumns(new).select(*receipts.columns, *new)


def coupon_features(labelled: DataFrame, lookback_days: list[int] | None = None, **splits) -> DataFrame:
    return segment_lookback(coupon_scalars(labelled, **splits), lookback_days or [8, 15, 31])


def user_receipt_lookback(receipts: DataFrame, lookback_days: list[int]) -> DataFrame:
    """Adds the rates of the user's own earlier receipts."""
    n = [w - 1 for w in lookback_days]
    past = trailing_sums(_outcomes_by_day(receipts, ["User_id_code"]), ["User_id_code"], "Receive_date", [*OUTCOMES, "vol"], n)
    out = receipts.join(past, ["User_id_code", "Receive_date"], "left")
    new = {}
    for d in n:
        new[f"no_hist_rcs_marker_{d}d"] = F.coalesce(f"no_history_{d}d", F.lit(1))
        new |= {f"Rate_same_user_{k}_{d}d": _rate(f"{k}_{d}d", f"vol_{d}d") for k in OUTCOMES}
    return out.withColumns(new).select(*receipts.columns, *new)


def spend_by_day(txns: DataFrame) -> DataFrame:
    """(user, Receive_date as the day): orders, paid, reduced. An order pays once, however many coupon rows it has; max stands for that one value."""
    orders = txns.groupBy("User_id_code", "Pay_date", "Order_id_code").agg(F.max("Actual_pay_cent").alias("paid"), F.sum("Reduce_amount_cent").alias("reduced"))
    return orders.groupBy("User_id_code", F.col("Pay_date").alias("Receive_date")).agg(F.count("Order_id_code").alias("orders"), F.sum("paid").alias("paid"), F.sum("reduced").alias("reduced"))


def user_spend_lookback(receipts: DataFrame, txns: DataFrame, lookback_days: list[int]) -> DataFrame:
    """Adds average spend against the price limit, average reduction against the coupon, and purchase frequency."""
    n = [w - 1 for w in lookback_days]
    key = ["User_id_code"]
    past = trailing_sums(spend_by_day(txns), key, "Receive_date", ["orders", "paid", "reduced"], n, receipts.select(*key, "Receive_date"))
    out = receipts.join(past, [*key, "Receive_date"], "left")
    new = {}
    for d in n:
        orders = F.coalesce(f"orders_{d}d", F.lit(0))
        against = lambda amount, limit: F.when(orders == 0, F.lit(0.0)).otherwise(S.ratio(F.coalesce(amount, F.lit(0)), orders * (F.col(limit) + 1)))  # noqa: B023, E731
        new[f"no_hist_txns_marker_{d}d"] = F.coalesce(f"no_history_{d}d", F.lit(1))
        new[f"Rt_avgspend_vs_pricelimit_{d}d"] = against(f"paid_{d}d", "Price_limit_cent")
        new[f"Rt_avgreduce_vs_couponamt_{d}d"] = against(f"reduced_{d}d", "Coupon_amt_cent")
        new[f"Freq_purchase_{d}d"] = S.ratio(orders, F.lit(d))
    return out.withColumns(new).select(*receipts.columns, *new)


def user_visit_lookback(receipts: DataFrame, visits: DataFrame, lookback_days: list[int]) -> DataFrame:
    """Adds the user's visit frequency."""
    n = [w - 1 for w in lookback_days]
    key = ["User_id_code"]
    daily = visits.groupBy(*key, F.col("Visit_date").alias("Receive_date")).agg(F.count("*").alias("visits"))
    past = trailing_sums(daily, key, "Receive_date", ["visits"], n, receipts.select(*key, "Receive_date"))
    out = receipts.join(past, [*key, "Receive_date"], "left")
    new = {}
    for d in n:
        new[f"no_hist_visits_marker_{d}d"] = F.coalesce(f"no_history_{d}d", F.lit(1))
        new[f"Freq_visit_{d}d"] = S.ratio(F.coalesce(f"visits_{d}d", F.lit(0)), F.lit(d))
    return out.withColumns(new).select(*receipts.columns, *new)


def user_features(labelled: DataFrame, txns: DataFrame, visits: DataFrame, lookback_days: list[int] | None = None) -> DataFrame:
    days = lookback_days or [8, 15, 31]
    invalid = F.when(F.col("label_valid") == 1, 0).otherwise(1).alias("label_invalid")
    r = labelled.select("receipt_key", "User_id_code", "Coupon_id_code", "Price_limit_cent", "Coupon_amt_cent", "Receive_date", invalid, "label_same_user_fh", "label_same_user_st")
    return user_visit_lookback(user_spend_lookback(user_receipt_lookback(r, days), txns, days), visits, days)


def combine(coupon: DataFrame, user: DataFrame) -> DataFrame:
    """One trainable row a receipt: the coupon's features and labels, and the user's. One key column."""
    drop = ["User_id_code", "Coupon_id_code"]
    extra = [c for c in user.columns if c.startswith(("no_hist_", "Rate_same_user_", "Rt_", "Freq_"))]
    return coupon.drop(*drop).join(user.select("receipt_key", *extra), "receipt_key", "left").select(*[c for c in coupon.columns if c not in (*drop, *LABELS)], *extra, *LABELS)
