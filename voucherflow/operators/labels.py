"""Labels of coupon receipts: redeemed in the full or the short window, validly or not, and the audit counts behind it.

Receipts are never joined with transactions row by row. Transactions are rolled up to days, once by (user, coupon) and once by coupon, and the days
of a key become one sorted array, which has at most as many entries as the calendar has days. Each receipt meets two such arrays in
many-to-one joins and counts over its own windows. A hot user or coupon therefore neither multiplies rows nor
collects them, and AQE can split its receipts.

Rules fixed here: a missing coupon (-1 or null) matches nothing; a missing user is never "the same user" and owns no receipt, but
is another user to those who are known; a receipt with a missing user or coupon has zero counts (it is structurally invalid anyway).
Transaction keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import both, missing

PAIR = ["User_id_code", "Coupon_id_code"]


def windows(receipts: DataFrame, short_days: int = 15) -> DataFrame:
    """Adds start_eff, end_eff and short_end, which counts from the receipt."""
    start = both(F.greatest, F.col("Receive_date"), F.col("Start_date"))
    short = both(F.least, F.col("End_date"), F.date_add("Receive_date", short_days))
    return receipts.withColumns({"start_eff": start, "end_eff": F.col("End_date"), "short_end": short})


def _usable(txns: DataFrame) -> DataFrame:
    return txns.where(~missing("Coupon_id_code")).where("Pay_date is not null and User_id_code is not null")


def pair_history(txns: DataFrame) -> DataFrame:
    """(user, coupon) -> own: sorted array of (day, n, least txn_key)."""
    days = _usable(txns).where(~missing("User_id_code")).groupBy(*PAIR, "Pay_date").agg(F.count("*").alias("n"), F.min("txn_key").alias("key"))
    return days.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct(F.col("Pay_date").alias("day"), "n", "key"))).alias("own"))


def with_orphans(txns: DataFrame, receipts: DataFrame) -> DataFrame:
    """Usable transactions with ``orphan``: 1 if no receipt of the same user and coupon covers the day.

    Of a pair's receipts the latest end for each first day is kept, so a pair's array is bounded by the calendar.
    """
    w = windows(receipts).where(~missing("User_id_code") & ~missing("Coupon_id_code")).where("start_eff <= end_eff")
    spans = w.groupBy(*PAIR, "start_eff").agg(F.max("end_eff").alias("end_eff")).groupBy(*PAIR).agg(F.collect_list(F.struct("start_eff", "end_eff")).alias("spans"))
    day = F.col("Pay_date")
    covered = F.exists("spans", lambda s: (s["start_eff"] <= day) & (s["end_eff"] >= day))
    return _usable(txns).join(spans, PAIR, "left").withColumn("orphan", (~F.coalesce(covered, F.lit(False))).cast("int")).drop("spans")


def coupon_history(txns: DataFrame, receipts: DataFrame) -> DataFrame:
    """coupon -> all: sorted array of (day, n, orphans)."""
    days = with_orphans(txns, receipts).groupBy("Coupon_id_code", "Pay_date").agg(F.count("*").alias("n"), F.sum("orphan").alias("orphans"))
    return days.groupBy("Coupon_id_code").agg(F.sort_array(F.collect_list(F.struct(F.col("Pay_date").alias("day"), "n", "orphans"))).alias("all"))


def _total(array: str, condition, field: str = "n") -> Column:
    """Sum of a field over the array's days that meet the condition; 0 for no array."""
    add = lambda acc, x: acc + F.when(condition(x["day"]), x[field]).otherwise(F.lit(0))
    return F.coalesce(F.aggregate(array, F.lit(0).cast("long"), add), F.lit(0).cast("long"))


def same_user(receipts: DataFrame, txns: DataFrame, short_days: int = 15) -> DataFrame:
    """Receipts with windows, redemption labels, first valid transaction, and valid, early and late counts."""
    r = windows(receipts, short_days).join(pair_history(txns), PAIR, "left")
    within = lambda a, b: lambda d: d.between(F.col(a), F.col(b))
    valid, spanned = _total("own", within("start_eff", "end_eff")), _total("own", within("Start_date", "End_date"))
    after_receipt = _total("own", lambda d: d.between(F.col("Start_date"), F.col("End_date")) & (d >= F.col("Receive_date")))
    early = _total("own", lambda d: d < F.col("Start_date"))
    # paid inside the coupon's span, but never on or after the day it was received
    too_early = F.when(F.col("Receive_date").isNotNull() & (after_receipt == 0), spanned).otherwise(F.lit(0).cast("long"))
    first = F.filter("own", lambda x: x["day"].between(F.col("start_eff"), F.col("end_eff")))
    out = r.withColumns({
        "same_user_valid_txn_count": valid, "same_user_early_txn_count": early + too_early,
        "same_user_late_txn_count": _total("own", lambda d: d > F.col("End_date")),
        "_short": _total("own", within("start_eff", "short_end")), "_first": F.get(first, F.lit(0)),
    })
    return out.withColumns({
        "label_same_user_fh": (F.col("same_user_valid_txn_count") > 0).cast("int"), "label_same_user_st": (F.col("_short") > 0).cast("int"),
        "first_valid_txn_key": F.col("_first.key"), "first_valid_txn_time": F.col("_first.day"),
    }).drop("own", "_short", "_first")


def cross_user(labelled: DataFrame, txns: DataFrame, receipts: DataFrame) -> DataFrame:
    """Adds the counts of other users' transactions in the receipt's window, all and those without a receipt of their own.

    A transaction of the same user inside the window has a receipt that covers it, this one, so all orphans are other users'.
    """
    r = labelled.join(coupon_history(txns, receipts), "Coupon_id_code", "left")
    inside = lambda d: d.between(F.col("start_eff"), F.col("end_eff"))
    known = ~missing("User_id_code")
    zero = F.lit(0).cast("long")
    return r.withColumns({
        "other_user_in_window_txn_count": F.when(known, _total("all", inside) - F.col("same_user_valid_txn_count")).otherwise(zero),
        "other_user_without_own_receipt_txn_count": F.when(known, _total("all", inside, "orphans")).otherwise(zero),
    }).drop("all")


COLUMNS = [
    "receipt_key", "User_id_code", "Coupon_id_code", "Receive_date", "Start_date", "End_date", "start_eff", "end_eff", "short_end",
    "label_same_user_fh", "label_same_user_st", "Coupon_status", "Coupon_amt_cent", "Price_limit_cent", "first_valid_txn_key", "first_valid_txn_time",
    "same_user_valid_txn_count", "same_user_early_txn_count", "same_user_late_txn_count", "other_user_in_window_txn_count", "other_user_without_own_receipt_txn_count",
    "flag_early", "flag_late", "flag_cross_user", "flag_struc_invalid", "label_valid",
]


def label_receipts(receipts: DataFrame, txns: DataFrame, short_days: int = 15, strict: bool = False) -> DataFrame:
    """One row a receipt: windows, labels, counts, flags. ``strict`` uses only transactions whose coupon was not imputed."""
    txns = txns.where("coupon_id_imputed = 0") if strict else txns
    r = cross_user(same_user(receipts, txns, short_days), txns, receipts)
    broken = missing("User_id_code") | missing("Coupon_id_code") | F.col("Receive_date").isNull() | F.coalesce(F.col("Start_date") > F.col("End_date"), F.lit(True))
    r = r.withColumns({
        "flag_early": (F.col("same_user_early_txn_count") > 0).cast("int"), "flag_late": (F.col("same_user_late_txn_count") > 0).cast("int"),
        "flag_cross_user": (F.col("other_user_without_own_receipt_txn_count") > 0).cast("int"), "flag_struc_invalid": broken.cast("int"),
    })
    flags = F.col("flag_early") + F.col("flag_late") + F.col("flag_cross_user") + F.col("flag_struc_invalid")
    return r.withColumn("label_valid", (flags == 0).cast("int")).select(*COLUMNS)
