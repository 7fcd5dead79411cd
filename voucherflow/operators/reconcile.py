"""Imputing a transaction's missing coupon from the one receipt whose window covers it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import missing

FLAGS = ["coupon_id_imputed", "flag_no_coupon", "flag_ambiguous_txn"]


def usable(receipts: DataFrame) -> DataFrame:
    """Receipts with a known user and all three dates, in order; ``start_eff`` is the later of Receive and Start."""
    r = receipts.where("Start_date <= End_date and Receive_date is not null").where(~missing("User_id_code"))
    return r.select(F.col("User_id_code").alias("user"), F.col("Coupon_id_code").alias("coupon"), F.greatest("Receive_date", "Start_date").alias("start_eff"), F.col("End_date").alias("end_eff"))


def impute_missing_coupons(txns: DataFrame, receipts: DataFrame) -> DataFrame:
    """All transactions, with the coupon where exactly one receipt fits, and three 0/1 flags of which a missing coupon has one.

    imputed: one receipt of the user covers the day of payment. no_coupon: none does, and nothing was taken off the price.
    ambiguous: anything else. Fits are counted in receipts: two of the same coupon are ambiguous.

    No transaction meets a receipt. The windows of a user are events, one more where a window starts and one less the day after its end, rolled up to (user, day); running sums
    over a user's days tell how many windows cover a day, and the sum of their coupons, which is the coupon where the number is one. A user has at most as many rows as the calendar has days.
    """
    r = usable(receipts).where("start_eff <= end_eff")
    known = F.col("coupon").isNotNull().cast("long")
    step = lambda day, sign: r.select("user", day.alias("day"), F.lit(sign).cast("long").alias("n"), (sign * F.coalesce("coupon", F.lit(0))).cast("decimal(38,0)").alias("c"), (sign * known).alias("k"))
    lost = missing("Coupon_id_code")
    placed = ~missing("User_id_code") & F.col("Pay_date").isNotNull()
    zero = F.lit(0).cast("long")
    probes = txns.where(lost & placed).select(F.col("User_id_code").alias("user"), F.col("Pay_date").alias("day"), zero.alias("n"), zero.cast("decimal(38,0)").alias("c"), zero.alias("k"), F.lit(1).alias("asked")).distinct()
    days = step(F.col("start_eff"), 1).union(step(F.date_add("end_eff", 1), -1)).withColumn("asked", F.lit(0)).union(probes)
    days = days.groupBy("user", "day").agg(*[F.sum(x).alias(x) for x in "nck"], F.max("asked").alias("asked"))
    so_far = W.partitionBy("user").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    days = days.select("user", "day", "asked", *[F.sum(x).over(so_far).alias(x) for x in "nck"]).where("asked = 1")
    fits = days.select("user", "day", F.col("n").alias("_fits"), F.when(F.col("k") > 0, F.col("c")).cast("long").alias("_coupon"))
    out = txns.join(fits, lost & (F.col("User_id_code") == F.col("user")) & (F.col("Pay_date") == F.col("day")), "left")
    imputed = lost & F.coalesce(F.col("_fits") == 1, F.lit(False))
    none = lost & placed & (F.col("_fits") == 0) & F.coalesce(F.abs("Reduce_amount_cent") < 1, F.lit(False))
    flag = lambda c: c.cast("int")
    return out.withColumns({
        "Coupon_id_code": F.when(imputed, F.col("_coupon")).otherwise(F.col("Coupon_id_code")),
        "coupon_id_imputed": flag(imputed), "flag_no_coupon": flag(none), "flag_ambiguous_txn": flag(lost & ~imputed & ~none),
    }).drop("_fits", "_coupon", "user", "day").select(*txns.columns, *FLAGS)
