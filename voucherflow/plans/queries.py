"""One query per operator over the mapped tables, and DuckDB SQL in the plain, un-rewritten form for each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean, diagnostics, features, flags, labels, metrics, reconcile, splits, trailing, trees
from ..sources import scratch, tables
from . import demo

LOOKBACK = [8, 15]
FIRST, LAST = date(2024, 1, 10), date(2024, 1, 14)  # the events are of January 2024
TEST_START, CUTOFF = date(2024, 1, 22), date(2024, 1, 31)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_receipts(demo.receipts(spark, d), demo.txns(spark, d))


def _coupon(spark: SparkSession, d: str) -> DataFrame:
    return features.coupon_scalars(_labelled(spark, d), holidays=[date(2024, 1, 1)], workdays=[date(2024, 1, 7)])


def _imputed(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.impute_missing_coupons(demo.txns(spark, d), demo.receipts(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Transactions as scored rows: a score with ties, a label, a profit."""
    return demo.txns(spark, d).select(F.col("txn_key").alias("id"), F.expr("cast(txn_key % 5 in (1, 3) as int)").alias("y_true"), F.expr("(txn_key * 7919 % 1009) / 1009").alias("y_pred"), F.col("Actual_pay_cent"))


def dedupe_rows(spark, d):
    raw = demo.txns(spark, d).select("User_id_code", "Shop_id_code", "Coupon_id_code", "Biz_code")
    return clean.dedupe(raw)[0]


def money_to_cents(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("paid"))
    return raw.select("event_id", S.money_to_cents("paid").alias("paid_cent"), S.to_long("paid").alias("whole"))


def parse_dates(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 13 == 0, "20240101").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("text"))
    return raw.select("event_id", S.to_day("text").alias("day"))


def dict_encode_ids(spark, d):
    """Codes by order of value: the invariants of any bijection, and this one itself."""
    a, b = demo.receipts(spark, d).select("receipt_key", "User_id_code"), demo.visits(spark, d)
    ids = [x.withColumn("User_id", F.when(F.col("User_id_code") >= 0, F.col("User_id_code"))).drop("User_id_code") for x in (a, b)]
    (coded, _), _ = clean.encode_ids("User_id", *ids)
    return coded.select("receipt_key", "User_id_code")


def surrogate_keys(spark, d):
    pairs = demo.txns(spark, d).select("User_id_code", "Pay_date").distinct()
    return clean.add_key(pairs, "pair_key")


def null_profile(spark, d):
    return clean.null_profile(demo.txns(spark, d))


def narrow_types_minmax(spark, d):
    t = demo.txns(spark, d)
    small = clean.narrow(t)
    kinds = dict(small.dtypes)
    seen = clean.extent(t, ["User_id_code", "Order_id_code", "Actual_pay_cent"])
    return seen.select("*", *[F.lit(kinds[c]).alias(f"type_{c}") for c in ("User_id_code", "Order_id_code", "Actual_pay_cent")])


def value_counts(spark, d):
    return clean.value_counts(demo.receipts(spark, d), "Coupon_id_code", "Coupon_status")


def window_nunique_check(spark, d):
    return clean.inconsistent(demo.receipts(spark, d), "User_id_code", "Coupon_id_code", "Start_date")


def impute_missing_coupon(spark, d):
    return _imputed(spark, d).select("txn_key", "Coupon_id_code", *reconcile.FLAGS)


def txn_flags(spark, d):
    return flags.flag_transactions(_imputed(spark, d), demo.receipts(spark, d)).select("txn_key", *flags.FLAGS)


def txn_flags_strict(spark, d):
    return flags.flag_transactions(_imputed(spark, d), demo.receipts(spark, d), strict=True).select("txn_key", *flags.FLAGS)


def txn_flag_proportions(spark, d):
    return flags.flag_shares(flags.flag_transactions(_imputed(spark, d), demo.receipts(spark, d)))


def untracked_coupon_anti(spark, d):
    return flags.untracked(demo.txns(spark, d), demo.receipts(spark, d)).select("txn_key", "Coupon_id_code")


def labels_same_user(spark, d):
    r = labels.same_user(demo.receipts(spark, d), demo.txns(spark, d))
    return r.select("receipt_key", "start_eff", "end_eff", "short_end", "label_same_user_fh", "label_same_user_st")


def first_valid_txn(spark, d):
    return labels.same_user(demo.receipts(spark, d), demo.txns(spark, d)).select("receipt_key", "first_valid_txn_key", "first_valid_txn_time")


def early_late_counts(spark, d):
    return labels.same_user(demo.receipts(spark, d), demo.txns(spark, d)).select("receipt_key", "same_user_valid_txn_count", "same_user_early_txn_count", "same_user_late_txn_count")


def cross_user_audit(spark, d):
    r, t = demo.receipts(spark, d), demo.txns(spark, d)
    return labels.cross_user(labels.same_user(r, t), t, r).select("receipt_key", "other_user_in_window_txn_count", "other_user_without_own_receipt_txn_count")


def labels_full(spark, d):
    return _labelled(spark, d)


def labels_strict(spark, d):
    return labels.label_receipts(demo.receipts(spark, d), _imputed(spark, d), strict=True).select("receipt_key", "label_same_user_fh", "label_same_user_st", "label_valid")


def coupon_bins(spark, d):
    return _coupon(spark, d).select("receipt_key", "Price_limit_bin", "Coupon_limit_bin", "Expiry_span_bin", "Generosity_ratio")


def coupon_markers(spark, d):
    return _coupon(spark, d).select("receipt_key", "Start_bf_receive_marker", "End_bf_receive_marker")


def calendar_markers(spark, d):
    return _coupon(spark, d).select("receipt_key", "Weekday_marker", "Workday_marker", "Holiday_marker")


def segment_lookback(spark, d):
    out = features.segment_lookback(_coupon(spark, d), LOOKBACK)
    return out.select("receipt_key", *[c for c in out.columns if c.endswith(("_7d", "_14d"))])


def user_receipt_lookback(spark, d):
    out = features.user_receipt_lookback(_coupon(spark, d), LOOKBACK)
    return out.select("receipt_key", *[c for c in out.columns if c.endswith(("_7d", "_14d"))])


def user_spend_lookback(spark, d):
    out = features.user_spend_lookback(_coupon(spark, d), demo.txns(spark, d), LOOKBACK)
    return out.select("receipt_key", *[c for c in out.columns if c.endswith(("_7d", "_14d"))])


def user_visit_lookback(spark, d):
    out = features.user_visit_lookback(_coupon(spark, d), demo.visits(spark, d), LOOKBACK)
    return out.select("receipt_key", *[c for c in out.columns if c.endswith(("_7d", "_14d"))])


def asof_prefix(spark, d):
    r = demo.receipts(spark, d).select("receipt_key", "User_id_code", "Receive_date")
    return trailing.asof_prefix(demo.visits(spark, d), r, ["User_id_code"], "Visit_date", "Receive_date")


def order_rollup(spark, d):
    return features.spend_by_day(demo.txns(spark, d)).withColumnRenamed("Receive_date", "Pay_date")


def segment_diagnostics(spark, d):
    return diagnostics.segment_report(_labelled(spark, d))


def segment_redemption_rate(spark, d):
    return diagnostics.segment_rates(_coupon(spark, d))


def receipt_flag_shares(spark, d):
    return diagnostics.receipt_flag_shares(_labelled(spark, d))


def union_by_name_distinct(spark, d):
    a = demo.receipts(spark, d).select("User_id_code", "Coupon_id_code")
    b = demo.txns(spark, d).select("Coupon_id_code", "User_id_code", "Biz_code")
    return diagnostics.union_by_name(a, b)


def _trainable(spark, d):
    lab = scratch.written(_labelled(spark, d), "labels")  # read by five consumers
    coupon = features.coupon_features(lab, LOOKBACK, holidays=[date(2024, 1, 1)], workdays=[date(2024, 1, 7)])
    return features.combine(coupon, features.user_features(lab, demo.txns(spark, d), demo.visits(spark, d), LOOKBACK))


def trainable_join(spark, d):
    return _trainable(spark, d)


def _split(kind, spark, d):
    train, test = splits.split(kind, _coupon(spark, d), TEST_START, CUTOFF, [(FIRST, LAST)], 5)
    cols = ["receipt_key", "label_invalid"]
    return train.select(*cols, "fold_1_marker", F.lit("train").alias("part")).union(test.select(*cols, F.lit(None).cast("int"), F.lit("test")))


def policy_split_folds(spark, d):
    return _split("policy", spark, d)


def roi_split_folds(spark, d):
    return _split("roi", spark, d)


RANGES = [(date(2024, 1, 8), date(2024, 1, 10)), (date(2024, 1, 12), date(2024, 1, 14)), (date(2024, 1, 16), date(2024, 1, 19))]


def _three(kind, spark, d):
    train, test = splits.split(kind, _coupon(spark, d), TEST_START, CUTOFF, RANGES, 5)
    return train.select("receipt_key", *[f"fold_{i}_marker" for i in (1, 2, 3)]).unionByName(test.select("receipt_key"), allowMissingColumns=True)


def policy_three_folds(spark, d):
    return _three("policy", spark, d)


def roi_three_folds(spark, d):
    return _three("roi", spark, d)


def split_without_folds(spark, d):
    train, test = splits.split("policy", _coupon(spark, d), TEST_START, None, [])
    return train.select("receipt_key", F.lit(str("fold_1_marker" in train.columns).lower()).alias("has_folds")).union(test.select("receipt_key", F.lit("test")))


def dataset_columns(spark, d):
    """The columns that features and label of each model keep."""
    train, _ = splits.split("roi", _coupon(spark, d), TEST_START, CUTOFF, RANGES, 5)
    x, y = splits.x_y(splits.dataset(train, "label_same_user_st", drop_bins=True), "label_same_user_st")
    return spark.createDataFrame([(c, part) for part, df in (("x", x), ("y", y)) for c in df.columns], "column_name string, part string")


def fold_datasets(spark, d):
    """Rows and positives of each fold's train and validation set, valid receipts only."""
    train, _ = splits.split("roi", _coupon(spark, d), TEST_START, CUTOFF, [(FIRST, LAST)], 5)
    (a, b), = splits.folds_of(train, "label_same_user_st", [[("label_invalid", "==", 0)]])
    count = lambda x, part: x.agg(F.count("*").alias("n"), F.coalesce(F.sum("label_same_user_st"), F.lit(0)).cast("long").alias("positives")).select(F.lit(part).alias("part"), "n", "positives")
    return count(a, "train").union(count(b, "validation"))


def dnf_filter(spark, d):
    keep = S.dnf(S.also(splits.segment_filter([2, 1], [0, 0], [0, 1]), ("label_same_user_st", "!=", 1)))
    return _coupon(spark, d).where(keep).select("receipt_key")


def segment_catalog(spark, d):
    return _coupon(spark, d).groupBy(splits.segment_id().alias("segment_id")).agg(F.count("*").alias("n"))


def class_weights(spark, d):
    return metrics.class_weights(_scored(spark, d), "y_true").select("id", "weight")


def per_class_accuracy(spark, d):
    s = _scored(spark, d)
    one = lambda k: metrics.class_accuracy(s, which=k, exact=True).select(F.lit(k).alias("class"), "threshold", "accuracy")
    return one(1).union(one(0))


def per_class_accuracy_rounded(spark, d):
    s = _scored(spark, d)
    return metrics.class_accuracy(s, which=1).withColumn("class", F.lit(1)).union(metrics.class_accuracy(s, which=0).withColumn("class", F.lit(0)))


def roc_auc_mean_of_folds(spark, d):
    s = _scored(spark, d)
    folds = [metrics.roc_auc(s.where(F.col("id") % 3 == i)).select(F.col("auc").alias(f"auc_{i}")) for i in range(3)]
    one = folds[0].join(folds[1]).join(folds[2])  # three tables of one row
    return one.select("*", F.round(metrics.mean_of_folds([F.col(f"auc_{i}") for i in range(3)]), 12).alias("mean_auc"))


def roc_auc_exact(spark, d):
    return metrics.roc_auc(_scored(spark, d))


def top5_profit(spark, d):
    return metrics.top_share(_scored(spark, d), tie="id")


def profit_at_thresholds(spark, d):
    return metrics.profit_at(_scored(spark, d))


def mean_profit(spark, d):
    return metrics.mean_profit(_scored(spark, d))


def net_profit_test_set(spark, d):
    r, t = demo.receipts(spark, d), demo.txns(spark, d)
    lab = labels.same_user(r, t)
    return metrics.with_net_profit(lab.where(F.col("Receive_date") >= F.lit(TEST_START)).select("receipt_key"), lab, t)


def _raw_csv(spark, d):
    """Transactions as a raw CSV file with its text columns."""
    t, path = demo.txns(spark, d), scratch.new_path(spark, "raw-csv")
    cents = lambda c: (F.col(c) / 100).cast("decimal(18,2)").cast("string")
    raw = t.select(
        F.col("User_id_code").alias("User_id"), F.col("Shop_id_code").alias("Shop_id"), F.col("txn_key").alias("Order_id"), F.col("Coupon_id_code").alias("Coupon_id"), "Coupon_type", "Biz_code",
        "Pay_date", cents("Actual_pay_cent").alias("Actual_pay"), cents("Reduce_amount_cent").alias("Reduce_amount"),
    )
    tables.write_csv(raw, path)
    return path


def csv_ingest(spark, d):
    """Written as CSV, read as text, required columns checked, dates and money parsed."""
    got = tables.read_transactions(spark, _raw_csv(spark, d))
    return got.select(F.col("Order_id").cast("long").alias("txn_key"), "Pay_date", "Coupon_type", "Actual_pay_cent", "Reduce_amount_cent", "Biz_code")


def csv_typed(spark, d):
    path = scratch.new_path(spark, "typed-csv")
    tables.write_csv(demo.receipts(spark, d).select("receipt_key", "Receive_date", "Price_limit_cent"), path)
    return tables.read_csv(spark, path, "receipt_key long, Receive_date date, Price_limit_cent long")


def csv_first_rows(spark, d):
    return tables.read_csv_text(spark, _raw_csv(spark, d), ["Order_id"], "transactions", 17).agg(F.count("*").alias("n"))


def parquet_round_trip(spark, d):
    """Sink, column catalog and projected, filtered scan."""
    path = scratch.new_path(spark, "sink")
    tables.write_parquet(demo.receipts(spark, d), path)
    names = [c for c in tables.column_catalog(spark, path) if c.endswith("_date")]
    return tables.read_parquet(spark, path, ["receipt_key", *names], [[("Coupon_status", "==", 2)]])


def parameter_table(spark, d):
    return tables.one_column(spark, "holiday", [date(2024, 1, 1), date(2024, 5, 1)], "date")


def metrics_history(spark, d):
    path = scratch.new_path(spark, "metrics")
    for run in (1, 2):
        tables.append_metrics(spark, {"run": run, "auc": 0.5}, path)
    return tables.read_parquet(spark, path)


def keys_and_originals(spark, d):
    """Keys added and checked, codes in place of the original ids, and the key sets of both sides of a step equal."""
    r = demo.receipts(spark, d).withColumn("User_id", F.when(F.col("User_id_code") >= 0, F.col("User_id_code"))).drop("User_id_code")
    (coded,), _ = clean.encode_ids("User_id", r)
    clean.assert_unique(coded, "receipt_key")
    (out,) = clean.drop_originals("User_id", coded)
    same = clean.same_values(r, out, "receipt_key")
    return spark.createDataFrame([(c, same) for c in sorted(out.columns)], "column_name string, same_keys boolean")


def sorted_ranks(spark, d):
    """Places in the order in which coupon features are stored."""
    return clean.dense_index(demo.receipts(spark, d).select("receipt_key", "Receive_date"), "place", F.asc_nulls_first("Receive_date"), "receipt_key")


def _gbt(spark, d):
    """Receipts with their bins and a label that the bins decide, and trees trained on it."""
    df = _coupon(spark, d).select("receipt_key", "Price_limit_bin", "Coupon_limit_bin", "Expiry_span_bin", F.expr("cast(Price_limit_bin = 1 or Coupon_limit_bin = 0 as int)").alias("y"))
    bins = {"Price_limit_bin": 3, "Coupon_limit_bin": 3, "Expiry_span_bin": 2}
    return df, *trees.train_gbt(df.drop("receipt_key"), "y", rounds=3, step=0.5, categorical=bins), bins


def gbt_predictions(spark, d):
    """Trained trees must give the label back."""
    df, features, model, bins = _gbt(spark, d)
    return trees.predict_gbt(df, features, model, bins).select("receipt_key", (F.col("y_pred") >= 0.5).cast("int").alias("predicted"))


def gbt_dump_predictions(spark, d):
    """So must their text dump."""
    df, features, model, bins = _gbt(spark, d)
    score = trees.score_column(trees.dump(features, trees.trees_of(features, model, bins)))
    return df.select("receipt_key", (score >= 0.5).cast("int").alias("predicted"))


MODEL = """tree
feature_names=Price_limit_cent Coupon_amt_cent Expiry_span_bin

Tree=0
num_leaves=3
split_feature=1 0
threshold=5000.5 2000
decision_type=2 10
left_child=-1 -2
right_child=1 -3
leaf_value=0.5 -0.25 0.125

Tree=1
num_leaves=2
num_cat=1
split_feature=2
threshold=0
decision_type=1
left_child=-1
right_child=-2
leaf_value=0.25 -0.75
cat_boundaries=0 1
cat_threshold=1

end of trees
"""


def tree_score(spark, d):
    return _coupon(spark, d).select("receipt_key", F.round(trees.score_column(MODEL), 9).alias("y_pred"), trees.score_column(MODEL, first=1, count=1, raw=True).alias("raw_second"))


QUERIES = {f.__name__: f for f in (
    dedupe_rows, money_to_cents, parse_dates, dict_encode_ids, surrogate_keys, null_profile, narrow_types_minmax, value_counts, window_nunique_check,
    impute_missing_coupon, txn_flags, txn_flags_strict, txn_flag_proportions, untracked_coupon_anti, labels_same_user, first_valid_txn, early_late_counts, cross_user_audit, labels_full, labels_strict,
    coupon_bins, coupon_markers, calendar_markers, segment_lookback, user_receipt_lookback, user_spend_lookback, user_visit_lookback, asof_prefix, order_rollup,
    segment_diagnostics, segment_redemption_rate, receipt_flag_shares, union_by_name_distinct, trainable_join, policy_split_folds, roi_split_folds, fold_datasets, dnf_filter, segment_catalog,
    class_weights, per_class_accuracy, roc_auc_exact, top5_profit, profit_at_thresholds, mean_profit, net_profit_test_set, tree_score,
    policy_three_folds, roi_three_folds, split_without_folds, dataset_columns, per_class_accuracy_rounded, roc_auc_mean_of_folds, csv_ingest, csv_typed, csv_first_rows, parquet_round_trip,
    parameter_table, metrics_history, keys_and_originals, sorted_ranks, gbt_predictions, gbt_dump_predictions,
)}
