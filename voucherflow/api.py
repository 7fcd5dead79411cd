"""Path-to-path stages under their usual names and arguments: each reads Parquet, applies operators, and writes Parquet.

``threads`` is accepted and ignored: Spark's master decides. Every function takes an optional ``spark``; without it the active session is used.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean, diagnostics, features, flags, labels, metrics, reconcile, splits
from .sources import tables

POLICY, FH, ST = "label_invalid", "label_same_user_fh", "label_same_user_st"


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


def _read(spark: SparkSession | None, path) -> DataFrame:
    return tables.days_only(tables.read_parquet(_session(spark), str(path)))


def _apart(out, *sources) -> None:
    """An output must not overwrite what is still to be read."""
    if str(out) in map(str, sources):
        raise ValueError(f"{out} is input and output")


def _label(fh_or_st: str) -> str:
    if fh_or_st not in ("fh", "st"):
        raise ValueError(f"fh_or_st names the full (fh) or the short window (st), not {fh_or_st!r}")
    return FH if fh_or_st == "fh" else ST


# --- ingest -----------------------------------------------------------------


def load_transactions_csv(path="data/order_detail.csv", nrows: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    return tables.read_transactions(_session(spark), str(path), nrows)


def load_receipts_csv(path="data/user_coupon_receive.csv", nrows: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    return tables.read_receipts(_session(spark), str(path), nrows)


def load_users_logins_csv(path="data/user_visit_detail.csv", nrows: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    return tables.read_visits(_session(spark), str(path), nrows)


def save_df2pq(df: DataFrame, name) -> None:
    tables.write_parquet(df, str(name))


def load_df_from_pq(path, cols="all", filters: list | None = None, spark: SparkSession | None = None) -> DataFrame:
    return tables.read_parquet(_session(spark), str(path), cols, filters)


# --- cleaning ---------------------------------------------------------------


def reduce_mem_usage(df: DataFrame, verbose: bool = True) -> DataFrame:
    return clean.narrow(df)


def id_reassign_with_map(cols, *dfs: DataFrame, verbose: bool = True, suffix: str = "_code") -> tuple[tuple[DataFrame, ...], dict[str, DataFrame]]:
    return clean.encode_ids(cols, *dfs, suffix=suffix, tight=True)


def drop_original_id(cols, *dfs: DataFrame, suffix: str = "_code") -> tuple[DataFrame, ...]:
    return clean.drop_originals(cols, *dfs, suffix=suffix)


def drop_duplicate_rows(*dfs: DataFrame) -> tuple[DataFrame, ...]:
    return clean.dedupe(*dfs)


def add_keys(txns_df: DataFrame, receipts_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return clean.add_keys(txns_df, receipts_df)


# --- reconciliation, flags, labels, features --------------------------------


def impute_missing_coupon_ids(txns_df: DataFrame, receipts_df: DataFrame, txns_out_pq, receipts_out_pq) -> DataFrame:
    """Writes both tables and returns the imputed transactions as written. Neither may be a file that the frames are read from."""
    for out in (txns_out_pq, receipts_out_pq):
        _apart(out.rstrip("/") if isinstance(out, str) else out, *[x.rsplit("/", 1)[0].removeprefix("file://") for df in (txns_df, receipts_df) for x in df.inputFiles()])
    tables.write_parquet(reconcile.impute_missing_coupons(txns_df, receipts_df), str(txns_out_pq))
    tables.write_parquet(receipts_df, str(receipts_out_pq))
    return _read(txns_df.sparkSession, txns_out_pq)


def add_txn_level_flags(receipts_parquet, txns_parquet, txn_out_parquet, reconcile_strict: int = 0, threads: int = 8, spark: SparkSession | None = None) -> None:
    _apart(txn_out_parquet, receipts_parquet, txns_parquet)
    tables.write_parquet(flags.flag_transactions(_read(spark, txns_parquet), _read(spark, receipts_parquet), bool(reconcile_strict)), str(txn_out_parquet))


def build_labels(receipts_parquet, txns_parquet, out_parquet, reconcile_strict: int = 0, short_days: int = 15, threads: int = 8, spark: SparkSession | None = None) -> None:
    _apart(out_parquet, receipts_parquet, txns_parquet)
    tables.write_parquet(labels.label_receipts(_read(spark, receipts_parquet), _read(spark, txns_parquet), short_days, bool(reconcile_strict)), str(out_parquet))


def diag_on_receipts(receipts_parquet, Price_limit_bin_splits: list[int], Coupon_limit_bin_splits: list[int], Expiry_span_bin_splits: list[int], threads: int = 8, spark: SparkSession | None = None):
    """A pandas frame: at most a row for each box of the grid."""
    return diagnostics.segment_report(_read(spark, receipts_parquet), Price_limit_bin_splits, Coupon_limit_bin_splits, Expiry_span_bin_splits).toPandas()


def coupon_features(receipts_labelled_parquet, out_parquet, lookback_days: list[int] | None = None, Price_limit_bin_splits: list[int] | None = None, Coupon_limit_bin_splits: list[int] | None = None, Expiry_span_bin_split: int = 10, holidays: list[date] | None = None, workdays: list[date] | None = None, threads: int = 8, spark: SparkSession | None = None) -> None:
    _apart(out_parquet, receipts_labelled_parquet)
    out = features.coupon_features(_read(spark, receipts_labelled_parquet), lookback_days, price_splits=Price_limit_bin_splits, coupon_splits=Coupon_limit_bin_splits, expiry_split=Expiry_span_bin_split, holidays=holidays, workdays=workdays)
    tables.write_parquet(out.orderBy("Receive_date", "receipt_key"), str(out_parquet))


def user_features(receipts_labelled_parquet, txns_parquet, visits_parquet, out_parquet, lookback_days: list[int] | None = None, threads: int = 8, spark: SparkSession | None = None) -> None:
    _apart(out_parquet, receipts_labelled_parquet, txns_parquet, visits_parquet)
    out = features.user_features(_read(spark, receipts_labelled_parquet), _read(spark, txns_parquet), _read(spark, visits_parquet), lookback_days)
    tables.write_parquet(out.orderBy("receipt_key"), str(out_parquet))


def features_combining(cpn_features_parquet, user_features_parquet, out_parquet, threads: int = 8, spark: SparkSession | None = None) -> None:
    _apart(out_parquet, cpn_features_parquet, user_features_parquet)
    tables.write_parquet(features.combine(_read(spark, cpn_features_parquet), _read(spark, user_features_parquet)), str(out_parquet))


# --- splits and data sets ----------------------------------------------------


def _split(kind: str, spark, trainable, train_out, test_out, test_start_at, right_censoring, censor_cutoff_at, forward_chain_cv) -> None:
    train, test = splits.split(kind, _read(spark, trainable), test_start_at, censor_cutoff_at if right_censoring else None, None if forward_chain_cv else [])
    tables.write_parquet(test, str(test_out))
    tables.write_parquet(train, str(train_out))


def policy_model_split(trainable_parquet, train_set_out_parquet, test_set_out_parquet, test_start_at: date = splits.TEST_START, right_censoring: bool = True, censor_cutoff_at: date = splits.CENSOR, forward_chain_cv: bool = True, threads: int = 8, spark: SparkSession | None = None) -> None:
    _split("policy", spark, trainable_parquet, train_set_out_parquet, test_set_out_parquet, test_start_at, right_censoring, censor_cutoff_at, forward_chain_cv)


def ROI_model_split(trainable_parquet, train_set_out_parquet, test_set_out_parquet, test_start_at: date = splits.TEST_START, right_censoring: bool = True, censor_cutoff_at: date = splits.CENSOR, forward_chain_cv: bool = True, threads: int = 8, spark: SparkSession | None = None) -> None:
    _split("roi", spark, trainable_parquet, train_set_out_parquet, test_set_out_parquet, test_start_at, right_censoring, censor_cutoff_at, forward_chain_cv)


def _folds(df: DataFrame, label: str, filters: list | None, validation_only: bool) -> tuple[DataFrame, ...]:
    pairs = splits.folds_of(df, label, filters, validation_only)
    return (*[a for a, _ in pairs], *[b for _, b in pairs])


def load_policy_training_3folds_data(train_set_path, segment: bool = False, validation_only: bool = True, spark: SparkSession | None = None, **bins) -> tuple[DataFrame, ...]:
    """Three training sets, then three validation sets. The column catalog is the file's own schema, so none is passed."""
    return _folds(_read(spark, train_set_path), POLICY, splits.segment_filter(**_bins(bins)) if segment else None, validation_only)


def load_ROI_training_3folds_data(train_set_path, fh_or_st: str, segment: bool = False, validation_only: bool = True, spark: SparkSession | None = None, **bins) -> tuple[DataFrame, ...]:
    """As above, on valid receipts."""
    valid = (POLICY, "==", 0)
    filters = [[valid]] if not segment else [[*g, valid] for g in splits.segment_filter(**_bins(bins))]
    return _folds(_read(spark, train_set_path), _label(fh_or_st), filters, validation_only)


def _bins(given: dict) -> dict:
    names = {"Price_limit_bin": "price", "Coupon_limit_bin": "coupon", "Expiry_span_bin": "expiry"}
    return {names[k]: v for k, v in given.items()}


def load_policy_training_data(train_set_path, spark: SparkSession | None = None) -> DataFrame:
    return splits.dataset(_read(spark, train_set_path), POLICY)


load_policy_test_data = load_policy_training_data


def load_policy_certain_segment_data(train_set_path, Price_limit_bin=2, Coupon_limit_bin=0, Expiry_span_bin=0, w_3folds: bool = False, spark: SparkSession | None = None):
    """The segment's rows; with ``w_3folds``, its columns and filter instead. The bins stay as features if several segments are asked for."""
    filters, df = splits.segment_filter(Price_limit_bin, Coupon_limit_bin, Expiry_span_bin), _read(spark, train_set_path)
    out = splits.dataset(df, POLICY, filters, drop_bins=not isinstance(Price_limit_bin, list))
    return (out.columns, filters) if w_3folds else out


def load_ROI_TrainorTest_data(data_set_path, fh_or_st: str = "st", segment: bool = False, valid_only: bool = False, spark: SparkSession | None = None, **bins) -> DataFrame:
    filters = splits.segment_filter(**_bins(bins)) if segment else None
    filters = [[*g, (POLICY, "==", 0)] for g in filters or [[]]] if valid_only else filters
    return splits.dataset(_read(spark, data_set_path), _label(fh_or_st), filters)


def load_ROI_test_data(test_set_path, fh_or_st: str = "st", spark: SparkSession | None = None) -> DataFrame:
    return load_ROI_TrainorTest_data(test_set_path, fh_or_st, spark=spark)


def get_policy_X_y_data(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return splits.x_y(df, POLICY)


def get_ROI_X_y_data(df: DataFrame, fh_or_st: str) -> tuple[DataFrame, DataFrame]:
    return splits.x_y(df, _label(fh_or_st))


# --- metrics -----------------------------------------------------------------


def add_vanilla_weights(df: DataFrame, binary_label_col: str) -> DataFrame:
    """The frame with its weight column: a column alone could not be matched with its rows again."""
    return metrics.class_weights(df, binary_label_col)


def metric_individual_class_accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", which_class: int = 1, thresholds: tuple[float, ...] = (0.25, 0.5, 0.75), test_mode: bool = False) -> list[float]:
    rows = metrics.class_accuracy(df, y_true, y_pred, which_class, tuple(thresholds), test_mode).collect()
    return [r["accuracy"] for r in sorted(rows, key=lambda r: list(thresholds).index(r["threshold"]))]


def metric_business_top5profit(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", profit: str = "Actual_pay_cent", tie: str | None = None) -> tuple[float, float]:
    row = metrics.top_share(df, y_true, y_pred, profit, tie=tie).first()
    return row["rate"], row["profit"]


def metric_business_profit_at_diff_thrshld(df: DataFrame, y_pred: str = "y_pred", profit: str = "Actual_pay_cent", thresholds: tuple[float, ...] = (0.25, 0.5, 0.75)) -> list[float | None]:
    return [r["profit"] for r in metrics.profit_at(df, y_pred, profit, tuple(thresholds)).orderBy(F.col("threshold")).collect()]
