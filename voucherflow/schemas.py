"""The logical tables: raw columns, coded columns, and the calendar of 2023."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

MISSING = -1  #: code of a missing id

# Column names of the raw files.
RAW_TXN = ["User_id", "Shop_id", "Order_id", "Coupon_id", "Coupon_type", "Biz_code", "Pay_date", "Actual_pay", "Reduce_amount"]
RAW_RECEIPT = ["User_id", "Coupon_id", "Coupon_status", "Coupon_amt", "Receive_date", "Start_date", "End_date", "Price_limit"]
RAW_VISIT = ["User_id", "Visit_date"]

_long, _date, _text, _flag = T.LongType(), T.DateType(), T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Column names of the coded tables.
TXN = _struct(User_id_code=_long, Shop_id_code=_long, Order_id_code=_long, Coupon_id_code=_long, Coupon_type=_long, Biz_code=_text, Pay_date=_date, Actual_pay_cent=_long, Reduce_amount_cent=_long, txn_key=_long)
RECEIPT = _struct(User_id_code=_long, Coupon_id_code=_long, Coupon_amt_cent=_long, Receive_date=_date, Start_date=_date, End_date=_date, Price_limit_cent=_long, Coupon_status=_long, receipt_key=_long)
LABELLED = _struct(
    User_id_code=_long, Coupon_id_code=_long, Coupon_amt_cent=_long, Price_limit_cent=_long, Receive_date=_date, Start_date=_date, End_date=_date, label_valid=_flag, label_same_user_fh=_flag, label_same_user_st=_flag, receipt_key=_long
)
VISIT = _struct(User_id_code=_long, Visit_date=_date)

# Public holidays and make-up working days, mainland China, first half of 2023.
HOLIDAYS = [
    date(2023, 1, 1), date(2023, 1, 2),
    date(2023, 1, 21), date(2023, 1, 22), date(2023, 1, 23), date(2023, 1, 24), date(2023, 1, 25), date(2023, 1, 26), date(2023, 1, 27),
    date(2023, 4, 5),
    date(2023, 4, 29), date(2023, 4, 30), date(2023, 5, 1), date(2023, 5, 2), date(2023, 5, 3),
    date(2023, 6, 22), date(2023, 6, 23), date(2023, 6, 24),
]
WORKDAYS = [date(2023, 1, 28), date(2023, 1, 29), date(2023, 4, 23), date(2023, 5, 6), date(2023, 6, 25)]

BINS = ["Price_limit_bin", "Coupon_limit_bin", "Expiry_span_bin"]
LABELS = ["label_invalid", "label_same_user_fh", "label_same_user_st"]
FOLDS = ["fold_1_marker", "fold_2_marker", "fold_3_marker"]
#: Never features: keys, dates and fold markers.
NOT_FEATURES = ["receipt_key", "receipt_key_1", "receipt_key_2", *FOLDS, "Receive_date", "Start_date", "End_date"]
