import random
from datetime import date, timedelta

import pytest

from voucherflow.operators.labels import label_receipts


def only(df):
    return df.collect()[0]


def test_full_and_short_window(make, by_key):
    r = make.receipts((1, 7, "2023-01-01", "2023-01-01", "2023-02-28"), (2, 7, "2023-01-01", "2023-01-01", "2023-02-28"), (3, 7, "2023-01-01", "2023-01-01", "2023-02-28"))
    t = make.txns((1, 7, "2023-01-18"), (2, 7, "2023-01-16"), (3, 7, "2023-02-28"))
    out = by_key(label_receipts(r, t))
    assert [(out[k]["label_same_user_fh"], out[k]["label_same_user_st"]) for k in (1, 2, 3)] == [(1, 0), (1, 1), (1, 0)]


def test_windows_are_inclusive_and_start_at_the_later_day(make):
    r = make.receipts((1, 7, "2023-01-05", "2023-01-10", "2023-01-20"))
    for pay, hit in (("2023-01-09", 0), ("2023-01-10", 1), ("2023-01-20", 1), ("2023-01-21", 0)):
        assert only(label_receipts(r, make.txns((1, 7, pay))))["label_same_user_fh"] == hit


def test_early_and_late(make):
    r = make.receipts((1, 7, "2023-01-10", "2023-01-10", "2023-01-20"))
    out = only(label_receipts(r, make.txns((1, 7, "2023-01-04"), (1, 7, "2023-01-21"))))
    assert (out["same_user_early_txn_count"], out["same_user_late_txn_count"], out["flag_early"], out["flag_late"], out["label_valid"]) == (1, 1, 1, 1, 0)


def test_paid_in_the_span_but_before_the_receipt_is_early_unless_paid_again(make):
    r = make.receipts((1, 7, "2023-01-15", "2023-01-10", "2023-01-20"))
    assert only(label_receipts(r, make.txns((1, 7, "2023-01-12"), (1, 7, "2023-01-13"))))["same_user_early_txn_count"] == 2
    assert only(label_receipts(r, make.txns((1, 7, "2023-01-12"), (1, 7, "2023-01-15"))))["same_user_early_txn_count"] == 0


@pytest.mark.parametrize("row", [(1, 7, None, "2023-01-01", "2023-01-05"), (1, 7, "2023-01-01", None, "2023-01-05"), (1, 7, "2023-01-01", "2023-01-01", None), (1, 7, "2023-01-01", "2023-01-06", "2023-01-05"), (-1, 7, "2023-01-01", "2023-01-01", "2023-01-05"), (None, 7, "2023-01-01", "2023-01-01", "2023-01-05"), (1, -1, "2023-01-01", "2023-01-01", "2023-01-05")])
def test_broken_receipts_are_structurally_invalid(make, row):
    out = only(label_receipts(make.receipts(row), make.txns((1, 7, "2023-01-03"), (-1, 7, "2023-01-03"), (1, -1, "2023-01-03"))))
    assert (out["flag_struc_invalid"], out["label_same_user_fh"], out["label_valid"]) == (1, 0, 0)


def test_first_valid_transaction_breaks_ties_by_key(make):
    r = make.receipts((1, 7, "2023-01-01", "2023-01-01", "2023-01-31"))
    out = only(label_receipts(r, make.txns((1, 7, "2023-01-09"), (1, 7, "2023-01-08"), (1, 7, "2023-01-08"))))
    assert (out["first_valid_txn_key"], out["first_valid_txn_time"], out["same_user_valid_txn_count"]) == (2, date(2023, 1, 8), 3)


def test_cross_user(make, by_key):
    r = make.receipts((1, 7, "2023-01-01", "2023-01-01", "2023-01-31"), (2, 7, "2023-01-01", "2023-01-01", "2023-01-31"))
    out = by_key(label_receipts(r, make.txns((2, 7, "2023-01-10"))))
    assert (out[1]["other_user_in_window_txn_count"], out[1]["flag_cross_user"], out[1]["label_valid"]) == (1, 0, 1)
    out = by_key(label_receipts(r, make.txns((3, 7, "2023-01-10"))))
    assert [out[k]["other_user_without_own_receipt_txn_count"] for k in (1, 2)] == [1, 1]
    assert out[1]["label_valid"] == 0


def test_one_transaction_can_serve_two_receipts(make, by_key):
    r = make.receipts((1, 7, "2023-01-01", "2023-01-01", "2023-01-31"), (1, 7, "2023-01-02", "2023-01-01", "2023-01-31"))
    out = by_key(label_receipts(r, make.txns((1, 7, "2023-01-10"))))
    assert [out[k]["label_same_user_fh"] for k in (1, 2)] == [1, 1]


def test_empty_tables(make):
    r, t = make.receipts((1, 7, "2023-01-01", "2023-01-01", "2023-01-31")), make.txns((1, 7, "2023-01-10"))
    assert label_receipts(r.limit(0), t).count() == 0
    out = only(label_receipts(r, t.limit(0)))
    assert (out["label_same_user_fh"], out["label_valid"], out["first_valid_txn_key"]) == (0, 1, None)


def test_counts_equal_the_plain_joins_on_random_rows(make, by_key):
    rng, zero = random.Random(3), date(2023, 1, 1)
    some = lambda: (zero + timedelta(rng.randrange(20))).isoformat()
    rows = [(rng.choice([1, 2, 3, -1]), rng.choice([7, 8]), rng.choice([some(), None]), some(), some()) for _ in range(60)]
    pays = [(rng.choice([1, 2, 3, 4]), rng.choice([7, 8, -1]), some()) for _ in range(60)]
    out = by_key(label_receipts(make.receipts(*rows), make.txns(*pays)))
    span = lambda r: None if r[2] is None else (max(r[2], r[3]), r[4])
    inside = lambda r, p: span(r) is not None and span(r)[0] <= p[2] <= span(r)[1]
    known = [r for r in rows if r[0] != -1]
    for k, r in enumerate(rows, 1):
        others = [p for p in pays if r[0] != -1 and p[1] == r[1] and p[0] != r[0] and inside(r, p)]
        lone = [p for p in others if not any(x[:2] == p[:2] and inside(x, p) for x in known)]
        mine = [p for p in pays if r[0] != -1 and p[:2] == r[:2] and inside(r, p)]
        assert (out[k]["same_user_valid_txn_count"], out[k]["other_user_in_window_txn_count"], out[k]["other_user_without_own_receipt_txn_count"]) == (len(mine), len(others), len(lone))
