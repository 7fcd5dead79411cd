import random

import pytest

from voucherflow.operators.flags import flag_shares, flag_transactions, untracked
from voucherflow.operators.reconcile import FLAGS, impute_missing_coupons

WINDOW = ("2023-01-09", "2023-01-09", "2023-01-15")


def one(make, txn, *receipts):
    r = impute_missing_coupons(make.txns(txn), make.receipts(*receipts)).collect()[0]
    return (r["Coupon_id_code"], *[r[f] for f in FLAGS])


def test_unique_match(make):
    assert one(make, (1, -1, "2023-01-10"), (1, 100, *WINDOW)) == (100, 1, 0, 0)


def test_two_candidates_are_ambiguous_even_of_one_coupon(make):
    assert one(make, (1, -1, "2023-01-10"), (1, 100, *WINDOW), (1, 101, *WINDOW)) == (-1, 0, 0, 1)
    assert one(make, (1, -1, "2023-01-10"), (1, 100, *WINDOW), (1, 100, *WINDOW)) == (-1, 0, 0, 1)


def test_no_match(make):
    assert one(make, (1, -1, "2023-01-20"), (1, 100, *WINDOW)) == (-1, 0, 1, 0)
    assert one(make, (1, -1, "2023-01-20", 500, 50), (1, 100, *WINDOW)) == (-1, 0, 0, 1)


@pytest.mark.parametrize(("pay", "coupon"), [("2023-01-08", -1), ("2023-01-09", 100), ("2023-01-15", 100), ("2023-01-16", -1)])
def test_edges_are_inclusive(make, pay, coupon):
    assert one(make, (1, -1, pay), (1, 100, *WINDOW))[0] == coupon


def test_receipt_after_start_counts_from_the_receipt(make):
    assert one(make, (1, -1, "2023-01-10"), (1, 100, "2023-01-11", "2023-01-09", "2023-01-15"))[0] == -1


def test_unusable_rows(make):
    assert one(make, (1, -1, "2023-01-10"), (1, 100, "2023-01-09", "2023-01-16", "2023-01-15")) == (-1, 0, 1, 0)
    assert one(make, (-1, -1, "2023-01-10"), (-1, 100, *WINDOW)) == (-1, 0, 0, 1)
    assert one(make, (1, -1, None), (1, 100, *WINDOW)) == (-1, 0, 0, 1)
    assert one(make, (2, -1, "2023-01-10"), (1, 100, *WINDOW)) == (-1, 0, 1, 0)


def test_known_coupons_are_left_alone(make):
    assert one(make, (1, 55, "2023-01-10"), (1, 100, *WINDOW)) == (55, 0, 0, 0)


def test_empty_tables(make):
    t, r = make.txns((1, -1, "2023-01-10")), make.receipts((1, 100, *WINDOW))
    assert impute_missing_coupons(t.limit(0), r).count() == 0
    assert impute_missing_coupons(t, r.limit(0)).collect()[0]["flag_no_coupon"] == 1


def test_flags(make, by_key):
    r = make.receipts((1, 100, *WINDOW))
    t = impute_missing_coupons(make.txns((1, 100, "2023-01-10"), (1, 999, "2023-01-10"), (1, -1, "2023-02-10"), (1, -1, "2023-02-10", 5, 9), (1, 100, None), (1, 100, "2023-01-10", -5)), r)
    f = by_key(flag_transactions(t, r), "txn_key")
    assert [f[k]["flag_untracked_coupon"] for k in range(1, 7)] == [0, 1, 0, 0, 0, 0]
    assert [f[k]["flag_missing_info"] for k in range(1, 7)] == [0, 0, 0, 1, 1, 0]
    assert [f[k]["flag_pay_or_reduce_amt_abn"] for k in range(1, 7)] == [0, 0, 0, 0, 0, 1]
    assert [x["txn_key"] for x in untracked(t, r).collect()] == [2]
    shares = {x["flag"]: x["share"] for x in flag_shares(flag_transactions(t, r)).collect()}
    assert shares["flag_missing_info"] == pytest.approx(2 / 6)


def test_strict_leaves_imputed_out(make):
    r = make.receipts((1, 100, *WINDOW))
    t = impute_missing_coupons(make.txns((1, -1, "2023-01-10"), (1, 100, "2023-01-10")), r)
    assert [x["txn_key"] for x in flag_transactions(t, r, strict=True).collect()] == [2]


def test_many_windows_of_one_user_equal_plain_loops(make):
    rng = random.Random(12)
    day = lambda n: f"2023-05-{n:02d}"
    receipts = [(rng.choice([1, 1, 1, 2]), rng.choice([None, -1, 100, 101, 102]), day(rng.randint(1, 28)), day(a := rng.randint(1, 28)), day(min(28, max(1, a + rng.randint(-2, 6))))) for _ in range(25)]
    txns = [(rng.choice([1, 2, 3, -1]), -1, rng.choice([None, day(rng.randint(1, 28))]), 500, rng.choice([0, 9])) for _ in range(80)]
    got = {r["txn_key"]: (r["Coupon_id_code"], *[r[f] for f in FLAGS]) for r in impute_missing_coupons(make.txns(*txns), make.receipts(*receipts)).collect()}
    for key, (user, _, pay, _, reduced) in enumerate(txns, 1):
        fits = [r for r in receipts if pay and user != -1 and r[0] == user and r[3] <= r[4] and max(r[2], r[3]) <= pay <= r[4]]
        none = pay is not None and user != -1 and not fits and reduced < 1
        assert got[key] == (fits[0][1] if len(fits) == 1 else -1, int(len(fits) == 1), int(none), int(len(fits) != 1 and not none))
