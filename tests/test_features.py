"""Look-back features against plain loops over the same rows."""

import random
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from voucherflow.operators.features import combine, coupon_features, user_features
from voucherflow.operators.trailing import trailing_sums

DAY0 = date(2023, 4, 3)


def bins(row):
    """By the limits: price, coupon, expiry."""
    _, _, amount, limit, _, start, end, *_ = row
    level = lambda x: 2 if x is None else sum(x > edge for edge in (1000, 10000))
    days = None if start is None or end is None else (end - start).days
    return level(limit), level(amount), -1 if days is None or days < 0 else int(days > 10)


def random_rows(seed, n, users):
    """(user, coupon, amount, limit, receive, start, end, valid, fh, st)"""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        receive = DAY0 + timedelta(rng.randrange(40))
        start = receive + timedelta(rng.randrange(-2, 4))
        fh = rng.randrange(2)
        rows.append((rng.randrange(users), rng.randrange(70, 76), rng.choice([300, 4000, 20000]), rng.choice([500, 8000, 60000]), receive, start, start + timedelta(rng.choice([0, 5, 10, 11, 30])), rng.randrange(2), fh, fh and rng.randrange(2)))
    return rows


def table(make, rows):
    return make.labelled(*[tuple(x.isoformat() if isinstance(x, date) else x for x in r) for r in rows])


def rounded(n, d):
    """n / d to three places, half up; 0 for none."""
    return 0.0 if d == 0 else (2000 * n + d) // (2 * d) / 1000


def rates(past):
    """Share of invalid, redeemed in the full and in the short window."""
    return [rounded(sum(k), len(past)) for k in ([1 - r[7] for r in past], [r[8] for r in past], [r[9] for r in past])]


@pytest.mark.parametrize("seed", [1, 2])
def test_segment_features_equal_plain_loops(make, seed):
    rows = random_rows(seed, 60, 9)
    got = {r["receipt_key"]: r for r in coupon_features(table(make, rows), [6, 13]).collect()}
    for key, row in enumerate(rows, 1):
        r = got[key]
        assert (r["Price_limit_bin"], r["Coupon_limit_bin"], r["Expiry_span_bin"]) == bins(row)
        assert r["Generosity_ratio"] == pytest.approx(row[2] / (row[3] + 1))
        assert (r["Weekday_marker"], r["Start_bf_receive_marker"]) == (int(row[4].weekday() < 5), int(row[5] < row[4]))
        peers = [p for p in rows if bins(p) == bins(row)]
        for n in (5, 12):
            past = [p for p in peers if 1 <= (row[4] - p[4]).days <= n]
            assert [r[f"{c}_{n}d"] for c in ("Rate_invalid", "Rate_fh_redeem", "Rate_st_redeem")] == pytest.approx(rates(past))
            assert r[f"no_history_indicator_{n}d"] == int(not any((row[4] - p[4]).days >= n + 1 for p in peers))


@pytest.mark.parametrize("seed", [3, 4])
def test_user_features_equal_plain_loops(make, seed):
    rng = random.Random(seed)
    rows = random_rows(seed, 50, 4)
    pays = [(rng.randrange(4), 71, DAY0 + timedelta(rng.randrange(40)), rng.randrange(100, 9000), rng.choice([0, 50, 700]), rng.randrange(25)) for _ in range(50)]
    seen = [(rng.randrange(4), DAY0 + timedelta(rng.randrange(40))) for _ in range(30)]
    got = {r["receipt_key"]: r for r in user_features(table(make, rows), make.txns(*[(u, c, d.isoformat(), *x) for u, c, d, *x in pays]), make.visits(*[(u, d.isoformat()) for u, d in seen]), [5]).collect()}
    n = 4
    for key, row in enumerate(rows, 1):
        r = got[key]
        ago = lambda d: (row[4] - d).days  # noqa: E731, B023
        mine = {"rcs": [p[4] for p in rows if p[0] == row[0]], "txns": [p[2] for p in pays if p[0] == row[0]], "visits": [d for u, d in seen if u == row[0]]}
        for kind, days in mine.items():
            assert r[f"no_hist_{kind}_marker_{n}d"] == int(not any(ago(d) >= n + 1 for d in days))
        past = [p for p in rows if p[0] == row[0] and 1 <= ago(p[4]) <= n]
        assert [r[f"Rate_same_user_{c}_{n}d"] for c in ("invalid", "fh_redeem", "st_redeem")] == pytest.approx(rates(past))
        orders = {}
        for u, _, d, paid, reduced, order in pays:
            if u == row[0] and 1 <= ago(d) <= n:
                old = orders.get((d, order), (0, 0))
                orders[d, order] = (max(old[0], paid), old[1] + reduced)
        k, paid, reduced = len(orders), sum(x for x, _ in orders.values()), sum(y for _, y in orders.values())
        assert r[f"Rt_avgspend_vs_pricelimit_{n}d"] == pytest.approx(rounded(paid, k * (row[3] + 1)))
        assert r[f"Rt_avgreduce_vs_couponamt_{n}d"] == pytest.approx(rounded(reduced, k * (row[2] + 1)))
        assert r[f"Freq_purchase_{n}d"] == pytest.approx(rounded(k, n))
        assert r[f"Freq_visit_{n}d"] == pytest.approx(rounded(len([d for d in mine["visits"] if 1 <= ago(d) <= n]), n))


def test_an_unknown_receive_day_has_no_history_and_is_none(make):
    rows = random_rows(5, 12, 3)
    lost = [(2, 74, 300, None, None, "2023-04-05", "2023-04-30", 0, 0, 0)] * 2
    out = coupon_features(make.labelled(*[tuple(x.isoformat() if isinstance(x, date) else x for x in r) for r in rows], *lost), [4]).where("Receive_date is null").collect()
    assert [(r["no_history_indicator_3d"], r["Rate_invalid_3d"], r["Price_limit_bin"], r["Weekday_marker"], r["Start_bf_receive_marker"]) for r in out] == [(1, 0.0, 2, 0, None)] * 2


def test_holidays_and_working_days(make):
    days = [date(2023, 4, 5), date(2023, 4, 23), date(2023, 4, 8)]
    rows = [(1, 70, 300, 500, d, d, d + timedelta(3), 1, 0, 0) for d in days]
    out = coupon_features(table(make, rows), [4]).orderBy("receipt_key").collect()
    assert [(r["Holiday_marker"], r["Workday_marker"], r["Weekday_marker"]) for r in out] == [(1, 0, 1), (0, 1, 0), (0, 0, 0)]


def test_combine_has_one_key(make):
    rows = random_rows(6, 15, 3)
    r = table(make, rows)
    out = combine(coupon_features(r, [8]), user_features(r, make.txns((1, 71, "2023-04-09")), make.visits((1, "2023-04-09")), [8]))
    assert out.columns.count("receipt_key") == 1 and out.count() == len(rows)
    assert out.columns[-3:] == ["label_invalid", "label_same_user_fh", "label_same_user_st"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 25), st.integers(0, 9)), min_size=1, max_size=25, unique_by=lambda x: x[:2]), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 25)), max_size=15))
def test_trailing_sums_equal_plain_sums(spark, source, probes):
    at = lambda n: DAY0 + timedelta(n)
    daily = spark.createDataFrame([(k, at(d), m) for k, d, m in source], "k int, day date, m long")
    asked = spark.createDataFrame([(k, at(d)) for k, d in probes], "k int, day date")
    for r in trailing_sums(daily, ["k"], "day", ["m"], [1, 6], asked).collect():
        for n in (1, 6):
            d = (r["day"] - DAY0).days
            assert r[f"m_{n}d"] == sum(m for k, x, m in source if k == r["k"] and d - n <= x <= d - 1)
            assert r[f"no_history_{n}d"] == (0 if any(k == r["k"] and x <= d - n - 1 for k, x, _ in source) else 1)
