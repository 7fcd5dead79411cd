"""DuckDB SQL for every query of ``plans.queries``: plain joins and correlated ranges, without the engine's rewrites."""

from __future__ import annotations

from .demo import SQL as BASE


def ratio(n: str, d: str, scale: int = 1000) -> str:
    """n / d for whole numbers, half away from zero."""
    return f"CASE WHEN ({d}) = 0 THEN CAST(0 AS DOUBLE) ELSE sign({n}) * sign({d}) * CAST(({2 * scale} * abs({n}) + abs({d})) // (2 * abs({d})) AS DOUBLE) / {scale} END"


R = """r AS (SELECT *, CASE WHEN Start_date IS NULL OR Receive_date IS NULL THEN NULL ELSE greatest(Start_date, Receive_date) END AS start_eff, End_date AS end_eff,
    CASE WHEN End_date IS NULL OR Receive_date IS NULL THEN NULL ELSE least(End_date, Receive_date + 15) END AS short_end FROM receipts)"""
T = "t AS (SELECT * FROM {txns} WHERE Coupon_id_code <> -1 AND Pay_date IS NOT NULL)"
LABELS = """su AS (
  SELECT r.receipt_key, count(*) FILTER (t.Pay_date BETWEEN r.start_eff AND r.end_eff) AS valid_n, count(*) FILTER (t.Pay_date BETWEEN r.start_eff AND r.short_end) AS short_n,
    count(*) FILTER (t.Pay_date < r.Start_date) AS early_1, count(*) FILTER (t.Pay_date BETWEEN r.Start_date AND r.End_date) AS spanned,
    max(t.Pay_date) FILTER (t.Pay_date BETWEEN r.Start_date AND r.End_date) AS last_spanned, count(*) FILTER (t.Pay_date > r.End_date) AS late_n, any_value(r.Receive_date) AS rcv
  FROM r JOIN t ON r.User_id_code = t.User_id_code AND r.Coupon_id_code = t.Coupon_id_code WHERE r.User_id_code <> -1 GROUP BY 1),
fv AS (
  SELECT receipt_key, txn_key, Pay_date FROM (
    SELECT r.receipt_key, t.txn_key, t.Pay_date, row_number() OVER (PARTITION BY r.receipt_key ORDER BY t.Pay_date, t.txn_key) AS n
    FROM r JOIN t ON r.User_id_code = t.User_id_code AND r.Coupon_id_code = t.Coupon_id_code AND t.Pay_date BETWEEN r.start_eff AND r.end_eff WHERE r.User_id_code <> -1) WHERE n = 1),
hits AS (
  SELECT r.receipt_key, t.txn_key, t.User_id_code AS other, t.Coupon_id_code AS coupon, t.Pay_date
  FROM r JOIN t ON t.Coupon_id_code = r.Coupon_id_code AND t.User_id_code <> r.User_id_code AND t.Pay_date BETWEEN r.start_eff AND r.end_eff WHERE r.User_id_code <> -1),
own AS (SELECT DISTINCT t.txn_key FROM t JOIN r ON t.User_id_code = r.User_id_code AND t.Coupon_id_code = r.Coupon_id_code AND t.Pay_date BETWEEN r.start_eff AND r.end_eff WHERE r.User_id_code <> -1),
cu AS (SELECT h.receipt_key, count(*) AS in_window, count(*) FILTER (own.txn_key IS NULL) AS without_own FROM hits h LEFT JOIN own USING (txn_key) GROUP BY 1),
lab_0 AS (
  SELECT r.receipt_key, r.User_id_code, r.Coupon_id_code, r.Receive_date, r.Start_date, r.End_date, r.start_eff, r.end_eff, r.short_end,
    CAST(coalesce(su.valid_n, 0) > 0 AS INTEGER) AS label_same_user_fh, CAST(coalesce(su.short_n, 0) > 0 AS INTEGER) AS label_same_user_st, r.Coupon_status, r.Coupon_amt_cent, r.Price_limit_cent,
    fv.txn_key AS first_valid_txn_key, fv.Pay_date AS first_valid_txn_time, coalesce(su.valid_n, 0) AS same_user_valid_txn_count,
    coalesce(su.early_1, 0) + CASE WHEN su.last_spanned < su.rcv THEN su.spanned ELSE 0 END AS same_user_early_txn_count, coalesce(su.late_n, 0) AS same_user_late_txn_count,
    coalesce(cu.in_window, 0) AS other_user_in_window_txn_count, coalesce(cu.without_own, 0) AS other_user_without_own_receipt_txn_count
  FROM r LEFT JOIN su USING (receipt_key) LEFT JOIN fv USING (receipt_key) LEFT JOIN cu USING (receipt_key)),
lab_1 AS (
  SELECT *, CAST(same_user_early_txn_count > 0 AS INTEGER) AS flag_early, CAST(same_user_late_txn_count > 0 AS INTEGER) AS flag_late, CAST(other_user_without_own_receipt_txn_count > 0 AS INTEGER) AS flag_cross_user,
    CASE WHEN User_id_code IS NULL OR User_id_code = -1 OR Coupon_id_code IS NULL OR Coupon_id_code = -1 OR Receive_date IS NULL OR Start_date IS NULL OR End_date IS NULL OR Start_date > End_date THEN 1 ELSE 0 END AS flag_struc_invalid
  FROM lab_0),
lab AS (SELECT *, CASE WHEN flag_early + flag_late + flag_cross_user + flag_struc_invalid > 0 THEN 0 ELSE 1 END AS label_valid FROM lab_1)"""
COUPON = """cpn AS (
  SELECT receipt_key, User_id_code, Coupon_id_code, Price_limit_cent, Coupon_amt_cent, Receive_date, Start_date, End_date, 1 - label_valid AS label_invalid, label_same_user_fh, label_same_user_st,
    CASE WHEN Price_limit_cent <= 1000 THEN 0 WHEN Price_limit_cent <= 10000 THEN 1 ELSE 2 END AS Price_limit_bin, CASE WHEN Coupon_amt_cent <= 1000 THEN 0 WHEN Coupon_amt_cent <= 10000 THEN 1 ELSE 2 END AS Coupon_limit_bin,
    CASE WHEN End_date BETWEEN Start_date AND Start_date + 10 THEN 0 WHEN End_date > Start_date + 10 THEN 1 ELSE -1 END AS Expiry_span_bin,
    CAST(Coupon_amt_cent AS DOUBLE) / (Price_limit_cent + 1) AS Generosity_ratio,
    CASE WHEN Start_date >= Receive_date THEN 0 WHEN Start_date < Receive_date THEN 1 END AS Start_bf_receive_marker, CASE WHEN End_date >= Receive_date THEN 0 WHEN End_date < Receive_date THEN 1 END AS End_bf_receive_marker,
    CASE WHEN isodow(Receive_date) <= 5 THEN 1 ELSE 0 END AS Weekday_marker, CASE WHEN Receive_date = DATE '2024-01-07' THEN 1 ELSE 0 END AS Workday_marker, CASE WHEN Receive_date = DATE '2024-01-01' THEN 1 ELSE 0 END AS Holiday_marker
  FROM lab)"""
IMPUTED = """fits AS (
  SELECT x.txn_key, count(y.receipt_key) AS n, min(y.Coupon_id_code) AS coupon
  FROM txns x JOIN receipts y ON x.User_id_code = y.User_id_code AND x.Pay_date BETWEEN greatest(y.Receive_date, y.Start_date) AND y.End_date
  WHERE x.Coupon_id_code = -1 AND x.User_id_code <> -1 AND y.Receive_date IS NOT NULL AND y.Start_date <= y.End_date GROUP BY 1),
imp_0 AS (
  SELECT txns.*, fits.coupon, CASE WHEN Coupon_id_code = -1 AND coalesce(fits.n, 0) = 1 THEN 1 ELSE 0 END AS coupon_id_imputed,
    CASE WHEN Coupon_id_code = -1 AND fits.n IS NULL AND User_id_code <> -1 AND Pay_date IS NOT NULL AND abs(Reduce_amount_cent) < 1 THEN 1 ELSE 0 END AS flag_no_coupon
  FROM txns LEFT JOIN fits USING (txn_key)),
imp AS (
  SELECT * EXCLUDE (coupon) REPLACE (CASE WHEN coupon_id_imputed = 1 THEN coupon ELSE Coupon_id_code END AS Coupon_id_code),
    CASE WHEN imp_0.Coupon_id_code = -1 AND coupon_id_imputed = 0 AND flag_no_coupon = 0 THEN 1 ELSE 0 END AS flag_ambiguous_txn
  FROM imp_0)"""
FLAGS = """flg AS (
  SELECT txn_key, coupon_id_imputed, CASE WHEN Coupon_id_code <> -1 AND Coupon_id_code NOT IN (SELECT Coupon_id_code FROM receipts WHERE Coupon_id_code IS NOT NULL) THEN 1 ELSE 0 END AS flag_untracked_coupon,
    CASE WHEN User_id_code = -1 OR Shop_id_code = -1 OR Order_id_code = -1 OR (Coupon_id_code = -1 AND flag_no_coupon <> 1) OR Coupon_type IS NULL OR Biz_code IS NULL OR Pay_date IS NULL OR Actual_pay_cent IS NULL OR Reduce_amount_cent IS NULL
      THEN 1 ELSE 0 END AS flag_missing_info,
    CASE WHEN Actual_pay_cent < 0 OR Reduce_amount_cent < 0 OR (Reduce_amount_cent > 0 AND flag_no_coupon = 1) THEN 1 ELSE 0 END AS flag_pay_or_reduce_amt_abn FROM imp)"""
SCORED = "s AS (SELECT txn_key AS id, CASE WHEN txn_key % 5 IN (1, 3) THEN 1 ELSE 0 END AS y_true, CAST(txn_key * 7919 % 1009 AS DOUBLE) / 1009 AS y_pred, Actual_pay_cent FROM txns)"
SPEND = """ord AS (SELECT User_id_code, Pay_date, Order_id_code, max(Actual_pay_cent) AS paid, sum(Reduce_amount_cent) AS reduced FROM txns GROUP BY ALL),
spend AS (SELECT User_id_code, Pay_date, count(Order_id_code) AS orders, CAST(sum(paid) AS BIGINT) AS paid, CAST(sum(reduced) AS BIGINT) AS reduced FROM ord GROUP BY ALL)"""


def q(*parts: str, select: str) -> str:
    return f"WITH {', '.join([BASE, *parts])}\n{select}"


TX = T.format(txns="txns")
LAB = (R, TX, LABELS)
CPN = (*LAB, COUPON)


def _past(name: str, source: str, day: str, keys: list[str], sums: dict[str, str], n: int) -> str:
    """By receipt: sums over the n days before it, and ``old``: rows at least n + 1 days before."""
    on = " AND ".join(f"p.{k} = c.{k}" for k in keys)
    cols = ", ".join(f"CAST(coalesce(sum({v}) FILTER (p.{day} BETWEEN c.Receive_date - {n} AND c.Receive_date - 1), 0) AS BIGINT) AS {k}" for k, v in sums.items())
    return f"{name} AS (SELECT c.receipt_key, {cols}, count(*) FILTER (p.{day} <= c.Receive_date - {n + 1}) AS old FROM cpn c LEFT JOIN {source} p ON {on} AND p.{day} < c.Receive_date GROUP BY 1)"


OUTCOMES = {"invalid": "p.label_invalid", "fh_redeem": "p.label_same_user_fh", "st_redeem": "p.label_same_user_st", "vol": "CASE WHEN p.receipt_key IS NOT NULL THEN 1 END"}
SEG = ["Price_limit_bin", "Coupon_limit_bin", "Expiry_span_bin"]


def _rates(prefix: str, t: str, n: int) -> str:
    return ", ".join(f"{ratio(f'{t}.{k}', f'{t}.vol')} AS {prefix}{k}_{n}d" for k in ("invalid", "fh_redeem", "st_redeem"))


def _old(t: str, name: str, n: int) -> str:
    return f"CASE WHEN {t}.old > 0 THEN 0 ELSE 1 END AS {name}_{n}d"


def _seg(n):
    return _past(f"seg{n}", "cpn", "Receive_date", SEG, OUTCOMES, n), f"{_old(f'seg{n}', 'no_history_indicator', n)}, {_rates('Rate_', f'seg{n}', n)}", f"seg{n}"


def _user(n):
    return _past(f"usr{n}", "cpn", "Receive_date", ["User_id_code"], OUTCOMES, n), f"{_old(f'usr{n}', 'no_hist_rcs_marker', n)}, {_rates('Rate_same_user_', f'usr{n}', n)}", f"usr{n}"


def _spend(n):
    t = f"spd{n}"
    over = lambda a, limit: f"CASE WHEN {t}.orders = 0 THEN 0 ELSE {ratio(f'{t}.{a}', f'({t}.orders * (c.{limit} + 1))')} END"
    cols = f"{_old(t, 'no_hist_txns_marker', n)}, {over('paid', 'Price_limit_cent')} AS Rt_avgspend_vs_pricelimit_{n}d, {over('reduced', 'Coupon_amt_cent')} AS Rt_avgreduce_vs_couponamt_{n}d, {ratio(f'{t}.orders', str(n))} AS Freq_purchase_{n}d"
    return _past(t, "spend", "Pay_date", ["User_id_code"], {"orders": "p.orders", "paid": "p.paid", "reduced": "p.reduced"}, n), cols, t


def _visit(n):
    t = f"vis{n}"
    return _past(t, "visits", "Visit_date", ["User_id_code"], {"visits": "CASE WHEN p.User_id_code IS NOT NULL THEN 1 END"}, n), f"{_old(t, 'no_hist_visits_marker', n)}, {ratio(f'{t}.visits', str(n))} AS Freq_visit_{n}d", t


def _look(*kinds, columns: str = "c.receipt_key", tail: str = "") -> str:
    got = [k(n) for k in kinds for n in (7, 14)]
    joins = " ".join(f"LEFT JOIN {t} ON {t}.receipt_key = c.receipt_key" for _, _, t in got)
    return q(*CPN, SPEND, *[p for p, _, _ in got], select=f"SELECT {columns}, {', '.join(c for _, c, _ in got)}{tail} FROM cpn c {joins}")


def _folds(kind: str) -> str:
    before = (lambda d: f"End_date < DATE '{d}'") if kind == "policy" else (lambda d: f"Receive_date < DATE '{d}' - 5")
    return q(*CPN, select=f"""SELECT receipt_key, label_invalid, CASE WHEN Receive_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-14' THEN 2 WHEN {before('2024-01-10')} THEN 1 ELSE 0 END AS fold_1_marker, 'train' AS part
FROM cpn WHERE End_date <= DATE '2024-01-31' AND {before('2024-01-22')}
UNION ALL SELECT receipt_key, label_invalid, NULL, 'test' FROM cpn WHERE End_date <= DATE '2024-01-31' AND Receive_date >= DATE '2024-01-22'""")


RANGES = [("2024-01-08", "2024-01-10"), ("2024-01-12", "2024-01-14"), ("2024-01-16", "2024-01-19")]


def _three(kind: str) -> str:
    before = (lambda d: f"End_date < DATE '{d}'") if kind == "policy" else (lambda d: f"Receive_date < DATE '{d}' - 5")
    marks = ", ".join(f"CASE WHEN Receive_date BETWEEN DATE '{a}' AND DATE '{b}' THEN 2 WHEN {before(a)} THEN 1 ELSE 0 END AS fold_{i}_marker" for i, (a, b) in enumerate(RANGES, 1))
    return q(*CPN, select=f"""SELECT receipt_key, {marks} FROM cpn WHERE End_date <= DATE '2024-01-31' AND {before('2024-01-22')}
UNION ALL SELECT receipt_key, NULL, NULL, NULL FROM cpn WHERE End_date <= DATE '2024-01-31' AND Receive_date >= DATE '2024-01-22'""")


def _auc(where: str) -> str:
    return f"(SELECT CAST(sum(CASE WHEN a.y_pred > b.y_pred THEN 2 WHEN a.y_pred = b.y_pred THEN 1 ELSE 0 END) AS DOUBLE) / (2 * CAST(count(*) AS DOUBLE)) FROM s a, s b WHERE a.y_true = 1 AND b.y_true = 0 AND a.{where} AND b.{where})"


def _listed(name: str, part: str, columns: list[tuple[str, str]]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(repr(c) for c in columns)}) v({name}, {part})"


def _shares(table: str, parts: tuple[str, ...], columns: list[str]) -> str:
    return q(*parts, select="\nUNION ALL ".join(f"SELECT '{c}' AS flag, CAST(sum({c}) AS BIGINT) AS n, CAST(sum({c}) AS DOUBLE) / count(*) AS share FROM {table}" for c in columns))


def _boxes() -> str:
    top = "1000000000000000"
    out = []
    for a, b in (("0", "1000"), ("1000", "10000"), ("10000", top)):
        for c, d in (("0", "1000"), ("1000", "10000"), ("10000", top)):
            for e, f in (("0", "10"), ("10", "365")):
                pc = lambda x: f"CASE WHEN count(*) > 0 THEN {ratio(f'CAST(100 * sum({x}) AS BIGINT)', 'count(*)', 100)} END"
                out.append(f"""SELECT max(Price_limit_cent) AS Price_limit_upper_bin, max(Coupon_amt_cent) AS Coupon_limit_upper_bin, CAST(max(End_date - Start_date) AS INTEGER) AS Expiry_span_upper_bin,
  {pc('label_valid')} AS validity_pc, {pc('label_same_user_fh')} AS redeem_fh_pc, {pc('label_same_user_st')} AS redeem_st_pc, count(*) AS receipts_count
FROM lab WHERE Price_limit_cent BETWEEN {a} AND {b} AND Coupon_amt_cent BETWEEN {c} AND {d} AND End_date BETWEEN Start_date + {e} AND Start_date + {f}""")
    return q(*LAB, select="\nUNION ".join(out))


def _accuracy(k: int) -> list[str]:
    hit = {1: "y_pred >= {}", 0: "NOT y_pred >= {}"}[k]
    return [f"SELECT {k} AS class, CAST({t} AS DOUBLE) AS threshold, CAST(count(*) FILTER (y_true = {k} AND {hit.format(t)}) AS DOUBLE) / count(*) FILTER (y_true = {k}) AS accuracy FROM s" for t in (0.25, 0.5, 0.75)]


def _narrow(c: str) -> str:
    return f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS type_{c}"


_NULLS = ["txn_key", "User_id_code", "Shop_id_code", "Order_id_code", "Coupon_id_code", "Coupon_type", "Biz_code", "Pay_date", "Actual_pay_cent", "Reduce_amount_cent"]
_COUPON_HEAD = "c.receipt_key, c.Price_limit_cent, c.Coupon_amt_cent, c.Receive_date, c.Start_date, c.End_date, c.Price_limit_bin, c.Coupon_limit_bin, c.Expiry_span_bin, c.Generosity_ratio, c.Start_bf_receive_marker, c.End_bf_receive_marker, c.Weekday_marker, c.Workday_marker, c.Holiday_marker"
STRICT = (IMPUTED, R, "t AS (SELECT * FROM imp WHERE Coupon_id_code <> -1 AND Pay_date IS NOT NULL AND coupon_id_imputed = 0)", LABELS)

ORACLE_SQL = {
    "dedupe_rows": q(select="SELECT DISTINCT User_id_code, Shop_id_code, Coupon_id_code, Biz_code FROM txns"),
    "money_to_cents": "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round_even(value * 100, 0) AS BIGINT) END AS paid_cent, CASE WHEN event_id % 11 = 0 OR value <> floor(value) THEN NULL ELSE CAST(value AS BIGINT) END AS whole FROM events",
    "parse_dates": "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events",
    "dict_encode_ids": q("ids AS (SELECT DISTINCT User_id_code FROM (SELECT User_id_code FROM receipts UNION ALL SELECT User_id_code FROM visits) WHERE User_id_code >= 0)", "m AS (SELECT User_id_code, row_number() OVER (ORDER BY User_id_code) - 1 AS code FROM ids)", select="SELECT x.receipt_key, CAST(coalesce(m.code, -1) AS BIGINT) AS User_id_code FROM receipts x LEFT JOIN m USING (User_id_code)"),
    "surrogate_keys": q(select="SELECT User_id_code, Pay_date, CAST(row_number() OVER (ORDER BY User_id_code NULLS LAST, Pay_date NULLS LAST) - 1 AS BIGINT) AS pair_key FROM (SELECT DISTINCT User_id_code, Pay_date FROM txns)"),
    "null_profile": q(select="\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows FROM txns" for c in _NULLS)),
    "narrow_types_minmax": q(select="SELECT " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, {_narrow(c)}" for c in ("User_id_code", "Order_id_code", "Actual_pay_cent")) + " FROM txns"),
    "value_counts": q(select="SELECT Coupon_id_code, Coupon_status, count(*) AS n FROM receipts GROUP BY 1, 2"),
    "window_nunique_check": q(select="SELECT User_id_code, count(DISTINCT Coupon_id_code) AS n_Coupon_id_code, count(DISTINCT Start_date) AS n_Start_date FROM receipts GROUP BY 1 HAVING count(DISTINCT Coupon_id_code) > 1 OR count(DISTINCT Start_date) > 1"),
    "impute_missing_coupon": q(IMPUTED, select="SELECT txn_key, Coupon_id_code, coupon_id_imputed, flag_no_coupon, flag_ambiguous_txn FROM imp"),
    "txn_flags": q(IMPUTED, FLAGS, select="SELECT * EXCLUDE (coupon_id_imputed) FROM flg"),
    "txn_flags_strict": q(IMPUTED, FLAGS, select="SELECT * EXCLUDE (coupon_id_imputed) FROM flg WHERE coupon_id_imputed = 0"),
    "txn_flag_proportions": _shares("flg", (IMPUTED, FLAGS), ["flag_untracked_coupon", "flag_missing_info", "flag_pay_or_reduce_amt_abn"]),
    "untracked_coupon_anti": q(select="SELECT txn_key, Coupon_id_code FROM txns WHERE Coupon_id_code <> -1 AND NOT EXISTS (SELECT 1 FROM receipts x WHERE x.Coupon_id_code = txns.Coupon_id_code)"),
    "labels_same_user": q(*LAB, select="SELECT receipt_key, start_eff, end_eff, short_end, label_same_user_fh, label_same_user_st FROM lab"),
    "first_valid_txn": q(*LAB, select="SELECT receipt_key, first_valid_txn_key, first_valid_txn_time FROM lab"),
    "early_late_counts": q(*LAB, select="SELECT receipt_key, same_user_valid_txn_count, same_user_early_txn_count, same_user_late_txn_count FROM lab"),
    "cross_user_audit": q(*LAB, select="SELECT receipt_key, other_user_in_window_txn_count, other_user_without_own_receipt_txn_count FROM lab"),
    "labels_full": q(*LAB, select="SELECT * FROM lab"),
    "labels_strict": q(*STRICT, select="SELECT receipt_key, label_same_user_fh, label_same_user_st, label_valid FROM lab"),
    "coupon_bins": q(*CPN, select="SELECT receipt_key, Price_limit_bin, Coupon_limit_bin, Expiry_span_bin, Generosity_ratio FROM cpn"),
    "coupon_markers": q(*CPN, select="SELECT receipt_key, Start_bf_receive_marker, End_bf_receive_marker FROM cpn"),
    "calendar_markers": q(*CPN, select="SELECT receipt_key, Weekday_marker, Workday_marker, Holiday_marker FROM cpn"),
    "segment_lookback": _look(_seg),
    "user_receipt_lookback": _look(_user),
    "user_spend_lookback": _look(_spend),
    "user_visit_lookback": _look(_visit),
    "asof_prefix": q(select="SELECT x.receipt_key, x.User_id_code, x.Receive_date, count(v.Visit_date) AS n_before, max(v.Visit_date) AS last_day FROM receipts x LEFT JOIN visits v ON v.User_id_code = x.User_id_code AND v.Visit_date <= x.Receive_date - 1 GROUP BY 1, 2, 3"),
    "order_rollup": q(SPEND, select="SELECT * FROM spend"),
    "segment_diagnostics": _boxes(),
    "segment_redemption_rate": q(*CPN, select=f"SELECT Price_limit_bin, Coupon_limit_bin, Expiry_span_bin, CAST(sum(label_same_user_st) AS BIGINT) AS redeemed, count(*) AS n, {ratio('CAST(sum(label_same_user_st) AS BIGINT)', 'count(*)')} AS rate FROM cpn GROUP BY 1, 2, 3"),
    "receipt_flag_shares": _shares("lab_2", (*LAB, "lab_2 AS (SELECT *, CASE WHEN same_user_valid_txn_count > 1 THEN 1 ELSE 0 END AS flag_repeat FROM lab)"), ["flag_early", "flag_late", "flag_cross_user", "flag_struc_invalid", "flag_repeat"]),
    "union_by_name_distinct": q(select="SELECT User_id_code, Coupon_id_code FROM receipts UNION BY NAME SELECT Coupon_id_code, User_id_code, Biz_code FROM txns"),
    "trainable_join": _look(_seg, _user, _spend, _visit, columns=_COUPON_HEAD, tail=", c.label_invalid, c.label_same_user_fh, c.label_same_user_st"),
    "policy_split_folds": _folds("policy"),
    "roi_split_folds": _folds("roi"),
    "fold_datasets": q(*CPN, select="""SELECT 'train' AS part, count(*) AS n, CAST(coalesce(sum(label_same_user_st), 0) AS BIGINT) AS positives FROM cpn WHERE label_invalid = 0 AND End_date <= DATE '2024-01-31' AND Receive_date < DATE '2024-01-05'
UNION ALL SELECT 'validation', count(*), CAST(coalesce(sum(label_same_user_st), 0) AS BIGINT) FROM cpn WHERE label_invalid = 0 AND End_date <= DATE '2024-01-31' AND Receive_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'"""),
    "dnf_filter": q(*CPN, select="SELECT receipt_key FROM cpn WHERE label_same_user_st <> 1 AND ((Price_limit_bin = 2 AND Coupon_limit_bin = 0 AND Expiry_span_bin = 0) OR (Price_limit_bin = 1 AND Coupon_limit_bin = 0 AND Expiry_span_bin = 1))"),
    "segment_catalog": q(*CPN, select="""SELECT CASE WHEN Expiry_span_bin = -1 THEN NULL WHEN (Price_limit_bin, Coupon_limit_bin, Expiry_span_bin) = (0, 0, 1) THEN 'seg_001' WHEN Price_limit_bin = 0 AND Coupon_limit_bin IN (1, 2) AND Expiry_span_bin = 1 THEN 'seg_011_and_021'
WHEN (Price_limit_bin, Coupon_limit_bin, Expiry_span_bin) = (0, 1, 0) THEN 'seg_010' WHEN (Price_limit_bin, Coupon_limit_bin, Expiry_span_bin) = (0, 0, 0) THEN 'seg_000' ELSE 'oth_segs' END AS segment_id, count(*) AS n FROM cpn GROUP BY 1"""),
    "class_weights": q(SCORED, select="SELECT id, CAST(count(*) OVER () AS DOUBLE) / count(*) OVER (PARTITION BY y_true) AS weight FROM s"),
    "per_class_accuracy": q(SCORED, select="\nUNION ALL ".join([*_accuracy(1), *_accuracy(0)])),
    "roc_auc_exact": q(SCORED, select="SELECT CAST(sum(CASE WHEN a.y_pred > b.y_pred THEN 2 WHEN a.y_pred = b.y_pred THEN 1 ELSE 0 END) AS DOUBLE) / (2 * CAST(count(*) AS DOUBLE)) AS auc FROM s a, s b WHERE a.y_true = 1 AND b.y_true = 0"),
    "top5_profit": q(SCORED, "k AS (SELECT *, row_number() OVER (ORDER BY y_pred DESC, id) AS n, count(*) OVER () AS all_n FROM s)", select="SELECT avg(y_true) AS rate, avg(Actual_pay_cent) AS profit, count(*) AS n FROM k WHERE n <= ceil(CAST(all_n AS DOUBLE) * 5 / 100)"),
    "per_class_accuracy_rounded": q(SCORED, select="SELECT threshold, round_even(accuracy * 1000, 0) / 1000 AS accuracy, class FROM (" + "\nUNION ALL ".join([*_accuracy(1), *_accuracy(0)]) + ")"),
    "roc_auc_mean_of_folds": q(SCORED, f"f AS (SELECT {', '.join(f'{_auc(f"id % 3 = {i}")} AS auc_{i}' for i in range(3))})", select="SELECT *, round((auc_0 + auc_1 + auc_2) / 3, 12) AS mean_auc FROM f"),
    "policy_three_folds": _three("policy"),
    "roi_three_folds": _three("roi"),
    "split_without_folds": q(*CPN, select="SELECT receipt_key, 'false' AS has_folds FROM cpn WHERE End_date < DATE '2024-01-22' UNION ALL SELECT receipt_key, 'test' FROM cpn WHERE Receive_date >= DATE '2024-01-22'"),
    "dataset_columns": _listed("column_name", "part", [*[(c, "x") for c in ("User_id_code", "Coupon_id_code", "Price_limit_cent", "Coupon_amt_cent", "Generosity_ratio", "Start_bf_receive_marker", "End_bf_receive_marker", "Weekday_marker", "Workday_marker", "Holiday_marker")], ("label_same_user_st", "y")]),
    "csv_ingest": q(select="SELECT txn_key, Pay_date, Coupon_type, Actual_pay_cent, Reduce_amount_cent, Biz_code FROM txns"),
    "csv_typed": q(select="SELECT receipt_key, Receive_date, Price_limit_cent FROM receipts"),
    "csv_first_rows": q(select="SELECT least(17, count(*)) AS n FROM txns"),
    "parquet_round_trip": q(select="SELECT receipt_key, Receive_date, Start_date, End_date FROM receipts WHERE Coupon_status = 2"),
    "parameter_table": "SELECT * FROM (VALUES (DATE '2024-01-01'), (DATE '2024-05-01')) v(holiday)",
    "metrics_history": "SELECT '{\"auc\": 0.5, \"run\": ' || run || '}' AS metrics FROM (VALUES (1), (2)) v(run)",
    "keys_and_originals": "SELECT column_name, true AS same_keys FROM (VALUES ('receipt_key'), ('User_id_code'), ('Coupon_id_code'), ('Coupon_amt_cent'), ('Receive_date'), ('Start_date'), ('Price_limit_cent'), ('Coupon_status'), ('End_date')) v(column_name)",
    "sorted_ranks": q(select="SELECT receipt_key, Receive_date, CAST(row_number() OVER (ORDER BY Receive_date NULLS FIRST, receipt_key) - 1 AS BIGINT) AS place FROM receipts"),
    "gbt_predictions": q(*CPN, select="SELECT receipt_key, CASE WHEN Price_limit_bin = 1 OR Coupon_limit_bin = 0 THEN 1 ELSE 0 END AS predicted FROM cpn"),
    "gbt_dump_predictions": q(*CPN, select="SELECT receipt_key, CASE WHEN Price_limit_bin = 1 OR Coupon_limit_bin = 0 THEN 1 ELSE 0 END AS predicted FROM cpn"),
    "profit_at_thresholds": q(SCORED, select="\nUNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) AS n, CAST(sum(Actual_pay_cent) AS DOUBLE) / count(*) AS profit FROM s WHERE y_pred >= {t}" for t in (0.25, 0.5, 0.75))),
    "mean_profit": q(SCORED, select="SELECT CAST(sum(Actual_pay_cent) AS DOUBLE) / count(*) AS profit, count(*) AS n FROM s"),
    "net_profit_test_set": q(*LAB, select="SELECT lab.receipt_key, coalesce(x.Actual_pay_cent, 0) AS Actual_pay_cent FROM lab LEFT JOIN txns x ON x.txn_key = lab.first_valid_txn_key WHERE lab.Receive_date >= DATE '2024-01-22'"),
    "tree_score": q(*CPN, "m AS (SELECT receipt_key, CASE WHEN coalesce(Coupon_amt_cent, 0) <= 5000.5 THEN CAST(0.5 AS DOUBLE) WHEN Price_limit_cent IS NULL OR Price_limit_cent <= 2000 THEN -0.25 ELSE 0.125 END AS a, CASE WHEN Expiry_span_bin = 0 THEN CAST(0.25 AS DOUBLE) ELSE -0.75 END AS b FROM cpn)", select="SELECT receipt_key, round(1 / (1 + exp(-(a + b))), 9) AS y_pred, b AS raw_second FROM m"),
}
