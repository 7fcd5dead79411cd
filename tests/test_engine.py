"""Sources, cleaning, splits, metrics, trees, diagnostics."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from voucherflow.functions import scalars as S
from voucherflow.operators import clean, diagnostics, metrics, splits, trees
from voucherflow.plans.queries import MODEL
from voucherflow.sources import tables


def test_csv_ingest(spark, tmp_path):
    (tmp_path / "t.csv").write_text("User_id,Shop_id,Order_id,Coupon_id,Coupon_type,Biz_code,Pay_date,Actual_pay,Reduce_amount,more\nu,s,o,c,1,A,2023-01-02,1.005,0.125,x\nu,s,o,,x,A,2023/01/02,abc,,x\n")
    rows = tables.read_transactions(spark, str(tmp_path / "t.csv")).collect()
    assert (rows[0]["Pay_date"], rows[0]["Reduce_amount_cent"], rows[0]["Coupon_type"], rows[0]["more"]) == (date(2023, 1, 2), 12, 1, "x")
    assert (rows[1]["Pay_date"], rows[1]["Actual_pay_cent"], rows[1]["Coupon_type"], rows[1]["Coupon_id"]) == (None, None, None, None)
    assert "Actual_pay" not in rows[0].asDict()
    assert tables.read_transactions(spark, str(tmp_path / "t.csv"), nrows=1).count() == 1
    with pytest.raises(ValueError, match=r"\[visits\] missing columns: \['Visit_date'\]"):
        tables.read_visits(spark, str(tmp_path / "t.csv"))


def test_parquet_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_parquet(spark.createDataFrame([(1, 2, "a"), (2, 2, "b"), (2, 3, None)], "x int, y int, z string"), path)
    df = tables.read_parquet(spark, path, ["z"], [[("x", "==", 2), ("y", "!=", 3)], [("x", "==", 1)]])
    assert sorted(r["z"] for r in df.collect()) == ["a", "b"]
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(And(" in plan and tables.column_catalog(spark, path) == ["x", "y", "z"]


def test_dnf_helpers_do_not_change_their_input(spark):
    base = splits.segment_filter([1, 2], [0, 0], [0, 1])
    more = S.also(base, ("fold_1_marker", "==", 1))
    assert len(base[0]) == 3 and len(more[0]) == 4 and S.dnf([[]]) is None
    with pytest.raises(ValueError, match="length"):
        splits.segment_filter([1], [0, 0], [0])
    with pytest.raises(TypeError):
        splits.segment_filter([1], 0, 0)


def test_params_and_json(tmp_path):
    tables.save_params({"lr": 0.05, "metric": "auc"}, str(tmp_path / "p.yaml"))
    assert tables.load_params(str(tmp_path / "p.yaml")) == {"lr": 0.05, "metric": "auc"}
    tables.save_json(["a"], str(tmp_path / "c.json"))
    assert tables.load_json(str(tmp_path / "c.json")) == ["a"]


def test_csv_and_metrics_sinks(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, 0.5)], "y_true int, y_pred double"), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "y_true int, y_pred double").collect()[0]["y_pred"] == 0.5
    for _ in range(2):
        tables.append_metrics(spark, {"auc": 0.7}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert [r["d"] for r in tables.one_column(spark, "d", [date(2023, 1, 1)], "date").collect()] == [date(2023, 1, 1)]


def test_dictionary_codes(spark):
    a, b = spark.createDataFrame([("x",), (None,), ("z",)], "id string"), spark.createDataFrame([("y",), ("x",)], "id string")
    (a2, b2), maps = clean.encode_ids("id", a, b)
    codes = {r["value"]: r["code"] for r in maps["id"].collect()}
    assert codes == {"x": 0, "y": 1, "z": 2}
    assert sorted(r["id_code"] for r in a2.collect()) == [-1, 0, 2] and sorted(r["id_code"] for r in b2.collect()) == [0, 1]
    assert clean.drop_originals("id", a2)[0].columns == ["id_code"]


def test_codes_in_the_narrowest_type(spark):
    kinds = {}
    for n in (0, 128, 129, 32768, 32769):
        a, b = spark.range(n).select(F.col("id").cast("string").alias("x")), spark.createDataFrame([(None,), ("0",)], "x string")
        kinds[n] = [dict(df.dtypes)["x_code"] for df in clean.encode_ids("x", a, b, tight=True)[0]]
    assert kinds == {0: ["tinyint"] * 2, 128: ["tinyint"] * 2, 129: ["smallint"] * 2, 32768: ["smallint"] * 2, 32769: ["int"] * 2}


def test_keys_are_dense_and_unique(spark):
    df = clean.add_key(spark.createDataFrame([(3,), (None,), (1,)], "x int"), "k")
    assert {r["x"]: r["k"] for r in df.collect()} == {1: 0, 3: 1, None: 2}
    clean.assert_unique(df, "k")
    with pytest.raises(ValueError, match="not unique"):
        clean.assert_unique(df.union(df), "k")
    assert clean.same_values(df, df.union(df), "x") and not clean.same_values(df, df.where("k > 0"), "x")


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 126, 127, None, 1.5, 1e300, "s")], "a long, b long, c long, d long, e double, f double, g string")
    assert dict(clean.narrow(df).dtypes) == {"a": "tinyint", "b": "tinyint", "c": "smallint", "d": "bigint", "e": "float", "f": "double", "g": "string"}


def test_ratio_rounds_half_away(spark):
    df = spark.createDataFrame([(201, 400), (-201, 400), (1, 3), (1, 0)], "n long, d long")
    assert [r[0] for r in df.select(S.ratio(F.col("n"), F.col("d"))).collect()] == [0.503, -0.503, 0.333, 0.0]


def test_splits(spark):
    rows = [(i, date.fromisoformat(r), date.fromisoformat(e)) for i, (r, e) in enumerate([("2023-02-01", "2023-02-20"), ("2023-03-20", "2023-03-25"), ("2023-05-20", "2023-05-30"), ("2023-05-30", "2023-06-10"), ("2023-06-02", "2023-06-05"), ("2023-06-02", "2023-07-05")])]
    df = spark.createDataFrame(rows, "receipt_key int, Receive_date date, End_date date")
    train, test = splits.split("policy", df)
    assert {r["receipt_key"]: (r["fold_1_marker"], r["fold_3_marker"]) for r in train.collect()} == {0: (1, 1), 1: (2, 1), 2: (0, 2)}
    assert [r["receipt_key"] for r in test.collect()] == [4]
    train, _ = splits.split("roi", df)
    assert sorted(r["receipt_key"] for r in train.collect()) == [0, 1]
    assert splits.split("roi", df, cutoff=None, folds=[])[1].count() == 2
    with pytest.raises(ValueError):
        splits.split("other", df)


def test_segment_catalog(spark):
    assert len(splits.segment_triples(splits.OTHERS)) == 13
    df = spark.createDataFrame([(0, 0, 1), (0, 2, 1), (0, 1, 1), (0, 1, 0), (0, 0, 0), (2, 0, 0), (0, 0, -1)], "Price_limit_bin int, Coupon_limit_bin int, Expiry_span_bin int")
    assert [r[0] for r in df.select(splits.segment_id()).collect()] == ["seg_001", "seg_011_and_021", "seg_011_and_021", "seg_010", "seg_000", "oth_segs", None]
    for name, n in (("seg_001", 1), ("seg_011_and_021", 2), (splits.OTHERS, 1)):
        assert df.where(S.dnf(splits.named_segment(name))).count() == n


def test_fold_datasets(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, i % 2, 0, i) for i in range(12)], "receipt_key int, fold_1_marker int, label_invalid int, label_same_user_st int, label_same_user_fh int, x int")
    (train, val), = splits.folds_of(df, "label_invalid")
    assert train.columns == ["label_invalid", "x"] and train.count() == 4 and val.count() == 4
    assert splits.folds_of(df, "label_invalid", validation_only=False)[0][1].count() == 8
    with pytest.raises(ValueError):
        splits.dataset(df, "fh")


def test_class_accuracy(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.6), (1, 0.3), (0, 0.1), (0, 0.4), (0, 0.7)], "y_true int, y_pred double")
    acc = lambda k: [r["accuracy"] for r in metrics.class_accuracy(df, which=k, exact=True).collect()]
    assert acc(1) == pytest.approx([1, 2 / 3, 1 / 3]) and acc(0) == pytest.approx([1 / 3, 2 / 3, 1])
    assert [r["accuracy"] for r in metrics.class_accuracy(df.where("y_true = 0")).collect()] == [0, 0, 0]


def test_auc_weights_and_profit(spark):
    df = spark.createDataFrame([(1, 0.9, 10), (0, 0.9, 20), (1, 0.5, 30), (0, 0.1, 40)], "y_true int, y_pred double, Actual_pay_cent long")
    assert metrics.roc_auc(df).collect()[0]["auc"] == (0.5 + 1 + 0 + 1) / 4
    assert metrics.roc_auc(df.where("y_true = 1")).collect()[0]["auc"] is None
    assert {r["weight"] for r in metrics.class_weights(df, "y_true").collect()} == {2.0}
    top = metrics.top_share(df, share=0.5).collect()[0]
    assert (top["n"], top["rate"], top["profit"]) == (2, 0.5, 15)
    assert [(r["n"], r["profit"]) for r in metrics.profit_at(df).collect()] == [(3, 20), (3, 20), (2, 15)]


def test_tree_scores(spark):
    df = spark.createDataFrame([(1000, 100, 0), (1000, 9000, 1), (3000, 9000, 1), (None, 9000, -1)], "Price_limit_cent long, Coupon_amt_cent long, Expiry_span_bin int")
    raw = [r[0] for r in df.select(trees.score_column(MODEL, raw=True)).collect()]
    assert raw == [0.75, -1.0, -0.625, -1.0]


def test_trained_trees_rank_the_signal(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 10), float(i % 7), int(i % 10 > 5)) for i in range(200)], "a double, b double, y int")
    names, model = trees.train_gbt(df, "y", rounds=3)
    assert metrics.roc_auc(trees.predict_gbt(df, names, model), "y").collect()[0]["auc"] == 1.0
    trees.save_gbt(names, model, str(tmp_path / "m"))
    again = trees.predict_gbt(df, *trees.load_gbt(spark, str(tmp_path / "m")))
    assert again.select("y_pred").distinct().count() == trees.predict_gbt(df, names, model).select("y_pred").distinct().count()


def test_a_dump_of_trained_trees_scores_as_they_do(spark):
    rows = [(i, None if i % 11 == 0 else float(i % 13) / 3, None if i % 17 == 0 else i * 7 % 41 - 1, float(i % 5), int((i * 7 % 41) % 3 == 0 or i % 11 < 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, a double, bin int, b double, y int")
    kinds = {"bin": 40}
    names, model = trees.train_gbt(df.drop("i"), "y", rounds=4, step=0.3, categorical=kinds)
    text = trees.dump(names, trees.trees_of(names, model, kinds))
    assert "cat_threshold" in text and trees.dump(*trees.parse(text)) == text
    want = {r["i"]: r["y_pred"] for r in trees.predict_gbt(df, names, model, kinds).collect()}
    got = {r["i"]: r["p"] for r in df.select("i", trees.score_column(text).alias("p")).collect()}
    assert len(set(want.values())) > 4 and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_segment_report_counts_edges_twice(make):
    rows = [(1, 1, 1000, 1000, "2023-01-01", "2023-01-01", "2023-01-11", 1, 1, 0), (1, 1, 20000, None, "2023-01-01", "2023-01-01", "2023-01-02", 1, 0, 0)]
    out = diagnostics.segment_report(make.labelled(*rows)).collect()
    assert sum(r["receipts_count"] for r in out) in range(1, 9) and {r["receipts_count"] for r in out} == {0, 1}
    full = [r for r in out if r["receipts_count"]]
    assert len(full) == 1 and (full[0]["validity_pc"], full[0]["redeem_fh_pc"], full[0]["Expiry_span_upper_bin"]) == (100.0, 100.0, 10)


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(2, 1), (2, 1)], "y int, x int")
    assert diagnostics.union_by_name(a, b).collect() == [(1, 2)]
