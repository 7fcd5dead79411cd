"""The whole way from CSV to data sets and metrics, through the path-to-path stages."""

from datetime import date

from voucherflow import api


def test_end_to_end(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "t.csv").write_text("User_id,Shop_id,Order_id,Coupon_id,Coupon_type,Biz_code,Pay_date,Actual_pay,Reduce_amount\nu1,s1,o1,c1,1,A,2023-02-03,25.00,1.00\nu1,s1,o2,,1,A,2023-02-04,12.5,0\nu1,s1,o2,,1,A,2023-02-04,12.5,0\nu3,s2,o3,c2,2,B,2023-06-03,9.99,0.5\n")
    (tmp_path / "r.csv").write_text("User_id,Coupon_id,Coupon_status,Coupon_amt,Receive_date,Start_date,End_date,Price_limit\nu1,c1,2,1.00,2023-02-01,2023-02-01,2023-02-28,10\nu2,c2,1,5,2023-06-02,2023-06-01,2023-06-10,20\nu3,c2,2,5,2023-06-02,2023-06-01,2023-06-10,20\n")
    (tmp_path / "v.csv").write_text("User_id,Visit_date\nu1,2023-01-31\nu3,2023-06-01\n")
    t, r, v = api.load_transactions_csv(p("t.csv"), spark=spark), api.load_receipts_csv(p("r.csv"), spark=spark), api.load_users_logins_csv(p("v.csv"), spark=spark)
    t, r, v = api.drop_duplicate_rows(t, r, v)
    (t, r, v), maps = api.id_reassign_with_map("User_id", t, r, v)
    (t,), _ = api.id_reassign_with_map(["Shop_id", "Order_id"], t)
    (t, r), _ = api.id_reassign_with_map("Coupon_id", t, r)
    t, r, v = api.drop_original_id(["User_id", "Shop_id", "Order_id", "Coupon_id"], t, r, v)
    assert maps["User_id"].count() == 3
    t, r = api.add_keys(api.reduce_mem_usage(t), r)
    done = api.impute_missing_coupon_ids(t, r, p("txns"), p("receipts"))
    assert done.where("coupon_id_imputed = 1").count() == 1
    api.save_df2pq(v, p("visits"))
    api.add_txn_level_flags(p("receipts"), p("txns"), p("flagged"), spark=spark)
    assert api.load_df_from_pq(p("flagged"), ["txn_key"], [("flag_missing_info", "==", 0)], spark=spark).count() == 3
    api.build_labels(p("receipts"), p("txns"), p("labels"), spark=spark)
    lab = {x["Price_limit_cent"]: x for x in api.load_df_from_pq(p("labels"), spark=spark).where("User_id_code <> 1").collect()}
    assert lab[1000]["same_user_valid_txn_count"] == 2 and lab[1000]["label_valid"] == 1
    assert len(api.diag_on_receipts(p("labels"), [1000, 10000], [1000, 10000], [10], spark=spark)) >= 2
    api.coupon_features(p("labels"), p("cf"), spark=spark)
    api.user_features(p("labels"), p("txns"), p("visits"), p("uf"), spark=spark)
    api.features_combining(p("cf"), p("uf"), p("trainable"), spark=spark)
    api.ROI_model_split(p("trainable"), p("roi_train"), p("roi_test"), spark=spark)
    api.policy_model_split(p("trainable"), p("pol_train"), p("pol_test"), test_start_at=date(2023, 6, 1), spark=spark)
    train1, *_, val3 = api.load_ROI_training_3folds_data(p("roi_train"), "st", spark=spark)
    assert train1.count() == 1 and val3.count() == 0 and "receipt_key" not in train1.columns
    assert api.load_policy_training_3folds_data(p("pol_train"), spark=spark)[0].count() == 1
    assert api.load_policy_test_data(p("pol_test"), spark=spark).count() == 2
    x, y = api.get_ROI_X_y_data(api.load_ROI_test_data(p("roi_test"), spark=spark), "st")
    assert y.columns == ["label_same_user_st"] and "label_invalid" not in x.columns
    assert api.load_policy_certain_segment_data(p("pol_train"), 0, 0, 1, spark=spark).count() == 1
    scored = spark.createDataFrame([(1, 0.9, 100), (0, 0.2, 0)], "y_true int, y_pred double, Actual_pay_cent long")
    assert api.metric_individual_class_accuracy(scored) == [1.0, 1.0, 1.0]
    assert api.metric_business_top5profit(scored) == (1.0, 100.0) and api.metric_business_profit_at_diff_thrshld(scored) == [100.0] * 3
    assert {z["weight"] for z in api.add_vanilla_weights(scored, "y_true").collect()} == {2.0}
