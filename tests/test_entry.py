"""Driver contract: entry, registry and a DuckDB oracle spot check."""

import duckdb

import __spark_entry__ as E
from tools.check_oracle import _rows
from linkrisk.session import TABLES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r.verdict for r in rows} <= {"Safe", "Suspicious", "Dangerous"} and sum(r.n for r in rows) > 0


def test_registry_keys():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    survey = """url_parts url_char_counts path_features query_features host_features suspicious_words
    min_brand_distance typosquat host_entropy url_entropy tld_flags brand_in_subdomain brand_impersonation path_depth
    feature_report flagged_features merge_feeds balance_cap class_stats length_histogram top_tlds feature_label_corr
    stratified_split kfold_assign scaler_stats confusion binary_metrics class_report roc_points roc_auc
    threshold_sweep cost_threshold model_select error_samples score_blend external_label_prob rule_score rule_alerts
    verdicts result_rows history timeline scan_lookup dashboard phishing_scan_count campaign_scans assign_update
    campaign_cards json_features nearest_centroid silhouette radius_neighbours campaign_sizes linear_shap
    linear_top_reasons train_compare rf_verdicts kmeans_campaigns choose_k dbscan_compare pca_2d tree_shap
    shap_importance error_table stream_scores stream_recluster""".split()
    assert not [k for k in survey if k not in qs]


def test_oracle_spot_check(spark):
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["verdicts", "page_features", "threshold_sweep", "campaign_scans", "stratified_split"]:
        s = qs[name](spark, SF).toPandas()
        d = con.execute(sql[name]).df()
        assert _rows(s) == _rows(d), name
