"""Physical-plan properties that matter at scale."""

from linkrisk.functions.features import with_all_features, with_url_features
from linkrisk.session import read_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_stage_adds_no_shuffle_and_prunes_columns(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        li = read_table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "url")
        p = _plan(with_url_features(li))
        assert "Exchange" not in p
        assert "html" not in p  # the unused page body is never read (column pruning)
        q = _plan(with_all_features(li))
        assert "SortMergeJoin" not in q and "BroadcastHashJoin" in q  # suffix lookups are broadcast
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_n_and_group_limit(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        import __spark_entry__ as E
        qs = E.queries()
        assert "TakeOrderedAndProject" in _plan(qs["history"](spark, "/root/testdata/sf0.001"))
        assert "WindowGroupLimit" in _plan(qs["campaign_scans"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
