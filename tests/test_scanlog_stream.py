"""Scan log operators and stream = batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import scanlog as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scans(spark):
    rows = [(i, f"http://x{i}.tk/", "Dangerous" if i % 3 == 0 else ("Suspicious" if i % 3 == 1 else "Safe"),
             0.5, f"campaign_00{i % 2}" if i % 3 != 2 else None, '{"has_ip": 1}' if i % 4 else "not json")
            for i in range(1, 61)]
    return spark.createDataFrame(rows, "scan_id long, url string, verdict string, score double, "
                                       "campaign_id string, features_json string")


def test_history_clamp(scans):
    assert L.clamp_limit(0) == 1 and L.clamp_limit(10_000) == 500 and L.clamp_limit(None) == 50
    assert [r.scan_id for r in L.history(scans, 3).collect()] == [60, 59, 58]


def test_dashboard(scans):
    r = L.dashboard(scans).first()
    assert (r.total_scans, r.dangerous, r.suspicious, r.safe) == (60, 20, 20, 20)


def test_features_decode_and_campaigns(scans, spark):
    p = L.phishing_scans_with_features(scans)
    assert p.count() == 30  # 40 phishing scans, 10 with a malformed payload
    camps = spark.createDataFrame([("campaign_000",), ("campaign_001",), ("campaign_009",)], "name string")
    c = {r.name: (r.n_scans, list(r.first_ids), r.more) for r in L.campaign_scans(camps, scans).collect()}
    assert c["campaign_009"] == (0, [], 0)
    assert c["campaign_000"][0] == 20 and c["campaign_000"][1] == [4, 6, 10, 12, 16] and c["campaign_000"][2] == 15


def test_update_assignments(scans, spark):
    a = spark.createDataFrame([(1, "campaign_042")], "scan_id long, campaign_id string")
    u = {r.scan_id: r.campaign_id for r in L.update_assignments(scans, a).collect()}
    assert u[1] == "campaign_042" and u[3] == "campaign_001" and u[2] is None


def test_append_and_lookup(scans):
    d = tempfile.mkdtemp(prefix="linkrisk-log-")
    L.append_scans(scans, os.path.join(d, "log"))
    L.append_scans(scans.limit(2), os.path.join(d, "log"))
    log = scans.sparkSession.read.parquet(os.path.join(d, "log"))
    assert log.count() == 62
    assert L.scan_lookup(log, 7).count() == 1


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    s = qs["stream_scores"](spark, SF)
    b = qs["rule_score"](spark, SF)
    assert s.count() == b.count()
    diff = s.select("url_id", "url", "score").exceptAll(b.select("url_id", "url", "score"))
    assert diff.count() == 0
    lv = {r.verdict: r.n for r in qs["live_verdicts"](spark, SF).collect()}
    bv = {r.verdict: r.n for r in qs["verdicts"](spark, SF).collect()}
    assert lv == bv


def _log_and_campaigns(spark, name):
    import uuid

    from linkrisk.streaming.stream import stream_dir
    base = stream_dir(spark, f"test-{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "log"), os.path.join(base, "camp"), os.path.join(base, "ckpt")


def test_stream_log_holds_every_scan_once_with_its_campaign(spark):
    """J2 + J3 + C2: every scored row is in the log; campaigns cover all risky scans."""
    from linkrisk.plans.stream_queries import _scored_stream
    from linkrisk.streaming import upkeep as U
    from linkrisk.streaming.stream import run_scan_stream
    log_path, camp_path, ckpt = _log_and_campaigns(spark, "log")
    run_scan_stream(_scored_stream(spark, SF), log_path, ckpt, campaign_dir=camp_path).awaitTermination()
    log = spark.read.parquet(log_path)
    assert log.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert log.select("scan_id").distinct().count() == log.count()
    scans = U.scans_with_campaigns(log, camp_path)
    assert scans.filter((F.col("verdict") != "Safe") != F.col("campaign_id").isNotNull()).isEmpty()
    sizes = {r["name"]: r["size"] for r in U.campaigns(spark, camp_path).collect()}
    found = {r["campaign_id"]: r["n"] for r in scans.filter("campaign_id is not null").groupBy("campaign_id").agg(
        F.count("*").alias("n")).collect()}
    assert sizes == found and 2 <= len(sizes) <= 10
    assert sorted(sizes.values(), reverse=True) == [sizes[k] for k in sorted(sizes)]  # numbered by size


@pytest.fixture(scope="module")
def scan_batches(spark):
    """Three micro-batches of scans around three feature patterns, with a few safe ones."""
    import random

    from linkrisk.constants import FEATURE_COLS
    r = random.Random(5)
    centres = [[r.randint(0, 20) for _ in FEATURE_COLS] for _ in range(3)]
    out = []
    for b in range(3):
        rows = []
        for i in range(150):
            c = r.randrange(3)
            v = [float(x + r.random()) for x in centres[c]]
            rows.append((b * 1000 + i, "Safe" if i % 10 == 0 else "Dangerous", c, *v))
        out.append(spark.createDataFrame(rows, "scan_id long, verdict string, truth int, " + ", ".join(f"{x} double" for x in FEATURE_COLS)))
    return out


def _feed(upkeep, batch, version):
    rep = upkeep.represent(batch.filter("verdict != 'Safe'"), version).cache()
    k = upkeep.update(rep, version)
    return rep, k


def test_coreset_updates_campaigns_of_old_scans_and_merges(spark, scan_batches):
    """After each batch all scans, old ones too, have campaigns of one clustering; the
    coreset stays below its bound while its sums stay those of all scans."""
    from linkrisk.constants import FEATURE_COLS
    from linkrisk.streaming import upkeep as U
    _, folder, _ = _log_and_campaigns(spark, "coreset")
    upkeep = U.CampaignUpkeep(folder, min_samples=50, per_batch=16, most=24)
    log = None
    for version, batch in enumerate(scan_batches):
        rep, k = _feed(upkeep, batch, version)
        log = rep if log is None else log.unionByName(rep)
        scans = U.scans_with_campaigns(log, folder)
        assert scans.count() == log.count() and scans.filter("campaign_id is null").isEmpty()
        assert k == 3
        both = {(r["truth"], r["campaign_id"]) for r in scans.select("truth", "campaign_id").distinct().collect()}
        assert len(both) == 3
        coreset = U.read_version(spark, folder, "coreset", version)
        assert coreset.count() <= 24
        total, exact = coreset.agg(F.sum("n")).first()[0], log.count()
        assert total == exact
    mean, std, _ = U.scaler_of(U.read_version(spark, folder, "coreset", 2))
    want = log.agg(*[F.avg(c) for c in FEATURE_COLS], *[F.stddev_pop(c) for c in FEATURE_COLS]).first()
    assert mean + std == pytest.approx(list(want), rel=1e-6)


def test_replayed_batch_gives_the_same_version(spark, scan_batches):
    from linkrisk.streaming import upkeep as U
    _, folder, _ = _log_and_campaigns(spark, "replay")
    upkeep = U.CampaignUpkeep(folder, min_samples=50, per_batch=16, most=24)
    read = lambda: sorted(map(tuple, U.read_version(spark, folder, "map", 1).collect()))
    _feed(upkeep, scan_batches[0], 0)
    first, _ = _feed(upkeep, scan_batches[1], 1)
    ids, named = sorted(map(tuple, first.select("scan_id", "rep_id").collect())), read()
    again, _ = _feed(upkeep, scan_batches[1], 1)
    assert sorted(map(tuple, again.select("scan_id", "rep_id").collect())) == ids and read() == named
    assert U.latest_version(spark, folder) == 1 and U.latest_version(spark, folder, 1) == 0


def test_few_or_no_scans_publish_no_campaign(spark, scan_batches):
    from linkrisk.streaming import upkeep as U
    _, folder, _ = _log_and_campaigns(spark, "few")
    upkeep = U.CampaignUpkeep(folder, min_samples=50)
    assert U.campaigns(spark, folder).isEmpty()
    _, k = _feed(upkeep, scan_batches[0].limit(0), 0)
    assert k is None and U.campaigns(spark, folder).isEmpty()
    rep, k = _feed(upkeep, scan_batches[0].limit(30), 1)
    assert k is None and U.scans_with_campaigns(rep, folder).filter("campaign_id is not null").isEmpty()


def test_replayed_stream_batch_replaces_its_rows(spark):
    """A batch written twice is in the log once, with its new rows."""
    from linkrisk.operators.scanlog import write_batch
    log_path, _, _ = _log_and_campaigns(spark, "twice")
    one = spark.createDataFrame([(1, "Safe", 0.11111, 0), (2, "Dangerous", 0.9, 0)], "scan_id long, verdict string, score double, batch long")
    two = spark.createDataFrame([(3, "Safe", 0.2, 1)], one.schema)
    for df in (one, two, one):
        write_batch(df, log_path)
    assert sorted((r["scan_id"], r["score"]) for r in spark.read.parquet(log_path).collect()) == [(1, 0.1111), (2, 0.9), (3, 0.2)]


def _small_model(spark, name):
    """A bundle of a small model on the URL corpus, saved and loaded."""
    from linkrisk.constants import FEATURE_COLS
    from linkrisk.operators import kmeans as K
    from linkrisk.operators import models as Mo
    from linkrisk.operators.bundle import ModelBundle
    from linkrisk.operators.campaigns import as_array
    from linkrisk.plans.dataset_queries import merged_features
    from linkrisk.session import cut_lineage
    f = cut_lineage(merged_features(spark, SF))
    sc = cut_lineage(Mo.fit_scaler(f))
    z = Mo.scale_columns(f, sc)
    est = Mo.estimators(f.count(), fast=True)[name]
    model = est.fit(Mo.with_class_weights(Mo.assemble(z)))
    risky = f.filter("label = 1")
    csc = cut_lineage(Mo.fit_scaler(risky))
    pts = as_array(Mo.scale_columns(risky, csc), FEATURE_COLS)
    path = os.path.join(tempfile.mkdtemp(prefix="linkrisk-bundle-"), "b")
    bundle = ModelBundle.of(name, model, sc, K.by_size(K.choose_k(pts, [3])[2]), csc)
    bundle.save(path)
    bundle.save(path)  # overwrite
    return bundle, ModelBundle.load(spark, path), f, z, model


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting", "logistic_regression"])
def test_saved_bundle_scores_as_the_training_code(spark, name):
    from linkrisk.constants import FEATURE_COLS
    from linkrisk.operators import models as Mo
    bundle, loaded, f, z, model = _small_model(spark, name)
    assert loaded.family == name and loaded.centroids == bundle.centroids
    a = loaded.with_score(f)
    assert set(FEATURE_COLS) <= set(a.columns) and a.select(*FEATURE_COLS).exceptAll(f.select(*FEATURE_COLS)).isEmpty()
    b = Mo.score(Mo.assemble(z), model, "want", "p").select("url", "want", "p")
    err = a.join(b, "url").agg(F.max(F.abs(F.col("rf_score") - F.col("want"))), F.max(F.abs(F.col("pred") - F.col("p"))), F.count("*")).first()
    assert err[0] < 1e-12 and err[1] == 0 and err[2] == f.count()


def test_rules_read_raw_features_when_a_model_scores(spark):
    """With a scaling model, rules and alerts are those of the raw features; the score is the
    blend of both scores where a second one is given."""
    from linkrisk.functions.features import with_url_features
    from linkrisk.functions.rules import with_rule_score
    from linkrisk.streaming.stream import score_stream
    _, bundle, _, _, _ = _small_model(spark, "random_forest")
    urls = spark.createDataFrame([("https://www.google.com/search?q=1", None), ("https://github.com/a", 0.25), ("http://192.168.0.1/login", 0.75)],
                                 "url string, other_score double")
    got = {r["url"]: r for r in score_stream(urls, bundle=bundle, reasons=5).collect()}
    assert got["https://www.google.com/search?q=1"]["rule_alerts"] == [] and got["https://github.com/a"]["rule_alerts"] == []
    for r in got.values():
        want = r["rf_score"] if r["other_score"] is None else 0.6 * r["rf_score"] + 0.4 * r["other_score"]
        assert r["raw_score"] == pytest.approx(want, abs=1e-15)
        assert len(r["reasons"]) == 5 and (r["campaign_id"] is not None) == (r["verdict"] != "Safe")
    plain = with_url_features(spark.createDataFrame([(r["url"], r["raw_score"]) for r in got.values()], "url string, raw_score double"))
    for r in with_rule_score(plain).collect():
        assert got[r["url"]]["score"] == r["score"] and got[r["url"]]["rule_alerts"] == r["rule_alerts"]
    assert got["http://192.168.0.1/login"]["has_ip"] == 1


def test_append_rounds_scores_and_partitions_by_verdict(spark):
    d = tempfile.mkdtemp(prefix="linkrisk-log2-")
    df = spark.createDataFrame([(1, "Safe", 0.123456, 0.00015), (2, "Dangerous", 0.98765, 0.5)],
                               "scan_id long, verdict string, score double, raw_score double")
    L.append_scans(df, os.path.join(d, "log"))
    assert sorted(os.listdir(os.path.join(d, "log")))[:2] == ["_SUCCESS", "verdict=Dangerous"] or \
        "verdict=Safe" in os.listdir(os.path.join(d, "log"))
    r = {x.scan_id: x for x in spark.read.parquet(os.path.join(d, "log")).collect()}
    # same as Python round(x, 4) on the binary value (0.98765 -> 0.9876, 0.00015 -> 0.0001)
    assert (r[1].score, r[1].raw_score, r[2].score) == (round(0.123456, 4), round(0.00015, 4), round(0.98765, 4))


def test_model_save_load_roundtrip(spark):
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from linkrisk.operators.models import save_model
    df = spark.createDataFrame([(float(i % 7), int(i % 7 > 3)) for i in range(200)], "a double, label int")
    v = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    m = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(v)
    path = os.path.join(tempfile.mkdtemp(prefix="linkrisk-model-"), "rf")
    save_model(m, path)
    save_model(m, path)  # overwrite
    m2 = RandomForestClassificationModel.load(path)
    a = [r.prediction for r in m.transform(v).collect()]
    b = [r.prediction for r in m2.transform(v).collect()]
    assert a == b


def test_campaign_members_newest_first(spark):
    scans = spark.createDataFrame([(i, f"2024-01-0{1 + i % 5} 00:00:00", f"campaign_00{i % 2}") for i in range(12)],
                                  "scan_id long, scanned_at string, campaign_id string").withColumn("scanned_at", F.col("scanned_at").cast("timestamp"))
    camps = spark.createDataFrame([("campaign_000",), ("campaign_001",), ("campaign_007",)], "name string")
    got = [(r["campaign"], r["scan_id"]) for r in L.campaign_members(camps, scans).collect()]
    assert got == [("campaign_000", i) for i in (10, 8, 6, 4, 2, 0)] + [("campaign_001", i) for i in (11, 9, 7, 5, 3, 1)] + [("campaign_007", None)]


def test_sorted_log_prunes_row_groups(spark):
    """A point lookup in the sorted log reads the one file whose id range holds it."""
    path = os.path.join(tempfile.mkdtemp(prefix="linkrisk-sorted-"), "log")
    scans = spark.range(40000).selectExpr("id * 7919 % 40000 AS scan_id", "concat('campaign_', id % 9) AS campaign_id")
    L.write_sorted_log(scans, path, 8)
    hit = L.scan_lookup(spark.read.parquet(path), 12345)
    assert hit.count() == 1
    df = L.scan_lookup(spark.read.parquet(path), 12345)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    read = leaf.metrics().get("numOutputRows").get().value()
    assert read < 40000 / 4


def test_windows_count_late_rows_and_drop_those_behind_the_watermark(spark):
    """Rows up to the delay late are counted; a row whose window the watermark has closed is not."""
    import uuid

    from linkrisk.streaming.stream import stream_dir
    from linkrisk.streaming.windows import closed_windows, windowed_verdicts
    base = stream_dir(spark, f"test-windows-{uuid.uuid4().hex}")
    batches = [[("2024-01-01 10:05", "Safe"), ("2024-01-01 10:30", "Dangerous")],
               [("2024-01-01 13:00", "Safe"), ("2024-01-01 10:59", "Safe")],        # 10:59 is late, its window still open
               [("2024-01-01 12:10", "Safe")],                                       # the watermark is 11:00 now
               [("2024-01-01 18:00", "Safe"), ("2024-01-01 10:10", "Dangerous")]]   # 10:10 comes after its window went out
    frame = lambda rows: spark.createDataFrame([(t, v, 0.5) for t, v in rows], "t string, verdict string, score double").select(
        F.to_timestamp("t").alias("scanned_at"), "verdict", "score")
    for rows in batches:
        frame(rows).coalesce(1).write.mode("append").parquet(os.path.join(base, "in"))
    scans = spark.readStream.schema(frame(batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "in"))
    q = (windowed_verdicts(scans, "1 hour", "2 hours").writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "out"))
    text = F.date_format("window_start", "HH:mm")
    got = {(r[0], r["verdict"], r["n"]) for r in out.select(text, "verdict", "n").collect()}
    assert got == {("10:00", "Safe", 2), ("10:00", "Dangerous", 1), ("12:00", "Safe", 1), ("13:00", "Safe", 1)}
    kept = frame([r for b in batches for r in b if r != ("2024-01-01 10:10", "Dangerous")])
    batch = windowed_verdicts(closed_windows(kept, "1 hour", "2 hours"))
    assert {(r[0], r["verdict"], r["n"]) for r in batch.select(text, "verdict", "n").collect()} == got


def test_unreadable_payloads_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, '{"a": 1'), (2, ""), (3, None), (4, "not json"), (5, '{"a": 2}')], "scan_id long, features_json string")
    assert {r["scan_id"]: dict(r["features"]) for r in L.decode_features(df).collect()} == {1: {}, 2: {}, 3: {}, 4: {}, 5: {"a": 2.0}}
