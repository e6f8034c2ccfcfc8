"""Feed readers on hand-made files: missing file, bad CSV line, gzip JSON."""

import gzip
import json
import os
import tempfile

from pyspark.sql import functions as F

from linkrisk.sources import feeds


def _files():
    d = tempfile.mkdtemp(prefix="linkrisk-feeds-")
    with open(os.path.join(d, "phish.csv"), "w") as f:
        f.write("id,phish_url,status\n1,http://a.tk/login,phishing\n2,http://b.tk/x,offline\n3,http://c.ml/,phishing\n")
    with open(os.path.join(d, "lines.txt"), "w") as f:
        f.write("  http://d.xyz/verify  \nnot a url\nhttps://e.top/\n\n")
    with open(os.path.join(d, "verified.csv"), "w") as f:
        f.write("url,target\nhttp://f.cf/a,bank\nhttp://g.gq/b,bank,extra,fields\nhttp://h.ga/c,mail\n")
    with open(os.path.join(d, "ranked.csv"), "w") as f:
        f.write("1,google.com\n2,example.org\n")
    with gzip.open(os.path.join(d, "feed.json.gz"), "wt") as f:
        json.dump([{"url": "http://i.tk/", "verified": "yes", "online": "yes"},
                   {"url": "http://j.tk/", "verified": "no", "online": "yes"}], f)
    return d


def test_readers(spark):
    d = _files()
    assert sorted(r.url for r in feeds.read_phishing_csv(spark, f"{d}/phish.csv").collect()) == [
        "http://a.tk/login", "http://c.ml/"]
    assert sorted(r.url for r in feeds.read_url_lines(spark, f"{d}/lines.txt").collect()) == [
        "http://d.xyz/verify", "https://e.top/"]
    assert sorted(r.url for r in feeds.read_verified_csv(spark, f"{d}/verified.csv").collect()) == [
        "http://f.cf/a", "http://h.ga/c"]
    assert sorted(r.url for r in feeds.read_ranked_domains(spark, f"{d}/ranked.csv").collect()) == [
        "https://example.org", "https://google.com"]
    j = feeds.read_feed_json(spark, f"{d}/feed.json.gz", with_label=True).collect()
    assert [(r.url, r.label) for r in j] == [("http://i.tk/", 1)]


def test_read_all_skips_missing(spark):
    d = _files()
    curated = spark.createDataFrame([("https://docs.python.org/3/",), ("https://docs.python.org/3/",)], "url string")
    p, lg, counts = feeds.read_all(spark, [("phishing_csv", f"{d}/phish.csv"), ("url_lines", f"{d}/missing.txt"),
                                           ("feed_json", f"{d}/feed.json.gz"), ("ranked_domains", f"{d}/ranked.csv")],
                                   extra_legit=curated)
    assert p.count() == 3 and lg.count() == 3
    c = {r.source.split(":")[0]: r.n for r in counts.collect()}
    assert c == {"phishing_csv": 2, "feed_json": 1, "ranked_domains": 2, "curated_legit": 2}


def test_write_table_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="linkrisk-sink-")
    df = spark.createDataFrame([("http://a", 1), ("http://b", 0)], "url string, label int")
    feeds.write_table(df, f"{d}/ds", fmt="parquet")
    feeds.write_table(df, f"{d}/csv", fmt="csv")
    assert spark.read.parquet(f"{d}/ds").count() == 2
    assert spark.read.option("header", True).csv(f"{d}/csv").filter(F.col("label") == "1").count() == 1


def test_split_feed_reader(spark):
    """Arrays in any layout, read in records; a nested record fails the read."""
    import pytest
    d = tempfile.mkdtemp(prefix="linkrisk-split-")
    rows = [{"url": f"http://h{i}.tk/a?b=[{i}],x", "verified": "yes" if i % 3 else "no", "online": "yes" if i % 4 else "no"} for i in range(200)]
    for name, indent in (("flat", None), ("pretty", 2)):
        with open(os.path.join(d, name + ".json"), "w") as f:
            json.dump(rows, f, indent=indent)
    want = sorted(r["url"] for r in rows if r["verified"] == r["online"] == "yes")
    for name in ("flat", "pretty"):
        path = os.path.join(d, name + ".json")
        assert sorted(r.url for r in feeds.read_feed_json_split(spark, path).collect()) == want
        assert sorted(r.url for r in feeds.read_feed_json(spark, path).collect()) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = feeds.read_feed_json_split(spark, os.path.join(d, "flat.json"))
        assert df.rdd.getNumPartitions() > 3 and sorted(r.url for r in df.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(os.path.join(d, "nested.json"), "w") as f:
        json.dump([{"url": "http://a.tk/", "verified": "yes", "online": "yes", "details": [{"ip": "1.2.3.4"}]}], f)
    with pytest.raises(Exception, match="no flat JSON object"):
        feeds.read_feed_json_split(spark, os.path.join(d, "nested.json")).collect()


def test_error_reason_text_prints_as_python(spark):
    from linkrisk.operators.explain import error_reasons
    values = [0.1235, -0.0625, 0.0005, 1.0015, 2.5, -0.0015]
    df = spark.createDataFrame([(v, 0.0) for v in values], "phi_a double, phi_b double")
    got = [r["top_shap_reasons"] for r in error_reasons(df, ["a", "b"], k=1).collect()]
    assert got == [f"a({round(v, 4):+.3f})" for v in values]


def test_sources_are_counted_in_the_reading_pass(spark):
    d = _files()
    sources = [("phishing_csv", f"{d}/phish.csv"), ("url_lines", f"{d}/lines.txt"), ("ranked_domains", f"{d}/ranked.csv"), ("feed_json", f"{d}/none.json")]
    phish, legit, seen = feeds.read_all_observed(spark, sources)
    phish.unionByName(legit).write.mode("overwrite").parquet(os.path.join(d, "out"))
    assert {k.split(":")[0]: v.get["n"] for k, v in seen.items()} == {"phishing_csv": 2, "url_lines": 2, "ranked_domains": 2}
    assert spark.read.parquet(os.path.join(d, "out")).count() == 6
