"""Rules, hosts and shrinkage."""

from pyspark.sql import functions as F

from linkrisk.llm import reputation as R
from linkrisk.llm.queries import RULES


def judge(spark, urls, labels=()):
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(urls)], "page_id long, url string, bad int, host string")
    lab = spark.createDataFrame(list(labels), "url_key string, bad int")
    return {r.page_id: r for r in R.judge_urls(pages, lab, RULES).collect()}


def test_rules(spark):
    urls = ["https://a.example.org/es/3", "https://example.org/en/17?x", "http://EXAMPLE.org/en/27", "http://x.com/fr/1", "http://x.com/de/1#t",
            "http://com/de/", "http://xcom/de/", None, "no scheme", "https://org", "http://a.net?q=/x/", "http://b.example.org:80/es/", "u://v://w/x"]
    got = judge(spark, urls)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.example.org", "/es/3", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"),
        ("example.org", "/en/27", "org/", "allow"), ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de/1", "com/de/", "block"),
        ("com", "/de/", "com/de/", "block"), ("xcom", "/de/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("org", "", None, "allow"), ("a.net", "", None, "allow"), ("b.example.org:80", "/es/", None, "allow"), ("v:", "//w/x", None, "allow")]


def test_many_bad_pages_block_few_do_not(spark):
    urls = ([f"http://spam.a.net/{i}" for i in range(60)] + [f"http://ok.b.net/{i}" for i in range(60, 160)] +
            ["http://new.b.net/160", "http://new.b.net/x"])
    labels = [(str(i), 1) for i in range(60)] + [(str(i), int(i % 20 == 0)) for i in range(60, 160)] + [("160", 1), ("161", None), (None, 1)]
    got = judge(spark, urls, labels)
    assert {got[i].verdict for i in range(60)} == {"block"}
    assert {got[i].verdict for i in range(60, 162)} == {"allow"}
    new, ok = got[160], got[60]
    assert ok.bad_mean < new.bad_mean < 0.9  # one bad page moves a new host, but not to 1


def test_posterior_formula(spark):
    """Means between the raw share and the parent's mean, against plain Python."""
    outcomes = spark.createDataFrame([("a.x.net", 1)] * 3 + [("a.x.net", 0)] * 7 + [("b.x.net", 0)] * 10 + [("c.y.net", 1)] * 4 + [("d.y.net", None)],
                                     "host string, bad int")
    got = {r.host: r for r in R.host_reputation(outcomes).collect()}
    assert got["b.x.net"].bad_mean < got["a.x.net"].bad_mean < got["c.y.net"].bad_mean
    assert got["d.y.net"].n == 0 and 0 < got["d.y.net"].bad_mean < 1
    assert all(r.bad_lower < r.bad_mean for r in got.values())


def test_empty(spark):
    assert judge(spark, []) == {}
    assert R.domain_of(F.lit("a"), ("co.uk",)) is not None
    d = spark.range(1).select(R.domain_of(F.lit("x.y.co.uk:8"), ("co.uk",)).alias("d"), R.suffix_of(F.lit("x.y.co.uk"), ("co.uk",)).alias("s")).first()
    assert (d.d, d.s) == ("y.co.uk", "co.uk")
