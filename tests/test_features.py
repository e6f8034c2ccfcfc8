"""URL features: golden values (FIXTURES.md section 3) and a stdlib cross-check."""

from urllib.parse import urlparse

import pytest

from linkrisk.constants import ALL_FEATURE_COLS, BRAND_NAMES
from linkrisk.functions.features import with_all_features, with_url_features

GOLDEN = [
    ("http://192.168.0.1/login", dict(has_ip=1, url_length=24, num_dots=3, num_digits_in_domain=8, num_subdomains=2,
                                      num_suspicious_words=1, min_levenshtein=3, is_typosquat=0)),
    ("https://www.google.com", dict(has_ip=0)),
    ("https://example.com", dict(has_https=1, tld_suspicious=0)),
    ("http://example.com", dict(has_https=0)),
    ("http://secure-login.com/verify", dict(num_suspicious_words=1)),
    ("http://user@evil.com", dict(has_at_in_url=1)),
    ("http://safe.com/page", dict(has_at_in_url=0)),
    ("http://a.b.c.evil.com/page", dict(num_subdomains=3)),
    ("http://evil.xyz/page", dict(tld_suspicious=1)),
    ("https://support.apple.com", dict(num_suspicious_words=0)),
    ("https://google.com", dict(num_slashes=1, min_levenshtein=0, is_typosquat=0)),
    ("https://paypal-verify.com", dict(is_typosquat=1, min_levenshtein=0)),
    ("https://google.de", dict(brand_impersonation=0)),
    ("https://paypal.co.uk", dict(brand_impersonation=0)),
    ("http://paypal-verify.xyz/account/update?id=12345",
     dict(num_suspicious_words=2, num_digits_in_path=5, num_params=1, query_length=8, path_length=15, num_slashes=2,
          path_depth=2, tld_suspicious=1, is_typosquat=1, brand_impersonation=1)),
    ("https://stackoverflow.com/questions/11227809", dict(last_path_segment_is_integer=1, num_digits_in_path=8,
                                                          path_depth=2)),
    ("http://x.com/log?in=1", dict(num_suspicious_words=1)),
    ("https://us.example.com", dict(min_levenshtein=1, is_typosquat=1)),
    ("paypal.com/a/b", dict(num_slashes=2, has_https=0, min_levenshtein=0, path_depth=3, brand_impersonation=0)),
    ("evil.com/?u=http://x", dict(hostname_length=0, min_levenshtein=99, is_typosquat=0, num_slashes=1)),
    ("http://a.b./", dict(num_subdomains=1, tld_suspicious=0)),
    ("http://x.com:80/", dict(has_port=1)),
    ("http://x.com:0/", dict(has_port=0)),
    ("http://x.com:abc/", dict(has_port=0, parse_error=True)),
    ("http://x.com:99999/", dict(has_port=0, parse_error=True)),
    ("http://h/A;p=1/b;q=2?z#f", dict(path_length=8, query_length=1)),
    ("http://[::1]:8080/a", dict(has_ip=1, has_port=1, num_subdomains=0, hostname_length=3)),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, u) for i, (u, _) in enumerate(GOLDEN)] + [(len(GOLDEN), "http://[bad/a"), (len(GOLDEN) + 1, None)]
    df = spark.createDataFrame(rows, "id int, url string")
    return {r["id"]: r.asDict() for r in with_all_features(df).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(golden, i):
    url, want = GOLDEN[i]
    got = golden[i]
    for k, v in want.items():
        assert got[k] == v, (url, k, got[k], v)


def test_bad_bracket_and_null_give_29_zeros(golden):
    from linkrisk.constants import BASE_FEATURE_COLS
    for i in (len(GOLDEN), len(GOLDEN) + 1):
        r = golden[i]
        assert all(r[c] == 0 for c in BASE_FEATURE_COLS), r
        assert r["parse_error"] is True
    assert golden[len(GOLDEN)]["url_entropy"] > 0  # extras still computed for a bad bracket


def test_brand_list_size():
    assert len(BRAND_NAMES) == 32 and len(set(BRAND_NAMES)) == 32


def test_all_32_columns(golden):
    assert all(c in golden[0] for c in ALL_FEATURE_COLS)


def _stdlib(url: str) -> dict:
    p = urlparse(url if "://" in url else "http://" + url)
    path = p.path
    host = p.hostname or ""
    return {
        "url_length": len(url), "hostname_length": len(host), "path_length": len(path),
        "query_length": len(p.query), "num_params": len(p.query.split("&")) if p.query else 0,
        "has_https": int(p.scheme == "https"), "num_subdomains": max(len(host.split(".")) - 2, 0),
        "has_port": int(bool(p.port)), "double_slash": int("//" in path),
        "num_digits_in_domain": sum(ch.isdigit() for ch in host),
    }


def test_pages_match_stdlib_splitter(spark):
    from linkrisk.plans.fixtures import page_urls, url_corpus
    pages = page_urls(spark, "/root/testdata/sf0.001")
    corpus = url_corpus(spark, "/root/testdata/sf0.001").select("url").distinct().limit(400)
    rows = with_url_features(pages.select("url").unionByName(corpus)).collect()
    assert len(rows) > 100
    for r in rows:
        want = _stdlib(r["url"])
        for k, v in want.items():
            assert r[k] == v, (r["url"], k, r[k], v)


def test_unicode_digits_follow_isdigit(spark):
    urls = ["http://a²b③.com/x٣¹/²³", "http://h.com/12⁰"]
    rows = with_url_features(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    for u, r in zip(urls, rows):
        p = urlparse(u)
        host, seg = p.hostname or "", [s for s in p.path.split("/") if s]
        assert r["num_digits_in_domain"] == sum(c.isdigit() for c in host)
        assert r["num_digits_in_path"] == sum(c.isdigit() for c in p.path + p.query)
        assert r["last_path_segment_is_integer"] == int(bool(seg) and seg[-1].isdigit())


def test_bracketed_hosts_like_stdlib(spark):
    """A bracketed host is valid exactly when the stdlib splitter accepts it."""
    from urllib.parse import urlsplit
    hosts = ["::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1.2.3.4", "1::2::3", "g::1",
             "::1.2.3.04", "v1.x", "v.x", "bad", "1:2:3:4:5:6:7", "A:B::C"]
    urls = [f"http://[{h}]:80/p" for h in hosts] + ["http://x[::1]/", "http://[::1]x/", "http://[::1/"]
    rows = with_url_features(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    for u, r in zip(urls, rows):
        try:
            urlsplit(u)
            ok = True
        except ValueError:
            ok = False
        assert r["parse_error"] == (not ok), u


def test_generated_methods_of_the_feature_stage_are_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes, which made this stage slow."""
    import __spark_entry__ as entry
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("min_brand_distance", "rule_score", "result_rows", "blended_result_rows", "verdicts"):
            stages = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
            assert max(sizes) <= 8000, (name, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
