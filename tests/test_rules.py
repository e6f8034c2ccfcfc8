"""Rule boosts and verdicts (FIXTURES.md section 3, scoring table)."""

import pytest
from pyspark.sql import functions as F

from linkrisk.functions.rules import blend, external_prob, verdict, with_rule_score

BASE = dict(is_typosquat=0, has_ip=0, brand_in_subdomain=0, tld_suspicious=0, has_at_in_url=0, num_subdomains=0,
            hostname_entropy=2.0, num_suspicious_words=0, has_https=0, min_levenshtein=5)
CASES = [
    (0.90, {}, 0.70, "Suspicious"),
    (0.90, {"has_https": 1}, 0.28, "Safe"),
    (0.80, {"has_ip": 1}, 0.80, "Dangerous"),
    (0.30, {"is_typosquat": 1, "tld_suspicious": 1}, 0.375, "Safe"),
    (0.50, {"is_typosquat": 1, "tld_suspicious": 1}, 0.65, "Suspicious"),
    (0.70, {"has_ip": 1, "brand_in_subdomain": 1, "is_typosquat": 1, "tld_suspicious": 1}, 1.00, "Dangerous"),
]


@pytest.mark.parametrize("raw,sig,score,v", CASES)
def test_rule_table(spark, raw, sig, score, v):
    row = {**BASE, **sig, "raw_score": raw}
    cols = list(row)
    df = spark.createDataFrame([tuple(row[c] for c in cols)], cols)
    r = with_rule_score(df).withColumn("verdict", verdict(F.col("score"))).first()
    assert r["score"] == pytest.approx(score, abs=1e-12)
    assert r["verdict"] == v


def test_alerts_listed(spark):
    row = {**BASE, "has_ip": 1, "num_subdomains": 4, "hostname_entropy": 4.5, "raw_score": 0.5}
    cols = list(row)
    r = with_rule_score(spark.createDataFrame([tuple(row[c] for c in cols)], cols)).first()
    assert len(r["rule_alerts"]) == 3
    assert "IP address" in r["rule_alerts"][0] and "(4)" in r["rule_alerts"][1] and "4.50" in r["rule_alerts"][2]


def test_blend_and_external(spark):
    df = spark.createDataFrame([(0.8, 0.2, "LABEL_1", 0.9), (0.8, None, "safe", 0.9)],
                               "rf_score double, other_score double, lab string, s double")
    r = blend(df).withColumn("p", external_prob(F.col("lab"), F.col("s"))).collect()
    assert r[0]["raw_score"] == pytest.approx(0.6 * 0.8 + 0.4 * 0.2)
    assert r[1]["raw_score"] == 0.8
    assert r[0]["p"] == 0.9 and r[1]["p"] == pytest.approx(0.1)


def test_round_even_matches_python_round(spark):
    """Exact half-even rounding on the binary value, like Python's round()."""
    import random

    from hypothesis import given, settings
    from hypothesis import strategies as st

    from linkrisk.functions.features import round_even
    rng = random.Random(5)
    vals = [0.98765, 0.123456, 0.00015, 0.03125, 1 / 160, 2.67455, 0.09875, 0.99995, 0.0, 4.00005, 12.34565]
    vals += [rng.randint(0, 10 ** 6) / 10 ** 5 / 2 for _ in range(300)]  # many decimal ties
    vals += [rng.random() * 10 for _ in range(300)]

    @settings(max_examples=200, deadline=None)
    @given(st.floats(min_value=0, max_value=1e6, allow_nan=False))
    def collect(x):
        vals.append(x)

    collect()
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for d in (1, 4):
        got = [r[0] for r in df.select(round_even(F.col("x"), d)).collect()]
        bad = [(v, g, round(v, d)) for v, g in zip(vals, got) if g != round(v, d)]
        assert not bad, bad[:5]
