"""Base rules against Python's re; added spans; edge cases."""

import hashlib
import re

from linkrisk.llm import pii as P
from pyspark.sql import functions as F

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn(d),
            "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def card(prefix):
    return next(prefix + str(c) for c in range(10) if luhn(prefix + str(c)))


def texts(rng):
    parts = ["a.b@c.de", "x@y", "@z.de", "p_q%r@s-t.u.v_w@k.lm", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "0010.020.3.004", card("411111111111111"),
             "4111 1111 1111 1112", "4111-1111-1111-1111", "1" * 40, "+1 (017) 555-7713", "+1234567", "+49 30 1234567 99", "+1 2 3) ", "é🙂ñ", "\n", "word", ".", "-", " ", "12", "9" * 3000]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(0, 12))) for _ in range(250)]
    return out + [None, "", "no data", "1.2.3.4" * 50, "a@b.c " * 300, "x" * 50_000, "7" * 20_000]


def test_base_matches_re(spark, rng):
    ts = texts(rng)
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(ts)], "doc_id long, text string, row int, spans string")
    got = {r.doc_id: r for r in P.find_pii(df).select("doc_id", P.span_text(F.col("base")).alias("base"), "added", F.col("base").alias("b")).collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        assert got[i].base == ",".join(brute(t)), (t, got[i].base)
    for r in got.values():  # added spans touch no base span and no other added span
        spans = [*r.b, *r.added]
        assert all(a is b or a.end <= b.start or b.end <= a.start for a in r.added for b in spans)


def test_trees_recover_swallowed_numbers(spark):
    good, bad = [card(f"4{i:014d}") for i in range(100, 400)], [card(f"4{i:014d}")[:-1] + "x" for i in range(5)]
    rows = [(i, f"pay {c} now") for i, c in enumerate(good)]
    rows += [(1000 + i, f"ref {c[:-1]}{(int(c[-1]) + 3) % 10} end") for i, c in enumerate(good)]  # fail the check digit
    rows += [(5000, f"both {good[0]} {good[1]} here"), (5001, "call " + bad[0])]
    out = {r.doc_id: r for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not out[5000].base and [(x.start, x.end) for x in out[5000].added] == [(5, 21), (22, 38)]
    assert all(not out[1000 + i].base and not out[1000 + i].added for i in range(300))


def test_redact_and_edges(spark):
    df = spark.createDataFrame([("é a.b@c.de, 1.2.3.4!",), ("none",)], "text string")
    spans = F.expr("if(text = 'none', array(), array(named_struct('start', 2, 'end', 10), named_struct('start', 12, 'end', 19)))")
    assert [r[0] for r in df.select(P.redact(F.col("text"), spans)).collect()] == ["é [PII], [PII]!", "none"]
    e = P.find_pii(spark.createDataFrame([], "doc_id string, text string"))
    assert e.count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def test_trees_learn_from_every_base_match(spark, monkeypatch):
    from linkrisk.llm import pii
    kept, real = {}, pii.store
    monkeypatch.setattr(pii, "store", lambda df, name: kept.setdefault(name, real(df, name)))
    docs = spark.range(300).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(1, 75), i -> concat('10.0.', id, '.', i, ' and')), ' ') AS text")
    pii.find_pii(docs).count()
    matches = kept["pii-spans"].selectExpr("explode(spans) AS s").filter("s.base").count()
    assert matches > 20_000 and kept["pii-fit"].count() == matches
