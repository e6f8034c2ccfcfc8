"""Benchmark matches against plain dynamic programming."""

import random

from linkrisk.llm import decontamination as D


def dp(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        op = rng.randrange(3)
        if op == 0:
            s[i] = rng.choice("xyz")
        elif op == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def test_myers():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        assert D.myers(p, t)[0] == dp(p, t)


def test_finds_all_within_budget(spark):
    rng = random.Random(5)
    items = [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(30, 200))).strip() + "q") for i in range(25)]
    docs = []
    for d in range(120):
        i, t = rng.choice(items)
        k = rng.choice([0, 1, 2, int(0.05 * len(t)), int(0.05 * len(t)) + 3])
        docs.append((d, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 300))) + "  " + edited(rng, D.normal(t).upper(), k) + "\n tail", "s", i))
    docs += [(500, None, "s", 0), (501, "", "s", 0), (502, "abc", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, distance string, item_id int")
    it = spark.createDataFrame(items + [(99, None), (98, "short"), (97, "")], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.find_items(df, it, block_chars=900).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, t in items:
            n = D.normal(t)
            x = dp(n, D.normal(text or ""))
            if x <= int(0.05 * len(n)):
                want[d, i] = x
    assert got == want and len(want) > 40
    left = {r.doc_id for r in D.decontaminate(df, it, block_chars=900).collect()}
    assert left == {d[0] for d in docs} - {d for d, _ in want}


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(e, i).count() == 0 and D.decontaminate(e, i).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert D.decontaminate(one, i).count() == 1
