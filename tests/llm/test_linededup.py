"""Line dedup against all pairs of lines."""

import re

import pytest

from linkrisk.llm import linededup as D


def norm(line):
    line = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return re.sub(r"[ \t\x0B\f\r]+", " ", line).strip(" ").split(" ")


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    """docs: {id: text}; earliest of equal or matching lines stays."""
    lines = sorted((d, i, norm(x)) for d, t in docs.items() if t is not None for i, x in enumerate(t.split("\n")))
    lines = [x for x in lines if len(x[2]) >= D.MIN_WORDS]
    gone = set()
    for j, (d, i, w) in enumerate(lines):
        for _, _, v in lines[:j]:
            if v == w or (min(len(v), len(w)) >= D.NEAR_WORDS and one_edit(v, w)):
                gone.add((d, i))
                break
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs.items()}


def test_matches_all_pairs(spark, rng):
    vocab = [f"w{i}" for i in range(30)]
    pool = [rng.choices(vocab, k=rng.randint(1, 14)) for _ in range(40)]

    def line():
        w = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i, op = rng.randrange(len(w)), rng.randrange(3)
            if op == 0:
                w[i] = rng.choice(vocab)
            elif op == 1:
                w.insert(i, rng.choice(vocab))
            elif len(w) > 1:
                del w[i]
        s = "  ".join(w) if rng.random() < 0.1 else " ".join(w)
        return s.upper() if rng.random() < 0.1 else s

    docs = {d: "\n".join(line() for _ in range(rng.randint(1, 9))) for d in range(90)}
    docs |= {200: None, 201: "", 202: "\n\n", 203: " ".join(vocab * 300), 204: " ".join(vocab * 300 + ["x"])}
    df = spark.createDataFrame([(d, t, "a", "b", 3) for d, t in docs.items()], "doc_id long, text string, drop string, of string, i int")
    out = D.dedup_lines(df, dropped_col="gone").collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in out} == want and len(out) == len(docs)
    assert want[204] == "" and out[0].drop == "a" and sum(r.gone for r in out) > 100


def test_hot_line_and_repeated_rows(spark):
    hot = "the same line in every document of the table"
    rows = [(i, f"{hot}\nown line number {i} with quite other words w{i} x{i} y{i}") for i in range(300)]
    rows += [(7, rows[7][1])] * 2  # repeated rows: one document
    out = D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(hot in r.text for r in out) == 1 and len(out) == 302
    assert len({r.text for r in out if r.doc_id == 7}) == 1


@pytest.mark.parametrize("schema", ["doc_id long, text string", "doc_id string, text string, n_chars long"])
def test_empty(spark, schema):
    assert D.dedup_lines(spark.createDataFrame([], schema)).count() == 0
