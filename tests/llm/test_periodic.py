import hashlib
import re
import zlib

from linkrisk.llm import periodic as P
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, min_length=6, exponent=4):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            if w[s] != w[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            smaller = any(q % d == 0 and all(w[i] == w[i + d] for i in range(s, s + length - d)) for d in range(1, q))
            if length >= max(min_length, exponent * q) and not smaller:
                out.add((s, length, q))
            s = e + 1
    return sorted(out)


def words_with_periods(rng, n, alphabet):
    w = [b"%d" % rng.randrange(alphabet) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if w:
            a, p = rng.randrange(len(w)), rng.randint(1, 70)
            m = rng.randint(1, 8 * p)
            block = w[a:a + p]
            w[a:a + (m if rng.random() < 0.5 else 0)] = (block * (m // len(block) + 1))[:m]
    return w


def test_runs_against_brute_force(rng):
    total = 0
    for _ in range(50):
        docs = [words_with_periods(rng, rng.randint(0, 400), rng.choice([2, 3, 5, 50])) for _ in range(rng.randint(1, 5))]
        got = P.find_runs([P.word_values(b" ".join(d)) for d in docs])
        for d, runs in zip(docs, got):
            assert runs == brute_runs(d)
            total += len(runs)
    assert total > 200


def test_long_periods_and_slices(rng, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 50)
    period = [b"w%d" % rng.randrange(10**6) for _ in range(1500)]
    w = [b"x"] * 40 + period * 4 + period[:7] + [b"y"]
    text = b" \n".join(w)
    assert P.find_runs([P.word_values(text)]) == [[(0, 40, 1), (40, 6007, 1500)]]
    assert P.kept_text(text, [(0, 40, 1), (40, 6007, 1500)], len(w)) == b" ".join([b"x"] + period + [b"y"])


def test_synchronising_sets_are_locally_consistent(rng):
    """Equal contexts of 2 tau words are selected alike; sets are sparse in plain text."""
    import numpy as np
    tau = 8
    ids = np.array([rng.getrandbits(63) for _ in range(5000)], np.uint64)
    ids[3000:3500] = ids[1000:1500]
    at = set(P.synchronising_set(ids, tau).tolist())
    for i in range(1000, 1500 - 2 * tau):
        assert (i in at) == (i + 2000 in at)
    assert all(any(j in at for j in range(i, i + tau)) for i in range(0, 4900, tau))
    assert len(at) < 5000 * 3 / tau


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    from fractions import Fraction
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": sha("".join("%d,%d,%d\n" % r for r in runs)),
            "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in drop))}


def test_query_against_brute_force(spark, rng, tmp_path):
    from linkrisk.llm import queries
    glue = [" ", "\n", "\t ", "\x0b", " ", " "]
    data = [(None, "a a a a a a a", 1), (3, None, 1), (4, "", 2), (4, "", 2), (7, " \n ", 3)]
    for i in range(100, 260):
        w = [x.decode() for x in words_with_periods(rng, rng.randint(0, 120), rng.choice([2, 4, 40]))]
        data.append((i, "".join(x + rng.choice(glue) for x in w), i))
    spark.createDataFrame(data, "doc_id long, text string, runs long").write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["collapsed_sha256"])
    got = sorted(rows(queries.op11_periodic_runs(spark, str(tmp_path))), key=key)
    want = sorted((brute_row(d, t) for d, t, _ in data), key=key)
    assert got == want
    assert sum(r["n_runs"] for r in got) > 50


def test_empty_table(spark, tmp_path):
    from linkrisk.llm import queries
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_periodic_runs(spark, str(tmp_path)).count() == 0
