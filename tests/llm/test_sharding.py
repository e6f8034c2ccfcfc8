"""Sharding against brute force; contract columns."""

import zlib
from collections import Counter, defaultdict

import pytest

from linkrisk.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, g string"


def brute(sizes, shards):
    """Smallest capacity for contiguous groups, by trying every possible one."""
    def fits(cap):
        used, cur = 1, 0
        for s in sizes:
            if s > cap:
                return False
            if cur + s > cap:
                used, cur = used + 1, 0
            cur += s
        return used <= shards
    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("most_ends", [50_000, 3])
def test_minimax_matches_brute_force(spark, rng, monkeypatch, most_ends):
    monkeypatch.setattr(S, "MOST_ENDS", most_ends)
    monkeypatch.setattr(S, "BUCKETS", 7)
    texts = ["t" * rng.randint(0, 60) + str(i % 150) for i in range(200)] + ["copy" * 9] * 90 + [None, None, "", "é" * 5]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    out = S.shard_by_bytes(df, 8).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    load, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        t = texts[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[t].add(r.shard)
    assert all(len(s) == 1 for s in of.values())  # groups are whole
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    import hashlib
    order = sorted(of, key=lambda t: ("-" if t is None else hashlib.md5(t.encode()).hexdigest()))
    bucket = lambda t: 0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 7
    order = sorted(order, key=bucket)
    count = Counter(texts)
    assert max(load.values()) == brute([count[t] * (len((t or "").encode()) + 1) for t in order], 8)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.shard_by_bytes(empty, 8).count() == 0
    one = S.shard_by_bytes(spark.createDataFrame([(1, "same", "x", "y")] * 5 + [(None, "same", None, None)], SCHEMA), 8).collect()
    assert {r.shard for r in one} == {0} and sorted(r.slot for r in one) == list(range(6))


@pytest.mark.parametrize("share,place,most_ends", [(0.05, 0.49, 3), (0.05, 0.49, 0), (0.13, 0.1, 40), (0.08, 0.63, 3)])
def test_search_ends_with_a_large_group_across_a_cut(spark, rng, monkeypatch, share, place, most_ends):
    """More ends in the windows at the optimum than the driver may hold."""
    monkeypatch.setattr(S, "MOST_ENDS", most_ends)
    rounds, search = [], S.least_capacity

    def counted(*a):
        rounds.append(a)
        assert len(rounds) < 30, "the search does not end"
        return search(*a)

    monkeypatch.setattr(S, "least_capacity", counted)
    sizes = [rng.randint(1, 20) for _ in range(1500)]
    sizes.insert(int(place * len(sizes)), int(share / (1 - share) * sum(sizes)))
    rows, end = [], 0
    for i, x in enumerate(sizes):
        end += x
        rows.append((i * 7 // len(sizes), end, i + 1))
    prefix = S.store(spark.createDataFrame(rows, "b int, end_bytes long, end_rows long"), "t")
    cuts = S.minimax_cuts(prefix, 8, end, max(sizes))
    ends = {0: 0} | {b: n for _, b, n in rows}
    assert cuts[0] == (0, 0) and cuts[-1] == (end, len(sizes)) and len(cuts) <= 9
    assert all(ends[b] == n for b, n in cuts)
    best = brute(sizes, 8)
    assert max(y[0] - x[0] for x, y in zip(cuts, cuts[1:])) == best > max(-(-end // 8), max(sizes))
