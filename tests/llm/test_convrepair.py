import hashlib
import itertools
import zlib

import pytest

from linkrisk.llm import convrepair as C
from tests.llm.conftest import rows

WHITE = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """(cost, audit, row codes) by trying all edit sequences, least audit first."""
    best = {(0, 0): [(0, "", "")]}  # (row, state) -> all prefixes of least cost
    n, found = len(symbols), []
    todo = [(0, "", "", 0, 0)]
    limit = 3 * n
    while todo:
        cost, audit, code, i, q = todo.pop()
        if cost > limit:
            continue
        if i == n and q in (0, 3):
            found.append((cost, audit, code))
            limit = min(limit, cost)
        if len(code) < 3 * n + 4:
            todo.append((cost + 2, audit + "I", code + ("A" if q == 2 else "U"), i, (2, 2, 3, 2)[q]))
        if i < n:
            c, kind = C.unpack(symbols[i])
            todo.append((cost + 3, audit + "D", code + "D", i + 1, q))
            if kind != 2:
                keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "-": {0: 0, 1: 1, 2: 2, 3: 3}, "x": {}}[c].get(q)
                if keep is not None:
                    todo.append((cost + kind, audit + "K", code + "K", i + 1, keep))
                todo.append((cost + kind + 2, audit + "R", code + ("a" if q == 2 else "u"), i + 1, (2, 2, 3, 2)[q]))
    return min(found)


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_all_short_sequences(length):
    alphabet = [chr(97 + k) for k in range(15)]
    seqs = ["".join(s) for s in itertools.product(alphabet, repeat=length)]
    done = C.solve([(s, C.END, True) for s in seqs])
    for s, (codes, _, costs) in list(zip(seqs, done))[::1 if length < 3 else 7]:
        cost, _, code = cheapest(s)
        assert (costs[0], codes[0]) == (cost, code), s


def test_longer_sequences(rng):
    seqs = ["".join(rng.choice("adgadgadgbehcfimno") for _ in range(rng.randint(4, 6))) for _ in range(150)]
    for s, (codes, _, costs) in zip(seqs, C.solve([(s, C.END, True) for s in seqs])):
        assert (costs[0], codes[0]) == cheapest(s)[::2], s


def test_ranks_order_nodes_by_audit(rng):
    letters = [rng.choice([68, 73, 75, 82]) for _ in range(60)] + [0]
    import numpy as np
    to = np.array([rng.randint(i + 1, min(i + 3, 60)) for i in range(60)] + [60])
    rank, pointers, length = C.rank_paths(np.array(letters), to)

    def audit(v):
        out = ""
        while letters[v]:
            out += chr(letters[v])
            v = to[v]
        return out
    texts = [audit(v) for v in range(61)]
    for a, b in itertools.combinations(range(61), 2):
        assert (rank[a] < rank[b]) == (texts[a] < texts[b]) and (rank[a] == rank[b]) == (texts[a] == texts[b])
    node, path = C.path_nodes(np.arange(61), length, pointers)
    assert ["".join(chr(letters[v]) for v in node[path == p]) for p in range(61)] == texts


def brute(conversations):
    """op13's rows from plain Python, rows given in their final order by turn."""
    out = {}
    for conv, given in conversations.items():
        some = lambda x: " " if x is None else str(x)
        after = []
        for turn, role, text in given:
            kind, role, text = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20, some(role), some(text)
            if kind == 1:
                text = ""
            elif kind == 2:
                text = "".join(c for c in text if c not in ".!?")
            elif kind == 4:
                role = "user"
            after += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in after:
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        cls = [r[:1] if r[:1] in "sua" and r else "x" if r else "-" for _, r, _ in after]
        symbols = "".join(C.symbol_of(c, {None: 0, "truncated": 1}.get(f, 2)) for c, f in zip(cls, faults))
        cost, audit, code = cheapest(symbols) if symbols else (0, "", "")
        repaired, k = [], 0
        for c in code:
            if c in "UA":
                repaired.append({"U": "user", "A": "assistant"}[c] + ":")
                continue
            _, role, text = after[k]
            k += 1
            if c != "D":
                repaired.append({"K": role, "u": "user", "a": "assistant"}[c] + ":" + text)
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(repaired).encode()).hexdigest()}
    return out


def sample(rng):
    texts = ["Fine.", "Well!", "cut off", "Why?", "", " \t", "also cut ", "Ends. \n", None, "dots... here."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None]
    out = {}
    for conv in [None, *range(60)]:
        n = rng.randint(1, 7)
        turns = [rng.choice([t, t, t, t + 1, None]) for t in range(n)]
        out[conv] = [(t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return out


@pytest.mark.parametrize("block_bits", [14, 1])
def test_against_brute_force(spark, rng, tmp_path, monkeypatch, block_bits):
    from linkrisk.llm import queries
    given = sample(rng)
    flat = [(c, t, r, x, 1.5) for c, rs in given.items() for t, r, x in rs]
    rng.shuffle(flat)
    spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, row double").write.parquet(
        str(tmp_path / "conversations.parquet"))
    whole = C.repair
    monkeypatch.setattr(C, "repair", lambda df: whole(df, block_bits))
    got = rows(queries.op13_conversation_repair(spark, str(tmp_path)))
    want = brute(given)
    assert len(got) == len(want)
    for r in got:
        conv = r.pop("conv_id")
        assert r == want[conv], conv


def test_one_conversation_over_many_chunks(spark, rng):
    """A conversation of many rows, cut into chunks, is repaired as in one piece."""
    flat = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {t}.", "cut", ""])) for t in range(400)]
    df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string")
    a, b = C.repair(df, 3), C.repair(df, 14)
    assert a.chunks.count() > 40
    assert rows(C.audits(a)) == rows(C.audits(b)) and rows(a.report) == rows(b.report)
    pick = lambda d: [(r["edit"], r["role"], r["text"]) for r in rows(C.repaired_rows(d).orderBy("row", "step"))]
    assert pick(a) == pick(b)


def test_empty_table(spark, tmp_path):
    from linkrisk.llm import queries
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op13_conversation_repair(spark, str(tmp_path)).count() == 0
