"""The pipeline's stages on the small tables, each against its operator's rule."""

import os
import re

import corpus_pipeline as C
from linkrisk.llm import decontamination as D
from linkrisk.llm import toxicity as T
from linkrisk.llm.queries import held_out
from tests.llm import test_ngramjoin as N
from tests.llm.test_linededup import brute as dedup
from tests.llm.test_ngramjoin import brute as components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    clean = C.store(C.STAGES[0][1](spark, docs, SF), "t")
    model = T.fit(docs, spark.read.parquet(os.path.join(SF, "labels.parquet")), ~held_out())
    bad = {r.doc_id for r in T.score(docs.select("doc_id", "text"), model).filter("score >= 0.3").collect()}
    every = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == set(every) - bad and clean.columns == docs.columns
    lined = C.store(C.STAGES[1][1](spark, clean, SF), "t")
    want = {d: t for d, t in dedup({d: every[d] for d in set(every) - bad}).items() if t.strip() or t == every[d]}
    got = {r.doc_id: r for r in lined.collect()}
    assert {d: r.text for d, r in got.items()} == want and lined.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text != every[r.doc_id])
    single = C.store(C.STAGES[2][1](spark, lined, SF), "t")
    ids = sorted(want)
    keep = {i for i, (n, c) in zip(ids, components(ids, [want[i] for i in ids])) if not n or c == i}
    assert {r.doc_id for r in single.collect()} == keep and single.columns == docs.columns
    items = [D.normal(r.text) for r in spark.read.parquet(os.path.join(SF, "benchmark.parquet")).collect()]
    out = C.store(C.STAGES[3][1](spark, single, SF), "t")
    left = {r.doc_id for r in out.collect()}
    exact = {i for i in keep if any(x in D.normal(want[i]) for x in items)}
    assert left <= keep - exact and len(keep - exact - left) <= 3 and out.columns == docs.columns
    pieces = C.STAGES[4][1](spark, out, SF).collect()
    assert {r.doc_id for r in pieces} == left


def test_clashing_columns_and_nulls(spark):
    """Extra columns named like the stages' own keep their values."""
    extra = ["score", "Clauses", "__text", "__dropped", "row", "drop", "of", "toxicity", "dropped_lines", "scored_text", "kept_row"]
    docs = spark.createDataFrame(
        [(1, None, None, None, None, *[f"a{c}" for c in extra]), (2, "", "en", "s", 0, *[f"b{c}" for c in extra]),
         (None, "a b c d e", None, None, 9, *[None for c in extra]), (3, "you idiot", "en", "s", 9, *[f"d{c}" for c in extra]),
         (4, "one long line of eight words or more here\nsecond line", "en", "s", 9, *[f"e{c}" for c in extra]),
         (5, "one long line of eight words or more here\nown words", "en", "s", 9, *[f"f{c}" for c in extra])],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    columns, given = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for _, stage in C.STAGES[:4]:
        docs = C.store(stage(spark, docs, SF), "t")
        assert docs.columns == columns
    out = {r["doc_id"]: r for r in docs.collect()}
    assert set(out) == {1, 2, None, 4, 5}
    for k, r in out.items():
        assert [r[c] for c in extra] == [given[k][c] for c in extra]
    assert out[5]["text"] == "own words" and out[5]["n_chars"] == 9


def test_repeated_rows_and_shared_ids(spark):
    """Of repeated rows one stays; rows that share an id are judged by their own texts."""
    long = [f"w{i} x{i} y{i} z{i} line of words number {i}" for i in range(12)]
    rows = [(1, "\n".join(long[:3])), (1, "\n".join(long[:3])), (5, long[3]), (5, long[4] + " tail"), (2, long[4]),
            (7, "\n".join(long[5:9])), (7, "\n".join(long[5:9]) + "\n" + long[10])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lined = C.store(C.drop_repeated_lines(spark, docs.coalesce(1), SF), "t")
    # repeated rows stay alike; the second text of id 5 is one word from the line of id 2; of
    # the texts of id 7, the one that counts as the later loses the lines of the other
    got = sorted((r["doc_id"], r["text"]) for r in lined.collect())
    assert got[:4] == sorted([(1, "\n".join(long[:3]))] * 2 + [(2, long[4]), (5, long[3])])
    assert got[4:] in ([(7, long[10]), (7, "\n".join(long[5:9]))], [(7, "\n".join(long[5:9] + long[10:11]))])
    single = C.keep_one_of_each_group(spark, C.store(docs.coalesce(1), "t"), SF)
    # five of the six five-word sequences of the second text of id 5 are all those of id 2
    assert sorted((r["doc_id"], r["text"]) for r in single.collect()) == sorted(set(rows) - {rows[3]})


def test_no_stage_reads_a_prefix():
    """No limit or sample in the pipeline module."""
    with open(C.__file__) as f:
        assert not re.search(r"[.]limit\(|[.]sample\(", f.read())


def test_near_copies_by_five_words(spark, rng, monkeypatch):
    """The near-duplicate stage against all pairs of five-word sets at 0.8."""
    monkeypatch.setattr(N, "sets_of", lambda texts, sets_of=N.sets_of: sets_of(texts, 5))
    vocab = [f"v{i}" for i in range(2000)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([40, 100, 200]))
        for edits in [0, 1, 1, 2, 2, 3, 4, 5]:
            w = list(base)
            for i in rng.sample(range(len(w)), edits):
                w[i] = rng.choice(vocab)
            texts.append(" ".join(w))
    base = rng.choices(vocab, k=100)
    texts += [" ".join(base), " ".join(["other", *base[1:49], "words", *base[50:]])]  # 0.89 of five words, 0.92 of three
    texts += [" ".join(base[:50]), " ".join([*base[:24], "x", *base[25:50]])]  # 0.8 of five words, 0.88 of three
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id for r in C.keep_one_of_each_group(spark, docs, SF).collect()}
    assert out == {i for i, (n, c) in zip(ids, components(ids, texts, 80)) if not n or c == i}
    assert ids[-1] not in out
