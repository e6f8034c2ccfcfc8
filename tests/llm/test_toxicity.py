"""The grammar, and held-out accuracy on labelled rows."""

from collections import Counter

import pytest

from pyspark.sql import functions as F

from linkrisk.llm import toxicity as T
from linkrisk.llm.queries import held_out

LEX = T.Lexicon(frozenset({"zork"}), frozenset({"blarg"}))


@pytest.mark.parametrize("text,labels", [
    ("you are an idiot", {"insult+": 1}), ("what a moron. fine day", {"insult": 1}), ("he is not an idiot", {"negated+": 1}),
    ("she said you are an idiot. ok", {"reported+": 1}), ("we will kill you", {"threat+": 1}), ("kill the process", {}),
    ("not a b c d idiot", {"insult": 1}), ("zork!", {"insult": 1}), ("Blargness everywhere", {"insult": 1}), ("blar", {}), ("", {}),
    ("idiot. idiot\nnever an idiot", {"insult": 2, "negated": 1}), ("you. idiot", {"insult": 1})])
def test_grammar(text, labels):
    assert T.clause_labels(text, LEX) == Counter(labels)


def test_composition_is_one_finite_machine():
    """The table equals running the three transducers one after another."""
    import itertools
    machines = [T.Fst(0, T._negation), T.Fst(0, T._report), T.Fst((0, -1), T._clause)]
    for word in itertools.product("OIVTNRE", repeat=5):
        states, state = [m.start for m in machines], 0
        for sym in word:
            out = sym
            for i, m in enumerate(machines):
                states[i], out = m.step(states[i], out)
            state, label = T.GRAMMAR[state, sym]
            assert label == out


def test_hit_filter():
    hits = T.hit_filter(LEX)(["a zork, b", "Blarged", "nothing", None, "", "x" * 3_000_000 + " idiot", "ZORK"])
    assert hits.tolist() == [True, True, False, False, False, True, True]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit(docs, labels, ~held_out())
    out = T.score(docs, model).filter(held_out()).join(labels, "doc_id").select("score", "toxic").toPandas()
    pred = out.score >= 0.3
    tp, fp, fn = (pred & (out.toxic == 1)).sum(), (pred & (out.toxic == 0)).sum(), (~pred & (out.toxic == 1)).sum()
    print("precision", tp / (tp + fp), "recall", tp / (tp + fn))
    assert tp / (tp + fp) >= 0.9 and tp / (tp + fn) >= 0.6


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5, 1), (2, "", 0.5, 1), (None, "an idiot", 0.5, 1), (3, "fine", None, None)], "doc_id long, text string, score double, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, none, ~held_out())
    got = T.score(docs.drop("score"), model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score >= 0.3 for r in got} == {1: False, 2: False, None: True, 3: False}
    assert T.score(docs.limit(0).drop("score"), model).count() == 0


@pytest.mark.parametrize("around", ["“{}”", "« {} »", "{}…", "{}—so", " {} ", "、{}。", "‘{}’", "¿{}?", " {}　", "_{}́", "·{}·", "é„{}“é"])
@pytest.mark.parametrize("word", ["idiot", "CRÉTIN", "zork", "blargly", "imbécile"])
def test_hits_hold_whenever_a_clause_does(around, word):
    """Tokens end at Unicode punctuation, spaces and marks in the filter too."""
    text = "well " + around.format(word)
    assert T.clause_labels(text, LEX) and T.hit_filter(LEX)([text]).tolist() == [True]
    assert T.hit_filter(LEX)(["well " + around.format("friend"), None]).tolist() == [False, False]


def test_families_do_not_depend_on_neighbours_or_layout(spark, rng):
    """A text's family is its own: it is the same whatever texts stand next to it, and the
    model learnt is the same over any partitioning."""
    texts = ["a b c", "x y", "p q", "x y", "", None, "one", "a b c d e f"] + [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) for _ in range(40)]
    seen = {}
    for _ in range(3):
        rng.shuffle(texts)
        df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        for r in T.families(df).collect():
            assert seen.setdefault(r["text"], r["family"]) == r["family"]
    assert len({seen["a b c"], seen["x y"], seen["p q"], seen["one"]}) == 4
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    models = [T.fit(d, labels, F.col("doc_id") % 2 == 0) for d in (docs.coalesce(1), docs.repartition(7))]
    assert models[0][0] == models[1][0] and (abs(models[0][1] - models[1][1]) < 1e-9).all()
