"""Toxicity: a weighted finite-state pattern grammar.

Tokens are classified (insult, threat, target, negation, reported speech, clause
end, other). Three transducers read the stream: one marks insults and threats
inside the scope of a negation, one marks those inside reported speech, and one
waits for the end of the clause and emits a label for it: what was said
(threat, insult, negated, reported), and whether a person is its target. They
are composed into one deterministic machine. A document's score is a logistic
sum over the labels of its matched clauses; single words have no weight.

The insult class is a fixed list plus words and word beginnings learnt from
labelled rows: one half of a bounded sample gives the entries (those whose share
of toxic documents has a high lower bound), the other half fits the weights.

Scale: one narrow pass over all texts; the machine runs only over texts that
hold a hit (found by hashes of words and word beginnings in numpy). What goes
through the driver is bounded: the lexicon and the sample's label counts
(``SAMPLE_ROWS`` is the documented bound on labelled rows used for the fit).

Edge cases: a null or empty text has no clause and gets the score of the bias.
Without labelled rows of both kinds, fixed weights are used. Repeated rows score
alike. Very long texts are read whole, in chunks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import PUNCT, batches, mix, store, word_hashes

#: Labelled rows used to learn entries and weights (about; the rest is unused).
SAMPLE_ROWS = 24_000
#: Lengths of word beginnings, least toxic documents of an entry, least lower
#: bound of its share of toxic documents, width of that bound.
BEGINNINGS, MIN_DOCS, MIN_SHARE, WIDTH = (4, 5, 6), 5, 0.9, 1.64

INSULTS = frozenset("""idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb
jerk fool dummkopf trottel abschaum versager widerlich wertlos crétin imbécile ordure minable imbécil basura
inútil escoria""".split())
THREATS = frozenset("""kill hurt destroy beat murder shoot stab töten schlagen vernichten tuer frapper détruire
matar golpear destruir""".split())
TARGETS = frozenset("""you your yours he she him her they them these those people du dich dir ihr euch sie tu te toi vous
ils elles tú ti usted ustedes ellos ellas""".split())
NEGATIONS = frozenset("""not never no isn aren don doesn nicht kein keine nie pas jamais aucun nunca jamás""".split())
REPORTS = frozenset("""said says say called calls wrote quoted claims claimed told sagte sagt nannte schrieb dit appelle
écrit dijo dice llamó escribió""".split())
SCOPE = 3  # tokens after a negation

_TOKEN = re.compile(r"[^\W_]+|[.!?;:\n]+")
#: Beyond ASCII, what ends a token (punctuation, spaces, marks): the hashes split at ASCII bytes only.
_WIDE = re.compile(r"[^\x00-\x7f\w]+")


# --- transducers ------------------------------------------------------------

@dataclass(frozen=True)
class Fst:
    """step(state, symbol) -> (state, output symbol)."""
    start: object
    step: Callable


def _negation(state: int, sym: str):
    if sym == "N":
        return SCOPE, "O"
    if sym == "E":
        return 0, "E"
    out = sym + "-" if sym in "IV" and state else sym
    return max(0, state - 1), out


def _report(state: int, sym: str):
    if sym == "R":
        return 1, "O"
    if sym == "E":
        return 0, "E"
    return state, (sym[0] + '"' if sym[0] in "IV" and state else sym)


#: Clause labels, weakest first, by what the clause holds.
KINDS = ("reported", "negated", "insult", "threat")


def _clause(state: tuple, sym: str):
    target, kind = state
    if sym == "E":
        if kind < 0 or (kind == 3 and not target):  # a threat needs someone who is threatened
            return (0, -1), None
        return (0, -1), KINDS[kind] + ("+" if target else "")
    if sym == "T":
        return (1, kind), None
    if sym[0] in "IV":
        now = 1 if sym.endswith("-") else 0 if sym.endswith('"') else 3 if sym == "V" else 2
        if sym[0] == "V" and now < 2:
            return state, None
        return (target, max(kind, now)), None
    return state, None


def compose(a: Fst, b: Fst) -> Fst:
    """The transducer that feeds a's output to b."""
    def step(state, sym):
        s, mid = a.step(state[0], sym)
        t, out = b.step(state[1], mid)
        return (s, t), out
    return Fst((a.start, b.start), step)


def table(fst: Fst, alphabet: str = "OIVTNRE") -> dict:
    """The reachable states of ``fst`` as one transition table over numbers."""
    number, todo, out = {fst.start: 0}, [fst.start], {}
    while todo:
        s = todo.pop()
        for sym in alphabet:
            t, label = fst.step(s, sym)
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            out[number[s], sym] = (number[t], label)
    return out


GRAMMAR = table(compose(compose(Fst(0, _negation), Fst(0, _report)), Fst((0, -1), _clause)))
LABELS = tuple(k + t for k in KINDS for t in ("", "+") if k + t != "threat")

_CLASSES = {w: c for c, ws in (("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS), ("V", THREATS), ("I", INSULTS)) for w in ws}


@dataclass(frozen=True)
class Lexicon:
    """Learnt insults: whole words, and beginnings of words."""
    words: frozenset
    beginnings: frozenset

    def classify(self, token: str) -> str:
        if token[0] in ".!?;:\n":
            return "E"
        c = _CLASSES.get(token)
        if c:
            return c
        if token in self.words or any(token[:k] in self.beginnings for k in BEGINNINGS):
            return "I"
        return "O"


def clause_labels(text: str, lexicon: Lexicon) -> Counter:
    """Labels of the text's matched clauses."""
    found: Counter = Counter()
    state, grammar, classify = 0, GRAMMAR, lexicon.classify
    for token in _TOKEN.findall(text.lower()):
        state, label = grammar[state, classify(token)]
        if label:
            found[label] += 1
    label = grammar[state, "E"][1]
    if label:
        found[label] += 1
    return found


def hit_filter(lexicon: Lexicon):
    """A function: texts -> for each, whether it holds an insult or threat."""
    words = [w.encode() for w in lexicon.words | INSULTS | THREATS]
    starts = [b.encode() for b in lexicon.beginnings]
    lengths = tuple(sorted({len(b) for b in starts}))
    known = np.sort(word_hashes(words, PUNCT)[1])
    begin = {k: np.sort(np.concatenate([word_hashes([b], PUNCT, (k,))[2][0] for b in starts if len(b) == k])) for k in lengths}

    def isin(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x

    def plain(t: str) -> str:
        return t if t.isascii() else _WIDE.sub(" ", t)

    def run(texts: list) -> np.ndarray:
        doc, h, pre = word_hashes([plain(t.lower()).encode() if t else None for t in texts], PUNCT, lengths)
        hit = isin(h, known)
        for k, p in zip(lengths, pre):
            hit |= isin(p, begin[k])
        out = np.zeros(len(texts), bool)
        out[doc[hit]] = True
        return out
    return run


# --- features ---------------------------------------------------------------

def count_labels(df: DataFrame, lexicon: Lexicon, text_col: str, clauses_col: str = "clauses") -> DataFrame:
    """``df`` with a column ``clauses`` array<int> in place of the text: the number
    of clauses of each label."""
    from pyspark.sql import types as T
    at = df.columns.index(text_col)
    schema = T.StructType([f for f in df.schema.fields if f.name != text_col] + [T.StructField(clauses_col, T.ArrayType(T.IntegerType()))])

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        hits, none = hit_filter(lexicon), [0] * len(LABELS)
        for batch in it:
            for b in batches(batch, "toxicity"):
                texts = b.column(at).to_pylist()
                rows = []
                for t, hit in zip(texts, hits(texts)):
                    c = clause_labels(t, lexicon) if hit else None
                    rows.append([c[x] for x in LABELS] if c else none)
                cols = [b.column(i) for i in range(b.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(rows, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def features(counts: np.ndarray) -> np.ndarray:
    """Bias, log counts, and whether any clause is a plain insult or a threat."""
    strong = [i for i, x in enumerate(LABELS) if x.rstrip("+") in ("insult", "threat")]
    return np.column_stack([np.ones(len(counts)), np.log1p(counts), counts[:, strong].sum(axis=1) > 0]).astype(float)


#: Used where the labels show one class only: bias, then as in ``features``.
DEFAULT_WEIGHTS = np.array([-3.0] + [0.2, 0.4, 0.2, 0.4, 1.0, 1.5, 2.0] + [2.0])


def fit_weights(counts: np.ndarray, toxic: np.ndarray, rows: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps; a ridge pulls towards the defaults."""
    if not (rows[toxic == 1].sum() and rows[toxic == 0].sum()):
        return DEFAULT_WEIGHTS
    x, w = features(counts), DEFAULT_WEIGHTS.copy()
    pull = np.full(len(w), ridge)
    pull[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (rows * (toxic - p)) - pull * (w - DEFAULT_WEIGHTS)
        step = np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- learning ---------------------------------------------------------------

def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Entries from (text, toxic): words and beginnings whose share of toxic
    documents has a lower bound of at least MIN_SHARE."""
    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        bad: Counter = Counter()
        good: Counter = Counter()
        for batch in it:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {t for t in set(_TOKEN.findall((text or "").lower())) if len(t) >= BEGINNINGS[0] and t.isalpha()}
                seen = {"=" + w for w in words} | {w[:k] for w in words for k in BEGINNINGS if len(w) >= k}
                (bad if toxic else good).update(seen)
        keys = list(bad)  # an entry needs toxic documents somewhere; the rest is counted below
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()),
                                          pa.array([0] * len(keys), pa.int64())], names=["entry", "bad", "good"])
        keys = list(good)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([0] * len(keys), pa.int64()),
                                          pa.array([good[k] for k in keys], pa.int64())], names=["entry", "bad", "good"])

    counts = sample.select("text", "toxic").mapInArrow(run, "entry string, bad bigint, good bigint")
    counts = counts.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= MIN_DOCS)
    n = F.col("bad") + F.col("good")
    p = F.col("bad") / n
    z2 = WIDTH * WIDTH
    low = (p + z2 / (2 * n) - WIDTH * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    rows = counts.withColumn("low", low).filter((F.col("low") >= MIN_SHARE) | (F.col("good") == 0)).collect()
    # entries without a clean document first, then short ones; what an entry covers needs none of its own
    words, starts, covered = set(), set(), Counter()
    for r in sorted(rows, key=lambda r: (r["good"] > 0, r["entry"][0] == "=", len(r["entry"]), r["entry"])):
        e = r["entry"].lstrip("=")
        if any(e[:k] in starts for k in BEGINNINGS) or (r["good"] and covered[e] >= 0.9 * r["bad"]):
            continue
        (words if r["entry"][0] == "=" else starts).add(e)
        for k in BEGINNINGS:
            if k < len(e):
                covered[e[:k]] += r["bad"]
    return Lexicon(frozenset(words), frozenset(starts))


def families(df: DataFrame) -> DataFrame:
    """``df`` (text first) with ``family``: the least hash of the text's word triples (of all
    its words when it has fewer than three). Near copies mostly share it, so copies do not
    count as evidence."""
    from pyspark.sql import types as T
    schema = T.StructType(df.schema.fields + [T.StructField("family", T.LongType())])

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in it:
            for b in batches(batch, "toxicity"):
                doc, h, _ = word_hashes([t.encode() if t else None for t in b.column(0).to_pylist()])
                least = np.full(b.num_rows, np.iinfo(np.uint64).max, np.uint64)
                words = np.bincount(doc, minlength=b.num_rows)
                if len(h) > 2:
                    own = doc[2:] == doc[:-2]  # triples within one text
                    g = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:])
                    np.minimum.at(least, doc[2:][own], g[own])
                few = np.zeros(b.num_rows, np.uint64)
                np.add.at(few, doc, h)
                least = np.where(words > 2, least, mix(few + words.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(b.columns + [pa.array(least.view(np.int64))], names=schema.names)

    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from the labelled rows that ``may_learn`` admits."""
    lab = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("toxic")).filter(
        "toxic is not null and k is not null").groupBy("k").agg(F.max("toxic").alias("toxic"))
    own = docs.filter(may_learn).select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).filter("text is not null")
    n = own.select("k").join(lab, "k").count()
    share = min(1.0, sample_rows / max(n, 1))
    coin = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1_000_000)) / 1e6
    sample = own.filter(coin(1) < share).join(lab, "k").select("text", "toxic", (coin(2) < 0.5).alias("half"), "k")
    row = F.struct("text", "toxic", "half")  # of a family, the row of least id, then text
    one = families(sample).groupBy("family").agg(F.min(F.struct("k", F.md5("text").alias("d"), row.alias("r"))).alias("m"))
    sample = store(one.select("m.r.*"), "tox-sample")
    lexicon = learn_lexicon(sample.filter("half"))
    found = (count_labels(sample.filter("not half").select("text", "toxic"), lexicon, "text")
             .groupBy("clauses", "toxic").agg(F.count("*").alias("rows")).collect())  # at most the sample's rows
    if not found:
        return lexicon, DEFAULT_WEIGHTS
    counts = np.array([r["clauses"] for r in found], float)
    return lexicon, fit_weights(counts, np.array([r["toxic"] for r in found]), np.array([r["rows"] for r in found], float))


def score_column(clauses: Column, weights: np.ndarray) -> Column:
    """The logistic sum as a native expression over the label counts."""
    strong = [i for i, x in enumerate(LABELS) if x.rstrip("+") in ("insult", "threat")]
    z = F.lit(float(weights[0])) + sum((F.log1p(clauses[i]) * float(weights[1 + i]) for i in range(len(LABELS))), F.lit(0.0))
    any_strong = F.greatest(*[clauses[i] for i in strong]) > 0
    z = z + F.when(any_strong, float(weights[-1])).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], text_col: str = "text", clauses_col: str = "clauses",
          score_col: str = "score") -> DataFrame:
    """``docs`` with the text replaced by clauses (label counts) and score; give other names
    where ``docs`` has columns of these (``base.name_of``)."""
    lexicon, weights = model
    return count_labels(docs, lexicon, text_col, clauses_col).withColumn(score_col, score_column(F.col(clauses_col), weights))
