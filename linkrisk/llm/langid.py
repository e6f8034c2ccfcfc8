"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, most frequent
first; a document's is the same over its own text. The out-of-place distance sums,
over the document's n-grams, how far each stands from its rank in the language's
profile (``SIZE`` where the profile lacks it); the language of least distance wins.

* Texts are lower-cased; letters are the characters of Unicode's letter categories,
  every other stretch of characters is one blank. N-grams have 1 to 3 characters and may
  begin or end with the blank at a word's edge, but do not reach over one. Each is
  packed into one 64-bit value (21 bits a character), so equality is exact.
* Learning counts n-grams over all labelled texts: every task adds them up by language
  before the shuffle, and sums are ranked by a window that is cut to ``SIZE`` rows a
  language before it shuffles. Profiles are ``SIZE`` rows a language; the number of
  languages is checked before they travel to the tasks.
* In a document many n-grams are equally frequent; they share the mean of their ranks,
  so that the order of ties does not matter.

Whole texts are read, in slices of about a million characters cut at white space.

Edge cases: a null text, or one without letters, is ``und`` with score 0; so is every
text when nothing was learnt. Texts that share no n-gram with any profile are as far
from all: the first language by name wins with score 0, as in any tie. Repeated rows and ids are independent
rows. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrisk.llm.base import store

#: N-grams of a profile, and the most languages whose profiles may travel to tasks.
SIZE, MAX_LANGUAGES = 400, 5000
#: Characters counted at once, and n-grams a task gathers before it passes them on.
SLICE, GATHER = 1 << 20, 1 << 21
UNKNOWN = "und"
_GAP = re.compile(r"\s")


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def slices(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def grams(text: str) -> np.ndarray:
    """The packed n-grams of one slice of text, with repeats; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c[~letters()[c]] = 1  # the blank; no letter has this code
    c = np.concatenate([[1], c, [1]])
    s = c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])]
    if len(s) < 3:
        return np.empty(0, np.int64)
    two = (s[:-1] << 21) | s[1:]
    three = ((two[:-1] << 21) | s[2:])[s[1:-1] != 1]
    return np.concatenate([s[s != 1], two, three])


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(grams(t), return_counts=True) for t in slices(text)]
    if len(parts) == 1:
        return parts[0]
    empty = np.empty(0, np.int64)
    return add_up(np.concatenate([empty, *[k for k, _ in parts]]), np.concatenate([empty, *[n for _, n in parts]]))


def mean_ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of descending counts, and the rank (from 0) at each place of it; equal
    counts share the mean of their ranks."""
    order = np.argsort(-counts, kind="stable")
    c = counts[order]
    new = np.concatenate([[True], c[1:] != c[:-1]])
    start = np.flatnonzero(new)
    end = np.concatenate([start[1:], [len(c)]])
    return order, ((start + end - 1) / 2)[np.cumsum(new) - 1]


def learn_profiles(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """(lang, gram, rank): the SIZE most frequent n-grams of each language, rank from 0.

    ``docs`` holds the labelled rows; those with a null language or text teach nothing.
    """
    def count(it: Iterator) -> Iterator:
        import pyarrow as pa
        sums: dict[str, list] = {}
        held = 0

        def flush() -> Iterator:
            for name, parts in sums.items():
                keys, n = add_up(*map(np.concatenate, zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()),
                                                  pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            sums.clear()

        for batch in it:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, group in _grouped(names, texts):
                k, n = np.unique(grams(group), return_counts=True)
                parts = sums.setdefault(name, [])
                parts.append((k, n))
                held += len(k)
                if len(parts) == 32:
                    held -= sum(len(p[0]) for p in parts)
                    parts[:] = [add_up(*map(np.concatenate, zip(*parts)))]
                    held += len(parts[0][0])
                if held > GATHER:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(lang.alias("lang"), text.alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).filter(F.col("rank") < SIZE).select("lang", "gram", "rank")


def _grouped(names: list, texts: list) -> Iterator[tuple[str, str]]:
    """Texts of one language put together, in slices of about SLICE characters."""
    waiting: dict[str, list] = {}
    size: dict[str, int] = {}
    for name, text in zip(names, texts):
        for t in slices(text):
            waiting.setdefault(name, []).append(t)
            size[name] = size.get(name, 0) + len(t)
            if size[name] > SLICE:
                yield name, "\n".join(waiting.pop(name))
                size[name] = 0
    for name, parts in waiting.items():
        yield name, "\n".join(parts)


class Profiles:
    """Profiles as one sorted n-gram array and a (n-gram, language) rank matrix."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), np.inf)  # last row: in no profile
        for name, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[name]] = rank

    def distances(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each language, between 0 and 1."""
        order, rank = mean_ranks(counts)
        order, rank = order[:SIZE], rank[:SIZE, None]
        at = np.searchsorted(self.grams, keys[order])
        at[at == len(self.grams)] = 0
        at[self.grams[at] != keys[order]] = len(self.grams)
        return np.minimum(np.abs(self.ranks[at] - rank), SIZE).mean(axis=0) / SIZE

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and how much nearer it is than the next one (0 to 1; with a
        single language: how near it is)."""
        keys, counts = count_grams(text) if text and self.langs else ((), ())
        if not len(keys):
            return UNKNOWN, 0.0
        d = self.distances(keys, counts)
        best = int(np.argmin(d))
        next_best = np.delete(d, best).min() if len(d) > 1 else 1.0
        return self.langs[best], float(1 - d[best] / next_best) if next_best > 0 else 0.0


def load_profiles(profiles: DataFrame) -> Profiles:
    """Profiles for the tasks; raises beyond MAX_LANGUAGES languages."""
    rows = profiles.limit(SIZE * MAX_LANGUAGES + 1).collect()
    if len(rows) > SIZE * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles([tuple(r) for r in rows])


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    model = load_profiles(store(profiles, "language-profiles"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(it: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in it:
            out = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()),
                                              pa.array([x for _, x in out], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        predict, f"`{id_col}` {id_type}, lang_pred string, score double")
