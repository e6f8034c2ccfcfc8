"""Benchmark decontamination: pigeonhole edit matching.

A test item of n characters may occur in a document with up to ``rate * n`` edits.
It is split into one piece more than that budget, so at least one piece occurs
unchanged. All pieces of a block of items are found in one pass over a text
(Aho-Corasick); around each hit Myers' bit-parallel algorithm gives the edit
distance of the item to the best matching stretch of the text.

Both sides are compared in lower case with white space runs as one space.

Scale: documents are read in place, without a shuffle. The items are the stated
query set: they are dealt into blocks of a bounded number of characters, each
block is one narrow pass, and blocks are combined by a union. Memory per task:
one Arrow slice and one block's automaton.

Edge cases: null or empty texts match nothing. Items shorter than ``min_chars``
(normalised) are too short to be told from chance and are left out. Repeated
documents and items are matched row by row; equal items match alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import batches, kept

RATE, MIN_CHARS = 0.05, 25
#: Characters of items whose automaton one task holds.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and the end
    (exclusive) of the first such stretch. Myers (1999), bit vectors in one int."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds items in texts within their error budgets."""

    def __init__(self, items: list[str], rate: float):
        import ahocorasick
        self.items, self.rate = items, rate
        places: dict[str, list] = {}
        for n, text in enumerate(items):
            k = int(rate * len(text))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((n, a))
        self.find = ahocorasick.Automaton()
        for piece, at in places.items():
            self.find.add_word(piece, (len(piece), at))
        self.find.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """Per item number the least distance and the end of that match."""
        tried: set = set()
        best: dict[int, tuple[int, int]] = {}
        for last, (size, at) in self.find.iter(text):
            for n, a in at:
                start = last + 1 - size - a  # where the item would begin without edits before the piece
                item = self.items[n]
                if n in best and best[n][0] == 0 or (n, start) in tried:
                    continue
                tried.add((n, start))
                if start >= 0 and text.startswith(item, start):
                    best[n] = (0, start + len(item))
                    continue
                k = int(self.rate * len(item))
                if not k:
                    continue
                lo = max(0, start - k)
                d, end = myers(item, text[lo:start + len(item) + k])
                if d <= k and (n not in best or d < best[n][0]):
                    best[n] = (d, lo + end)
        return best


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_end) for every item found in a document;
    match_end counts characters of the normalised text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    schema = (f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, "
              f"item_id {tests.schema['item_id'].dataType.simpleString()}, distance int, match_end int")

    def scan(ids, texts: list[str]):
        def run(it: Iterator) -> Iterator:
            import pyarrow as pa
            matcher = matcher_of(texts, rate)
            for batch in it:
                for b in batches(batch, "decontamination"):
                    found = [(r, n, d, end) for r, text in enumerate(b.column(1).to_pylist()) if text
                             for n, (d, end) in matcher.matches(normal(text)).items()]
                    if found:
                        r, n, d, end = (pa.array(x, pa.int32()) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(r), ids.take(n), d, end],
                                                         names=["doc_id", "item_id", "distance", "match_end"])
        return run

    parts = [slim.mapInArrow(scan(*b), schema) for b in item_blocks(tests, min_chars, block_chars)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def item_blocks(tests: DataFrame, min_chars: int, block_chars: int) -> Iterator[tuple]:
    """The items (Arrow array of ids, normalised texts), in blocks of about ``block_chars``."""
    tests = tests.filter(F.col("text").isNotNull())
    blocks = 1 + int((tests.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    for b in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        texts = [normal(t) for t in rows.column("text").to_pylist()]
        long = [i for i, t in enumerate(texts) if len(t) >= min_chars]
        if long:
            yield rows.column("item_id").combine_chunks().take(long), [texts[i] for i in long]


def matcher_of(texts: list[str], rate: float) -> Matcher:
    """The matcher of a block's texts; a worker keeps the last one."""
    key = hash((tuple(texts), rate))
    return kept("decontamination", key, lambda: Matcher(texts, rate), last=True)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS,
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, columns as given: one narrow
    filter per block of items."""
    at, schema = docs.columns.index(text_col), docs.schema

    def keep(texts: list[str]):
        def run(it: Iterator) -> Iterator:
            import pyarrow as pa
            matcher = matcher_of(texts, rate)
            for batch in it:
                for b in batches(batch, "decontamination"):
                    clean = [not (t and matcher.matches(normal(t))) for t in b.column(at).to_pylist()]
                    yield b.filter(pa.array(clean, pa.bool_()))
        return run

    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    for _, texts in item_blocks(tests, min_chars, block_chars):
        docs = docs.mapInArrow(keep(texts), schema)
    return docs
