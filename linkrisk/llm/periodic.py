"""Periodic run detection with string synchronising sets over words.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) that no neighbouring word extends, of at least ``max(min_length,
exponent * q)`` words; ``exponent`` is 4 or more. Every run is found:

* Periods below ``SMALL`` are found by comparing each word with the one q further.
* Scale tau = SMALL, 2 SMALL, ... serves the periods tau <= q < 2 tau. Every stretch
  of tau words has a hash. A position i is in the synchronising set when the least
  hash among positions i..i+tau stands at i or at i+tau; whether it is depends on the
  words i..i+2 tau-1 only, so equal contexts are selected alike. Positions whose tau
  words have a period of at most tau/4 do not count for the least hash: they lie in
  runs found at lower scales, and without them the set holds O(n / tau) positions.
* Successive set positions with equal context (the hash of 2 tau words) at a distance
  p with tau <= p < 2 tau propose the period p. The proposal is extended to both sides
  by comparing words p apart, and kept when it is long enough.

Why none is lost: a run of period q and 4 q words or more holds, among its first tau
positions, a set position i (otherwise its first 3 tau - 1 words would have a period
of at most tau/4 besides q). Position i + q has the same context inside the run, so it
is in the set too, and no nearer position has that context, as q is the smallest period.

Words are maximal stretches of bytes other than \\x20 and \\x09-\\x0D, compared exactly
as they stand, by 64-bit hashes. Texts are read in slices of about 1 MB, so Python
word objects exist for one slice only; a text takes about 60 bytes a word. There is no
shuffle; a document is worked on by one task, and short documents are worked on together.

Edge cases: a null or empty text has no words, no runs and an empty collapsed text.
Repeated rows and ids are independent rows. Columns of ``docs`` other than id and text are
not read, so they cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkrisk.llm.base import mix, utf8

#: Periods below this are compared directly; scales start here (a power of two).
SMALL = 8
#: Bytes of text that are turned into words, or searched, at once.
SLICE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

Run = tuple[int, int, int]


def slices(text: bytes) -> Iterator[bytes]:
    """Pieces of about SLICE bytes, cut at white space."""
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def word_values(text: bytes | None) -> np.ndarray:
    """One 64-bit value per word; equal words have equal values."""
    parts = [np.fromiter(map(hash, words), np.int64, len(words)) for words in map(bytes.split, slices(text or b""))]
    return np.concatenate(parts).view(np.uint64) if parts else np.empty(0, np.uint64)


def true_stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal stretches of True of at least ``least`` entries."""
    edge = np.diff(same.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def short_periods(x: np.ndarray, min_length: int, exponent: int) -> list[Run]:
    """Runs (start, end, period) with a period below SMALL."""
    found = []
    for q in range(1, min(SMALL, len(x))):
        need = max(min_length, exponent * q)
        for s, e in zip(*true_stretches(x[q:] == x[:-q], need - q)):
            e = int(e) + q
            smaller = [d for d in range(1, q) if q % d == 0 and np.array_equal(x[s:e - d], x[s + d:e])]
            if not smaller:
                found.append((int(s), e, q))
    return found


def synchronising_set(ids: np.ndarray, tau: int) -> np.ndarray:
    """Positions i at whose window i..i+tau the least hash stands at an end;
    hashes equal to _NONE do not count."""
    low, width = ids, 1
    while width < tau:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:-1], low[1:])
    n = len(low)
    return np.flatnonzero((low != _NONE) & ((ids[:n] == low) | (ids[tau:tau + n] == low)))


def equal_context_pairs(at: np.ndarray, context: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of successive positions with equal context, by position."""
    order = np.argsort(context[at], kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    p = b - a
    keep = (context[a] == context[b]) & (p >= tau) & (p < 2 * tau)
    a, p = a[keep], p[keep]
    by = np.argsort(a, kind="stable")
    return a[by], p[by]


def extend(x: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The maximal stretch around i whose words p apart are identical; (start, end)."""
    k, step = i, 64
    while k + p < len(x):
        top = min(len(x) - p, k + step)
        bad = np.flatnonzero(x[k:top] != x[k + p:top + p])
        if len(bad):
            k += int(bad[0])
            break
        k, step = top, step * 2
    s, step = i, 64
    while s > 0:
        low = max(0, s - step)
        bad = np.flatnonzero(x[low:s] != x[low + p:s + p])
        if len(bad):
            s = low + int(bad[-1]) + 1
            break
        s, step = low, step * 2
    return s, k + p


def find_runs(docs: list[np.ndarray], min_length: int = 6, exponent: int = 4) -> list[list[Run]]:
    """All runs (start, length, period) of each word sequence, by start, then period."""
    if exponent < 4:
        raise ValueError("the search is exact for exponents of 4 or more")
    found: list[list[Run]] = [[] for _ in docs]  # (start, end, period)
    n = np.array([len(d) for d in docs], np.int64)
    # all sequences in one array, each followed by a value of its own
    first = np.cumsum(n + 1) - (n + 1)
    x = np.empty(int((n + 1).sum()), np.uint64)
    ends = first + n
    x[ends] = mix(np.arange(1, len(docs) + 1, dtype=np.uint64)) | np.uint64(1 << 63)
    for d, f in zip(docs, first):
        x[f:f + len(d)] = d
    for s, e, q in short_periods(x, min_length, exponent):
        d = int(np.searchsorted(first, s, "right")) - 1
        found[d].append((s - int(first[d]), e - int(first[d]), q))

    alive, h, tau = np.arange(len(docs)), mix(x + np.uint64(0x9E3779B97F4A7C15)), 1
    while True:
        stay = n[alive] >= exponent * max(tau, SMALL)
        if not stay.any():
            break
        if stay.sum() < len(alive):  # sequences too short for this scale leave
            offset = np.concatenate([[0], np.cumsum(n[alive] + 1)])
            h = np.concatenate([h[offset[k]:offset[k + 1]] for k in np.flatnonzero(stay)])
            alive = alive[stay]
        wide = np.concatenate([h[tau:], mix(np.arange(tau, dtype=np.uint64) + np.uint64(tau) * np.uint64(1 << 40))])
        wide = mix(h * np.uint64(0xD1342543DE82EF95) + wide)  # hashes of 2 tau words
        if tau >= SMALL:
            offset = np.cumsum(n[alive] + 1) - (n[alive] + 1)
            search_scale(docs, found, alive, offset, h, wide, tau, max(min_length, 1), exponent)
        h, tau = wide, 2 * tau
    return [sorted((s, e - s, p) for s, e, p in runs) for runs in found]


def search_scale(docs: list, found: list, alive: np.ndarray, offset: np.ndarray, h: np.ndarray, wide: np.ndarray,
                 tau: int, min_length: int, exponent: int) -> None:
    """Add the runs with periods tau <= q < 2 tau to ``found``."""
    ids = np.minimum(h, _NONE - np.uint64(1))
    for d, o in zip(alive, offset):
        for s, e, p in found[d]:
            if 4 * p <= tau <= e - s:
                ids[o + s:o + e - tau + 1] = _NONE
    if len(ids) < 2 * tau:
        return
    at, period = equal_context_pairs(synchronising_set(ids, tau), wide, tau)
    seen: dict[tuple[int, int], int] = {}  # (sequence, period) -> end of the last stretch
    which = np.searchsorted(offset, at, "right") - 1
    for k, i, p in zip(which.tolist(), (at - offset[which]).tolist(), period.tolist()):
        d = int(alive[k])
        if i < seen.get((d, p), 0) - p:
            continue
        s, e = extend(docs[d], i, p)
        seen[d, p] = e
        if e - s >= max(min_length, exponent * p):
            found[d].append((s, e, p))


def dropped_words(runs: list[Run], n: int) -> np.ndarray:
    """Mask of the words that a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) > 0


def kept_text(text: bytes | None, runs: list[Run], n: int) -> bytes:
    """The words outside dropped parts, joined by one space."""
    drop = dropped_words(runs, n) if runs else None
    out, at = [], 0
    for words in map(bytes.split, slices(text or b"")):
        kept = words if drop is None else [w for w, gone in zip(words, drop[at:at + len(words)]) if not gone]
        at += len(words)
        if kept:
            out.append(b" ".join(kept))
    return b" ".join(out)


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _groups(texts: list) -> Iterator[list]:
    """Consecutive texts of together at most about SLICE bytes."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t or b"") > SLICE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or b"")
    if group:
        yield group


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                  exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, strongest, collapsed) of every row: all runs by start,
    then period; the run of greatest length / period (null without runs); the text
    without the words that a run repeats."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN),
                           T.StructField("collapsed", T.StringType())])

    def search(it: Iterator) -> Iterator:
        import pyarrow as pa
        run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        record = lambda r: r and dict(zip(("start", "length", "period"), r))
        for batch in it:
            at = 0
            for texts in _groups(utf8(batch.column(1))):
                words = [word_values(t) for t in texts]
                runs = find_runs(words, min_length, exponent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([[record(r) for r in rs] for rs in runs], pa.list_(run)),
                     pa.array([record(strongest(rs)) for rs in runs], run),
                     pa.array([kept_text(t, rs, len(w)).decode() for t, rs, w in zip(texts, runs, words)], pa.string())],
                    names=schema.names)
                at += len(texts)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(search, schema)


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with a periodic tail in some texts, as op11's contract prescribes.

    With h the CRC-32 of the decimal id (a null id: of no characters) and g = h // 10,
    texts of h % 10 = 0 with n > 0 words get, from word a = g % n on, the words a..a+p-1
    over and over, p = 1 + (n - a) // (3 + g % 8). Other texts are not touched, and
    never pass through Python.
    """
    code = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    schema = docs.schema

    def plant(it: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in it:
            for i, (g, t) in enumerate(zip(batch.column(2).to_pylist(), utf8(batch.column(1)))):
                words = (t or b"").split()
                if n := len(words):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    period = words[a:a + p]
                    t = b" ".join(words[:a] + (period * (-(-(n - a) // p)))[:n - a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([t and t.decode()], pa.string())], names=schema.names)

    chosen = code % 10 == 0
    hit = docs.filter(chosen).withColumn("_g", F.floor(code / 10)).mapInArrow(plant, schema)
    return docs.filter(~chosen).unionAll(hit)
