"""Conversation structure repair by prefix-doubling path ranking.

A conversation's rows, in order, are edited so that the initials of their roles read
``(s?(ua)+)?``: nothing, or pairs of user and assistant after at most one system row.
Edits are Keep (cost 0), Rerole to user or assistant (2), Delete (3; required for blank
and duplicate rows) and Insert an empty user or assistant row anywhere (2); a truncated
row that stays adds 1. Among cheapest edit sequences, the one whose letters (K, R, D, I;
the audit) come first in ASCII order wins.

Method. Nodes are (row, state), with the states: nothing yet, after system, after user,
after assistant. A cost DP from the end gives each node's cost to go and its optimal arcs.
The nodes of this arc graph are then ranked by the first 1, 2, 4, ... letters of their
least audit: rank at 2m letters is the dense rank of the pair (rank at m letters, rank at m
letters of the node m letters on), while pointers double alike. A state leaves one legal
role for Rerole and Insert, so a node's arcs bear distinct letters, and its least arc is the
one of least letter; the doubled pointers then give the node at every offset of the path at
once, without a walk row by row.

Scale. Nothing but one letter a row is ever gathered, and never more than ``2 ** block_bits``
rows of a conversation: rows are range-partitioned by (conversation, turn, ...), numbered in
that order, and a conversation is cut into chunks at every 2^block_bits-th row of a
partition, so one that holds a third of all rows is spread over many tasks. A chunk's
effect is a 4 x 4 matrix of least costs; the few conversations of several chunks chain these
matrices backward (cost to go at each chunk's end) and, once chunks have been solved for all
four entry states, chain the exit states forward. All others are solved at once.
Duplicates come from an aggregate (least row number of each role and text) that combines
before its shuffle, joined back by row number, which no key can skew.

Order: by turn (nulls first), then role, then the text's MD5; rows equal in all are alike.

Edge cases: a null role or text counts as one space, so a null text is blank. Roles count by
their first character; an empty role has none, so a kept one adds nothing to the initials.
Null conversation ids form one conversation. Further columns are not read. An empty table
gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import store

#: Classes of a row's role initial: system, user, assistant, none, other.
INITIALS = "sua-x"
#: What a row costs besides its edit: nothing, 1 if it stays, or it must go.
SOUND, CUT, FAULTY = range(3)
STATES = 4
#: State after an inserted or reroled row; that row's role is assistant in state 2.
_NEXT = (2, 2, 3, 2)
#: State after a kept row: class -> (state -> state or None).
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "-": (0, 1, 2, 3), "x": (None,) * 4}
#: Cost to go at the end of a conversation, and the rows inserted there, by state.
END, TAIL = (0, 4, 2, 0), ("", "UA", "A", "")
_FAR = 1000  # more than any two states' costs to go can differ
WHITE = " \t\n\x0b\f\r"
#: Nodes ranked at once.
NODES = 1 << 19


# --- one step of the cost DP ------------------------------------------------

@dataclass
class Step:
    """Costs to go before a row (less ``base``), and each state's least optimal arc:
    its code and target. Codes: K keep, D delete, u/a rerole, U/A insert (the row stays
    ahead, so the target lies in the same layer)."""
    costs: tuple
    base: int
    codes: tuple
    targets: tuple


class Steps:
    """Steps by (row symbol, costs to go behind it). Costs less their least take few
    values, so each distinct step is computed once."""

    def __init__(self):
        self.index: dict[tuple, int] = {}
        self.steps: list[Step] = []

    def __call__(self, symbol: str, after: tuple) -> int:
        key = symbol, after
        if key not in self.index:
            self.index[key] = len(self.steps)
            self.steps.append(self.compute(symbol, after))
        return self.index[key]

    @staticmethod
    def compute(symbol: str, after: tuple) -> Step:
        initial, kind = unpack(symbol)
        arcs = []  # per state: (cost to go, letter, code, target state), without inserts
        for q in range(STATES):
            out = [(after[q] + 3, "D", "D", q)]
            if kind != FAULTY:
                keep, stays = _KEEP[initial][q], int(kind == CUT)
                if keep is not None:
                    out.append((after[keep] + stays, "K", "K", keep))
                out.append((after[_NEXT[q]] + 2 + stays, "R", "a" if q == 2 else "u", _NEXT[q]))
            arcs.append(out)
        costs = [min(out)[0] for out in arcs]
        for _ in range(STATES):
            costs = [min(c, 2 + costs[_NEXT[q]]) for q, c in enumerate(costs)]
        least = []
        for q, out in enumerate(arcs):
            optimal = [x for x in out if x[0] == costs[q]]
            if costs[q] == 2 + costs[_NEXT[q]]:
                optimal.append((costs[q], "I", "A" if q == 2 else "U", _NEXT[q]))
            least.append(min(optimal, key=lambda x: x[1]))
        base = min(costs)
        return Step(tuple(min(c - base, _FAR) for c in costs), base, tuple(x[2] for x in least), tuple(x[3] for x in least))


def symbol_of(initial: str, kind: int) -> str:
    return chr(97 + 3 * INITIALS.index(initial) + kind)


def unpack(symbol: str) -> tuple[str, int]:
    k = ord(symbol) - 97
    return INITIALS[k // 3], k % 3


_STEPS = Steps()


def backward(symbols: str, after: tuple) -> tuple[list[int], tuple, int]:
    """Step numbers from the last row to the first, and the costs to go before the
    first row, as (relative costs, base)."""
    base = min(after)
    costs, numbers = tuple(min(c - base, _FAR) for c in after), []
    for s in reversed(symbols):
        k = _STEPS(s, costs)
        numbers.append(k)
        costs, base = _STEPS.steps[k].costs, base + _STEPS.steps[k].base
    return numbers, costs, base


def matrix(symbols: str) -> list[int]:
    """Least cost from each state before a chunk (row) to each one behind it (column)."""
    columns = []
    for r in range(STATES):
        _, costs, base = backward(symbols, tuple(0 if q == r else _FAR for q in range(STATES)))
        columns.append([c + base if c < _FAR else 1 << 40 for c in costs])
    return [columns[r][q] for q in range(STATES) for r in range(STATES)]


# --- ranks and paths --------------------------------------------------------

def rank_paths(letter: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Ranks of nodes by their least audits, doubled pointers, and audit lengths.

    ``letter``: code of each node's least letter, 0 at end nodes, which point to themselves.
    """
    rank, jump, length, pointers = letter.astype(np.int64), to, (letter > 0).astype(np.int64), []
    while True:
        pointers.append(jump)
        if not (letter[jump] > 0).any():
            break
        pair = rank * (int(rank.max()) + 1) + rank[jump]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length = length + length[jump]
        jump = jump[jump]
    return rank, pointers, length


def path_nodes(start: np.ndarray, length: np.ndarray, pointers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the paths from ``start``, one path behind the other, and the path's number
    at each: the node at an offset follows the pointers of the offset's binary digits."""
    path = np.repeat(np.arange(len(start)), length)
    offset = np.arange(len(path)) - np.repeat(np.cumsum(length) - length, length)
    node = start[path]
    for k, jump in enumerate(pointers):
        on = (offset >> k) & 1 == 1
        node[on] = jump[node[on]]
    return node, path


def solve(chunks: list[tuple[str, tuple, bool]], entries: tuple = (0,)) -> list[tuple[list[str], list[int], list[int]]]:
    """Per chunk (symbols, costs to go behind it, whether it is the last) and entry state:
    edit codes, exit state, cost to go."""
    out = []
    group, size = [], 0
    for c in chunks:
        group.append(c)
        size += STATES * (len(c[0]) + 1)
        if size > NODES:
            out += _solve(group, entries)
            group, size = [], 0
    return out + (_solve(group, entries) if group else [])


def _solve(chunks: list, entries: tuple) -> list:
    layers, costs = [], []
    for symbols, after, _ in chunks:
        numbers, rel, base = backward(symbols, tuple(after))
        layers += numbers[::-1] + [-1]
        costs.append([c + base for c in rel])
    layer = np.array(layers, np.int64)
    steps = _STEPS.steps
    codes = np.array([[ord(c) for c in s.codes] for s in steps] + [[0] * STATES], np.int64)
    states = np.array([s.targets for s in steps] + [list(range(STATES))], np.int64)
    code = codes[layer]
    # inserts stay in their layer, other edits lead to the next; end nodes to themselves
    ahead = (code != 0) & ~np.isin(code, [ord("U"), ord("A")])
    to = ((np.arange(len(layer))[:, None] + ahead) * STATES + states[layer]).ravel()
    letters = np.zeros(128, np.int64)
    for letter, same in (("D", "D"), ("I", "UA"), ("K", "K"), ("R", "ua")):
        letters[[ord(c) for c in same]] = ord(letter)
    code = code.ravel()
    _, pointers, length = rank_paths(letters[code], to)
    n = np.array([len(c[0]) + 1 for c in chunks])
    first = np.cumsum(n) - n
    start = (first[:, None] * STATES + np.array(entries)).ravel()
    node, path = path_nodes(start, length[start], pointers)
    text = code[node].astype(np.uint8).tobytes().decode("ascii")
    ends = np.cumsum(length[start]).tolist()
    last = start.copy()
    for k, jump in enumerate(pointers):
        on = (length[start] >> k) & 1 == 1
        last[on] = jump[last[on]]
    exits, out, at = (last % STATES).tolist(), [], 0
    for k, (_, _, final) in enumerate(chunks):
        found = []
        for e in range(len(entries)):
            end, state = ends[k * len(entries) + e], exits[k * len(entries) + e]
            found.append((text[at:end] + (TAIL[state] if final else ""), state, costs[k][entries[e]]))
            at = end
        out.append(tuple(map(list, zip(*found))))
    return out


# --- Spark jobs ---------------------------------------------------------------

def ordered_rows(rows: DataFrame) -> DataFrame:
    """Stored rows (conv_id, turn, role, text, row, initial, fault): ``row`` ascends in a
    conversation, and by one within a partition; fault: blank, duplicate, truncated or null."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("digest", F.md5("text")).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    rows = store(rows.drop("salt").select(
        "*", F.when(initial.isin("s", "u", "a"), initial).when(initial == "", "-").otherwise("x").alias("initial"),
        (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("truncated")), "turns")
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return store(rows.join(first, "row", "left").select("conv_id", "turn", "role", "text", "row", "initial",
                                                        fault.alias("fault")), "turns-judged")


def chunk_rows(rows: DataFrame, block_bits: int) -> DataFrame:
    """Stored chunks (conv_id, first_row, symbols) of at most 2^block_bits rows."""
    kind = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", CUT).otherwise(FAULTY)
    symbol = F.char(97 + 3 * (F.instr(F.lit(INITIALS), F.col("initial")) - 1) + kind)
    chunks = rows.select("conv_id", "row", symbol.alias("symbol"), F.shiftright("row", block_bits).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("row", "symbol")))
    return store(chunks.groupBy("conv_id", "block").agg(ordered.alias("x")).select(
        "conv_id", F.col("x")[0]["row"].alias("first_row"), F.array_join(F.col("x")["symbol"], "").alias("symbols")), "chunks")


def illegal_pairs(chunks: DataFrame) -> DataFrame:
    """(conv_id, illegal): neighbouring rows whose initials are not su, ua or au; pairs
    inside chunks, and pairs of a chunk's last with the next one's first row."""
    cls = lambda s: F.floor((F.ascii(s) - 97) / 3)
    bad = lambda a, b: (~(cls(a) * 5 + cls(b)).isin(*[5 * INITIALS.index(p[0]) + INITIALS.index(p[1])
                                                     for p in ("su", "ua", "au")])).cast("long")
    letters = F.split("letters", "")
    inner = chunks.withColumn("letters", F.col("symbols")).select(
        "conv_id", "first_row", F.substring("symbols", 1, 1).alias("a"), F.right("symbols", F.lit(1)).alias("z"),
        F.aggregate(F.zip_with(F.slice(letters, 1, F.length("letters") - 1), F.slice(letters, 2, F.length("letters")), bad),
                    F.lit(0).cast("long"), lambda s, x: s + x).alias("inside"))
    c = F.array_sort(F.collect_list(F.struct("first_row", "a", "z")))
    between = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda x, y: bad(x["z"], y["a"]))
    return inner.groupBy("conv_id").agg(F.sum("inside").alias("inside"), c.alias("c")).select(
        "conv_id", (F.col("inside") + F.aggregate(between, F.lit(0).cast("long"), lambda s, x: s + x)).alias("illegal"))


SOLVED = "conv_id {0}, first_row long, codes array<string>, exits array<long>, costs array<long>"


def _solver(entries: tuple):
    def run(it: Iterator) -> Iterator:
        for pdf in it:
            done = solve([(s, tuple(a), bool(f)) for s, a, f in zip(pdf["symbols"], pdf["after"], pdf["final"])], entries)
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "first_row": pdf["first_row"], "codes": [x[0] for x in done],
                                "exits": [x[1] for x in done], "costs": [x[2] for x in done]})
    return run


def _matrices(it: Iterator) -> Iterator:
    for pdf in it:
        yield pd.DataFrame({"conv_id": pdf["conv_id"], "first_row": pdf["first_row"],
                            "matrix": [matrix(s) for s in pdf["symbols"]]})


def _chain_back(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind each chunk of one conversation."""
    pdf = pdf.sort_values("first_row")
    after, out = list(END), []
    for m in reversed(pdf["matrix"].tolist()):
        out.append(after)
        m = np.asarray(m).reshape(STATES, STATES)
        after = (m + np.asarray(after)).min(axis=1).tolist()
    return pd.DataFrame({"first_row": pdf["first_row"], "after": out[::-1], "final": [False] * (len(out) - 1) + [True]})


def _chain_forward(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry state of each chunk of one conversation."""
    pdf = pdf.sort_values("first_row")
    entry, out = 0, []
    for exits in pdf["exits"]:
        out.append(entry)
        entry = int(exits[entry])
    return pd.DataFrame({"first_row": pdf["first_row"], "entry": out})


def solve_chunks(chunks: DataFrame) -> DataFrame:
    """Stored (conv_id, first_row, code, cost) of every chunk: its edit codes on the least
    path, and the cost to go where it starts."""
    schema = SOLVED.format(chunks.schema["conv_id"].dataType.simpleString())
    many = chunks.groupBy("conv_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("conv_id").alias("id"))
    same = chunks["conv_id"].eqNullSafe(many["id"])
    whole = chunks.join(many, same, "left_anti").withColumn("after", F.array(*map(F.lit, END))).withColumn("final", F.lit(True))
    whole = whole.mapInPandas(_solver((0,)), schema).select(
        "conv_id", "first_row", F.col("codes")[0].alias("code"), F.col("costs")[0].alias("cost"))

    parts = store(chunks.join(many, same, "left_semi"), "chunks-split")
    matrices = parts.mapInPandas(_matrices, f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, first_row long, "
                                 "matrix array<long>")
    after = matrices.groupBy("conv_id").applyInPandas(_chain_back, "first_row long, after array<long>, final boolean")
    solved = store(parts.join(after, "first_row").select("conv_id", "first_row", "symbols", "after", "final")
                   .mapInPandas(_solver(tuple(range(STATES))), schema), "chunks-solved")
    entry = solved.select("conv_id", "first_row", "exits").groupBy("conv_id").applyInPandas(
        _chain_forward, "first_row long, entry long")
    at = F.col("entry").cast("int") + 1
    split = solved.join(entry, "first_row").select("conv_id", "first_row", F.element_at("codes", at).alias("code"),
                                                   F.element_at("costs", at).alias("cost"))
    return store(whole.unionAll(split), "chunks-edited")


@dataclass
class Repair:
    """Results of ``repair``; all stored.

    report: one row a conversation: conv_id, gaps (turns missing between the least and the
    greatest), blank, duplicate, truncated (rows by first fault), illegal (neighbouring
    initials), cost.
    chunks: conv_id, first_row, code; the codes of a conversation, by first_row, are its
    edits: K keep, D delete, u or a rerole, U or A insert.
    rows: the row-level source of ``repaired_rows``.
    """
    report: DataFrame
    chunks: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame, block_bits: int = 14) -> Repair:
    """Repair all conversations of (conv_id, turn, role, text)."""
    rows = ordered_rows(conversations)
    chunks = chunk_rows(rows, block_bits)
    edited = solve_chunks(chunks)
    counts = rows.groupBy("conv_id").agg(
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("turns"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    cost = edited.groupBy("conv_id").agg(F.min_by("cost", "first_row").alias("cost"))
    bad = illegal_pairs(chunks)
    report = counts.join(cost.withColumnRenamed("conv_id", "c1"), F.col("conv_id").eqNullSafe(F.col("c1"))).join(
        bad.withColumnRenamed("conv_id", "c2"), F.col("conv_id").eqNullSafe(F.col("c2")))
    gaps = F.coalesce(F.col("hi").cast("long") - F.col("lo").cast("long") + 1 - F.col("turns"), F.lit(0))
    return Repair(report.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                                "cost"), edited, rows)


def repaired_rows(done: Repair) -> DataFrame:
    """(conv_id, row, step, edit, role, text) of every row that is left or inserted; sorted
    by (row, step), a conversation reads as repaired."""
    per_row = F.posexplode(F.regexp_extract_all("code", F.lit("[UA]*[KDua](?:[UA]+$)?"), F.lit(0))).alias("at", "ops")
    edits = done.chunks.select("first_row", per_row).select((F.col("first_row") + F.col("at")).alias("row"), "ops")
    out = done.rows.join(edits, "row").select("conv_id", "row", F.posexplode(F.split("ops", "")).alias("step", "op"),
                                              F.col("role").alias("r"), F.col("text").alias("t")).filter("op not in ('D', '')")
    role = F.when(F.col("op") == "K", F.col("r")).when(F.lower("op") == "u", "user").otherwise("assistant")
    return out.select("conv_id", "row", "step", F.translate("op", "uaUA", "RRII").alias("edit"), role.alias("role"),
                      F.when(F.col("op").isin("U", "A"), "").otherwise(F.col("t")).alias("text"))


def audits(done: Repair) -> DataFrame:
    """(conv_id, audit): the letters of all edits."""
    parts = F.array_sort(F.collect_list(F.struct("first_row", F.translate("code", "uaUA", "RRII").alias("x"))))
    return done.chunks.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join(F.col("p")["x"], "").alias("audit"))


def sequence_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, digest): SHA-256 of each conversation's repaired ``role:text`` lines. A
    digest is one sequential computation, so the sorted rows stream through it; no
    conversation is held as a whole."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def digest(it: Iterator) -> Iterator:
        import pyarrow as pa
        current, sha = None, None
        for batch in it:
            ids, digests = [], []
            lines = [x.encode() for x in batch.column(1).to_pylist()]
            for k, line in zip(batch.column(0).to_pylist(), lines):
                if sha is None or k != current:
                    if sha is not None:
                        ids.append(current)
                        digests.append(sha.hexdigest())
                    current, sha = k, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(digests, pa.string())],
                                             names=["conv_id", "digest"])
            kind = batch.schema.field(0).type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([sha.hexdigest()], pa.string())],
                                             names=["conv_id", "digest"])

    line = F.concat("role", F.lit(":"), "text")
    ordered = rows.select("conv_id", line.alias("line"), "row", "step").repartition("conv_id").sortWithinPartitions(
        "conv_id", "row", "step")
    return ordered.select("conv_id", "line").mapInArrow(digest, f"conv_id {id_type}, digest string")


# --- the contract's damage -----------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults that op13's contract prescribes: by the CRC-32 of
    ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 sets its role to user. Nulls count as one space in key, role and text."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    out = conversations.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return out.filter("_kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
