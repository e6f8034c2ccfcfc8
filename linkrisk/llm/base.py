"""Helpers shared by the operators of this subpackage.

* ``store`` cuts lineage: a frame is written as Parquet into the shared folder
  of ``spark.checkpoint.dir`` and reread, so a lost executor costs at most the
  tasks of one step.
* ``word_hashes`` turns UTF-8 texts into 64-bit word hashes with numpy; words
  are never Python objects, so one core hashes tens of megabytes a second.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a local session (tests) gets a
    folder of its own; any other session is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile
        root = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends. Otherwise they stay until the
#: driver's garbage collector finds that nothing refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and reread it. The shuffle files of the
    query go with its end; those behind a persisted frame stay with that frame."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is not to be broadcast, whichever size Spark takes it for. It
    goes by the bytes of stored files, which tell little of their rows (numbers in sequence
    take next to none) and nothing of what a generator makes of them; and what is broadcast
    passes through the driver. For tables that grow with the input."""
    return df.hint("merge")


def lower_ascii(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- word hashing ---------------------------------------------------------

#: Bytes that end a word: ASCII white space \x20 and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: The same, and all ASCII bytes that are neither letters nor digits.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once; bounds memory (about 40 bytes per input byte).
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_W = _weights(256)


def _hash_chunk(data: np.ndarray, ends_word: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Word start offsets, lengths and hashes of one byte chunk; the hashes of
    the words' first k bytes for each k of ``prefixes`` (0 for shorter words)."""
    data = _LOWER[data]
    gap = ends_word[data]
    before = np.empty_like(gap)
    before[:1] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & before)
    if not len(starts):
        none = np.empty(0, np.uint64)
        return starts, starts, none, [none for _ in prefixes]
    first = starts[0]
    span = np.diff(starts, append=len(data))
    pos = np.arange(first, len(data)) - np.repeat(starts, span)
    top = int(pos.max()) + 1
    w = _W if top <= len(_W) else _weights(top)
    part = (data[first:].astype(np.uint64) + np.uint64(1)) * w[pos]
    part[gap[first:]] = 0
    lens = np.add.reduceat(~gap[first:], starts - first, dtype=np.int64)
    h = mix(np.add.reduceat(part, starts - first))
    pre = []
    for k in prefixes:
        p = mix(np.add.reduceat(np.where(pos < k, part, np.uint64(0)), starts - first) + np.uint64(k))
        pre.append(np.where(lens >= k, p, np.uint64(0)))
    return starts, lens, h, pre


def word_hashes(texts: list, ends_word: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()):
    """Hashes of the A-Z-lowered words of each text.

    texts: UTF-8 ``bytes`` or None. Returns (doc index per word, hash per word,
    list of prefix hashes). Long texts are hashed in chunks cut between words.
    """
    docs, hashes, pres = [], [], [[] for _ in prefixes]

    def flush(run: list, at: list) -> None:
        if not run:
            return
        data = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
        offs = np.cumsum([0] + [len(x) + 1 for x in run])
        starts, _, h, pre = _hash_chunk(data, ends_word, prefixes)
        docs.append(np.asarray(at, np.int64)[np.searchsorted(offs, starts, "right") - 1])
        hashes.append(h)
        for out, p in zip(pres, pre):
            out.append(p)

    run, at, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        while len(t) > CHUNK:  # cut behind the last white space of the chunk
            flush(run, at)
            run, at, size = [], [], 0
            cut = max(t.rfind(b" ", 0, CHUNK), t.rfind(b"\n", 0, CHUNK))
            if cut <= 0:
                gaps = ends_word[np.frombuffer(t, np.uint8)]
                nxt = np.flatnonzero(gaps)
                if not len(nxt):
                    break
                cut = int(nxt[np.searchsorted(nxt, CHUNK)]) if nxt[-1] >= CHUNK else int(nxt[-1])
            flush([t[:cut + 1]], [i])
            t = t[cut + 1:]
        run.append(t)
        at.append(i)
        size += len(t) + 1
        if size > CHUNK:
            flush(run, at)
            run, at, size = [], [], 0
    flush(run, at)
    empty = np.empty(0, np.uint64)
    cat = lambda xs: np.concatenate(xs) if xs else empty
    return (np.concatenate(docs) if docs else np.empty(0, np.int64)), cat(hashes), [cat(p) for p in pres]


def utf8(column) -> list:
    """Values of an Arrow string column as ``bytes`` (None stays None)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    return pc.cast(column, pa.large_binary()).to_pylist()


#: Bytes of text in a slice of a record batch (a longer text is a slice of its own).
SLICE_BYTES = 8 << 20
_KEPT: dict = {}
_KEEPER = [""]


def _release(owner: str) -> None:
    """Drop what another operator has left in this (reused) worker process, and give its
    memory back to the system."""
    if _KEEPER[0] == owner:
        return
    import ctypes
    import gc

    import pyarrow as pa
    _KEPT.clear()
    _KEEPER[0] = owner
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def kept(owner: str, key, make, last: bool = False):
    """``make()``, kept in the worker process for later tasks until another operator runs
    there; with ``last``, only the last key's is."""
    _release(owner)
    if key not in _KEPT:
        if last:
            _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def batches(batch, owner: str, rows: int = 1000):
    """Slices of an Arrow record batch of at most so many rows and SLICE_BYTES of text (or one
    row). ``owner`` names the operator: what others keep in this process goes first."""
    import pyarrow as pa
    import pyarrow.compute as pc
    _release(owner)
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


def name_of(base: str, taken) -> str:
    """``base``, with underscores added until it clashes with no given column (Spark
    does not tell upper and lower case in names apart)."""
    lower = {t.lower() for t in taken}
    while base.lower() in lower:
        base += "_"
    return base


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, whatever characters their names hold."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])
