import pyarrow as pa

from linkrisk.llm import base as B


def test_slices_hold_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(B, "SLICE_BYTES", 100)
    texts = ["x" * n for n in (10, 20, 300, 40, 50, 60, 0)] + [None] * 5
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    parts = [p.column(1).to_pylist() for p in B.batches(batch, "test", 4)]
    assert sum(parts, []) == texts
    assert [len(p) for p in parts] == [2, 1, 2, 4, 3]
    assert list(B.batches(batch.slice(0, 0), "test")) == []


def test_kept_objects_go_with_the_next_operator():
    made = []
    make = lambda: made.append(1) or len(made)
    assert B.kept("one", "k", make) == B.kept("one", "k", make) == 1
    assert B.kept("two", "k", make) == 2 and B.kept("one", "k", make) == 3
    assert B.kept("one", "j", make, last=True) == 4 and B.kept("one", "k", make) == 5


def test_names_do_not_clash_in_any_case():
    assert B.name_of("row", ["ROW", "row_"]) == "row__"


def test_shuffle_files_go_with_a_stored_query(spark):
    """Nothing of the query's shuffle is left when the result is stored; the setting is as before."""
    import time
    from pathlib import Path
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = {f.name for f in local.rglob("shuffle_*.data")}
    kept = spark.conf.get(B.CLEANUP, None)
    out = B.store(spark.range(1000).groupBy((B.F.col("id") % 7).alias("k")).count(), "cleaned")
    assert len(out.collect()) == 7 and spark.conf.get(B.CLEANUP, None) == kept
    fresh = lambda: {f.name for f in local.rglob("shuffle_*.data")} - before
    for _ in range(50):
        if not fresh():
            break
        time.sleep(0.2)
    assert not fresh()
