"""What a job leaves on disk, and what it shuffles, must not be more than its steps need."""

import glob
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelloom.llm import jaccard_join
from pixelloom.llm.common import Scratch, shared_dir, stored

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {x for x in names if x.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key, None)
    counts = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).count()
    one, other = Scratch(spark, "disk").store(counts, "counts"), stored(counts.repartition("count"), "counts")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(key, None) == setting
    assert one.count() == other.count() == 1000 and {r["count"] for r in one.collect()} == {20}


def test_pipeline_keeps_the_table_of_its_last_stage_alone(spark):
    import corpus_pipeline as C

    place = shared_dir(spark).removeprefix("file:")
    tables = lambda: {x for x in glob.glob(f"{place}/**/_SUCCESS", recursive=True) if {"text", "lang"} <= set(spark.read.parquet(x.removesuffix("/_SUCCESS")).columns)}
    before = tables()
    rows = C.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert len(tables() - before) == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_shingles_met_by_sets_in_reach():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = rng.integers(1, 40, 25)
        rows = sorted((int(rng.integers(8)), int(sizes[s]), int(s)) for s in rng.integers(0, 25, 60))
        batches, at = [], 0
        while at < len(rows):
            step = int(rng.integers(0, 6))
            part = rows[at : at + step]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(3)], names=["key", "n", "sid"]))
            at += step
        got = [r for b in jaccard_join._meeting(80)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        reach = lambda a, b: 100 * min(a, b) >= 80 * max(a, b)
        assert got == sorted(r for r in set(rows) if any(r[0] == q[0] and r[2] != q[2] and reach(r[1], q[1]) for q in rows))
    assert not [r for b in jaccard_join._meeting(80)(iter([])) for r in b.to_pylist()]


def test_sets_of_sizes_out_of_reach_are_not_compared(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    rows = [(0, passage), (1, passage + words(300)), (2, words(300) + passage), (3, base := words(80)), (4, base + words(2))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    rows_of, store = {}, Scratch.store
    monkeypatch.setattr(Scratch, "store", lambda self, df, tag: (out := store(self, df, tag), rows_of.setdefault(tag, out.select("n").distinct().collect() if tag == "held" else None))[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs).collect()}
    assert got == {0: (56, 0), 1: (356, 1), 2: (356, 2), 3: (76, 3), 4: (78, 3)}
    assert 56 not in {r.n for r in rows_of["held"]} and {76, 78} <= {r.n for r in rows_of["held"]}
