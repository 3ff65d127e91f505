"""What the pipeline's stages hold in a worker, and how many files and workers they need."""

import glob
import tracemalloc

import numpy as np
import pyarrow as pa

from labelq.llm import jaccard_join, language_id
from labelq.llm import signatures as S
from labelq.llm.components import components
from labelq.llm.shingle_sets import shingle_sets


def test_trees_of_near_copies_are_not_held_as_pairs():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    trees, rows = 4, 700
    sets = [np.sort(np.concatenate([base, rng.integers(0, 1 << 63, 2).astype(np.uint64)])) for _ in range(rows)]
    one = {"token": pa.array([0] * rows, pa.int64()), "part": pa.array([0] * rows, pa.int32()), "side": pa.array([0] * rows, pa.int32()), "id": pa.array(range(rows), pa.int64()),
           "n": pa.array([len(s) for s in sets], pa.int32()), "m": pa.array([len(s) for s in sets], pa.int32()),
           "first": pa.array([int(s[0]) for s in sets], pa.int64()), "sig": pa.array([S.bitmap(s, 2 * len(s)) for s in sets], pa.binary())}
    given = [pa.RecordBatch.from_pydict({**one, "token": pa.array([t] * rows, pa.int64()), "id": pa.array(range(t * rows, (t + 1) * rows), pa.int64())}) for t in range(trees)]
    tracemalloc.start()
    found = [p for b in jaccard_join._candidate_forest(80)(iter(given)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    joined = jaccard_join._Joined()
    assert len(found) == trees * (rows - 1) and all(joined.join(*p) for p in found)
    assert {joined.root(i) for i in range(trees * rows)} == {t * rows for t in range(trees)}
    assert most < 64 << 20, most  # all pairs of the four trees at once were over 100 MB


def test_words_of_a_few_texts_are_held_at_once():
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(400)) for i in range(500)])
    tracemalloc.start()
    sizes = [len(s) for s in shingle_sets(texts, 5)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [396] * 500
    assert most < 16 << 20, most


def test_rounds_of_few_edges_are_few_files(spark, tmp_path, monkeypatch):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr("labelq.session.scratch_path", lambda _, name: f"{tmp_path}/{name}-{len(glob.glob(f'{tmp_path}/*'))}")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(4000).selectExpr("id as a", "id + 1 - id % 2 as b")
        got = components(edges).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.id, r.component) for r in got} == {(i, i - i % 2) for i in range(4000)}
    rounds = sorted(glob.glob(f"{tmp_path}/edges-*"))[1:]
    assert rounds and all(len(glob.glob(f"{x}/part-*")) <= max(1, spark.sparkContext.defaultParallelism) for x in rounds)


def test_cuts_of_languages_need_no_python_worker(spark):
    labelled = spark.createDataFrame([(i, f"text {i}", "en" if i % 2 else "de") for i in range(50)], "doc_id long, text string, lang string")
    labelled = spark.createDataFrame(labelled.toArrow())
    drawn = language_id._drawn(labelled, 10, 5)
    assert "ExistingRDD" not in drawn._jdf.queryExecution().executedPlan().toString()  # rows that Python workers unpickle
    assert {r.lang for r in drawn.collect()} == {"en", "de"}
