import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.operators import margin, neighbours


def points(n, d, seed, copies=0, groups=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d)) * 3
    label = rng.integers(0, groups, n)
    x = centre[label] + rng.normal(size=(n, d))
    if copies:  # a hot set of identical vectors holding a third of the rows
        x[:copies] = x[0]
        label[:copies] = label[0]
    return x, label


def table(spark, x, label, first=0):
    rows = [(int(i + first), [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(4)


def distances(x, y, metric):
    if metric == "cosine":
        return 1 - (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    if metric == "inner":
        return -(x @ y.T)
    diff = x[:, None, :] - y[None, :, :]
    return np.abs(diff).sum(2) if metric == "cityblock" else np.sqrt((diff ** 2).sum(2))


def brute(dist, qid, did, k, allowed=None):
    out = {}
    for i in range(len(qid)):
        rows = [(round(float(dist[i, j]), 9), int(did[j])) for j in range(len(did))
                if did[j] != qid[i] and (allowed is None or allowed[i, j])]
        out[int(qid[i])] = [r[1] for r in sorted(rows)[:k]]
    return out


def collected(df):
    got = df.toPandas().sort_values(["id", "rank"])
    return {int(i): [int(v) for v in g["nbr_id"]] for i, g in got.groupby("id")}


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "cityblock", "inner"])
@pytest.mark.parametrize("copies", [0, 100])
def test_knn_matches_brute_force_with_small_blocks(spark, metric, copies):
    x, label = points(300, 5, 3, copies)
    df = table(spark, x, label)
    got = collected(neighbours.knn(df, df, 4, metric, block_rows=20, chunk_rows=16))
    want = brute(distances(x, x, metric), np.arange(300), np.arange(300), 4)
    assert got == want


def test_knn_within_groups_and_two_tables(spark):
    x, label = points(240, 4, 5)
    q, d = table(spark, x[:80], label[:80]), table(spark, x[80:], label[80:], first=80)
    got = collected(neighbours.knn(q, d, 3, "euclidean", "label", "label", block_rows=15, chunk_rows=16))
    allowed = label[:80, None] == label[None, 80:]
    want = brute(distances(x[:80], x[80:], "euclidean"), np.arange(80), np.arange(80, 240), 3, allowed)
    assert got == want


def test_chunks_meet_few_nodes_on_clusters(spark):
    """With separated clusters a chunk is shipped to well under half of the nodes, once to each."""
    x, label = points(600, 3, 7, groups=6)
    x = x + label[:, None] * 50.0
    df = table(spark, x, label)
    geo = neighbours.Geometry("euclidean")
    rows = neighbours.prepared(df, "euclidean", None).cache()
    tree = neighbours.build(rows, geo, 20)
    assert tree.n_nodes > 15 and len(tree.pivots) == 6
    chunks = neighbours.chunks_of(rows, tree, 16)
    assert sorted(i for r in chunks.select("ids").collect() for i in r["ids"]) == list(range(600))
    state = chunks.withColumn("limit", F.lit(5.0))
    visits = neighbours.pairs(state, tree)
    assert visits.count() == visits.select("chunk", "grp", "top", "node", "part").distinct().count()
    assert visits.count() < 0.4 * chunks.count() * tree.n_blocks
    got = collected(neighbours.knn(df, df, 3, "euclidean", block_rows=20, chunk_rows=16))
    assert got == brute(distances(x, x, "euclidean"), np.arange(600), np.arange(600), 3)


def test_number_of_nodes_grows_with_the_data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1600, 3))
    rows = neighbours.prepared(table(spark, x, np.zeros(1600, int)), "euclidean", None)
    small = neighbours.build(rows.filter("id < 200").cache(), neighbours.Geometry("euclidean"), 25)
    large = neighbours.build(rows.cache(), neighbours.Geometry("euclidean"), 25)
    assert large.n_nodes > 4 * small.n_nodes
    assert large.blocks.agg(F.max(F.size("ids"))).first()[0] <= 75


def test_gradient_product_matches_brute_force(spark):
    x, label = points(150, 4, 13)
    rng = np.random.default_rng(4)
    probs = rng.dirichlet(np.ones(3), 150)
    rows = [(i, [float(v) for v in x[i]], int(label[i]), [float(v) for v in probs[i]], int(probs[i].argmax())) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int, probs array<double>, pred int")
    got = collected(margin.by_gradient(df.filter("id < 40"), df.filter("id >= 40"), 3, block_rows=12, chunk_rows=8))
    g = np.eye(3)[label] - probs
    dist = -(g @ g.T) * (x @ x.T + 1)
    allowed = probs.argmax(1)[:40, None] == label[None, 40:]
    assert got == brute(dist[:40, 40:], np.arange(40), np.arange(40, 150), 3, allowed)


def test_empty_tables(spark):
    x, label = points(20, 3, 1)
    df = table(spark, x, label)
    none = df.filter("id < 0")
    assert neighbours.knn(none, df, 2).count() == 0
    assert neighbours.knn(df, none, 2).count() == 0
    assert neighbours.knn(df, none, 2, "inner").count() == 0
    assert neighbours.diameter(none) == 0.0


def test_diameter(spark):
    x, label = points(200, 4, 9)
    got = neighbours.diameter(table(spark, x, label), block_rows=30, chunk_rows=16)
    assert abs(got - distances(x, x, "euclidean").max()) < 1e-9


def test_diameter_meets_few_blocks(spark):
    x, label = points(600, 3, 7, groups=6)
    x = x + label[:, None] * 50.0
    known, tree, chunks, todo = neighbours.far_pairs(table(spark, x, label), block_rows=20, chunk_rows=16)
    assert todo.count() < 0.2 * chunks.count() * tree.n_blocks
    assert abs(neighbours.diameter(table(spark, x, label), block_rows=20, chunk_rows=16) - distances(x, x, "euclidean").max()) < 1e-9


def test_radius_search_counts_and_falls_back(spark):
    x, label = points(200, 3, 11)
    rng = np.random.default_rng(2)
    probs = rng.dirichlet(np.ones(3), 200)
    rows = [(i, [float(v) for v in x[i]], int(label[i]), [float(v) for v in probs[i]], int(probs[i].argmax())) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int, probs array<double>, pred int")
    s, t = df.filter("id < 50"), df.filter("id >= 50")
    share = 0.12
    got = margin.within_radius(s, t, share, block_rows=25, chunk_rows=16).toPandas().set_index("id")
    dist = distances(x, x, "euclidean")
    radius = share * dist.max()
    g = np.eye(3)[label] - probs
    score = np.round((g @ g.T) * (x @ x.T + 1), 9)
    for i in range(50):
        cand = [j for j in range(50, 200) if label[j] == probs[i].argmax()]
        near = [j for j in cand if dist[i, j] <= radius]
        want = max(near, key=lambda j: (score[i, j], -j)) if near else min(cand, key=lambda j: (round(dist[i, j], 9), j))
        assert (got.loc[i, "n_within"], got.loc[i, "nbr_id"]) == (len(near), want)


def test_unknown_group_gives_no_rows(spark):
    x, label = points(40, 3, 1)
    q = table(spark, x[:5], np.full(5, 99))
    d = table(spark, x[5:], label[5:], first=5)
    assert neighbours.knn(q, d, 2, "euclidean", "label", "label").count() == 0


def test_no_copy_of_the_vectors_is_left(spark):
    """A search leaves its result in the shared folder and no copy of the vectors, at any number of blocks."""
    import glob
    import os

    from labelq.session import mounted, scratch_path

    x = np.random.default_rng(8).normal(size=(3000, 64))
    df = table(spark, x, np.zeros(3000, int)).cache()
    df.count()
    folder = mounted(spark, scratch_path(spark, "x").rsplit("/", 1)[0])
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(f))
    before = size()
    got = neighbours.knn(df, df, 3, block_rows=256, chunk_rows=256)
    assert got.count() == 9000
    assert size() - before < 0.5 * x.nbytes


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_packed_search_and_tree_agree(spark, monkeypatch, metric):
    """Ids that are text or come twice, null labels, hot copies: both ways give the same rows."""
    x, label = points(180, 4, 21, copies=40)
    rows = [(f"r{i % 170}", [float(v) for v in x[i]], None if i % 9 == 0 else int(label[i])) for i in range(180)]
    df = spark.createDataFrame(rows, "id string, features array<double>, label int").repartition(3)
    asked = df.filter("id < 'r3'")
    got = lambda: [sorted(tuple(r) for r in neighbours.knn(q, df, 3, metric, block_rows=20, chunk_rows=16).drop("nbr_label", "label").collect()) for q in (df, asked)]
    packed = got()
    monkeypatch.setattr(neighbours, "mounted", lambda *_: None)
    assert got() == packed


def test_index_is_searched_again(spark):
    x, label = points(200, 4, 17)
    df = table(spark, x, label)
    packed = neighbours.index(df, 6)
    want = brute(distances(x, x, "cosine"), np.arange(200), np.arange(200), 5)
    assert collected(neighbours.knn(df, packed, 5)) == want
    assert collected(neighbours.knn(df.filter("id < 20"), packed, 5)) == {i: want[i] for i in range(20)}
    with pytest.raises(ValueError):
        neighbours.knn(df, packed, 6)
