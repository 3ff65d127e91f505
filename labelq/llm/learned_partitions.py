"""Approximate nearest vectors by inner product, over learned partitions.

On a bounded sample a neighbour graph is built and cut into partitions of even size that few edges leave. A small
classifier learns, from a vector alone, in which partitions its neighbours lie. Every row is then indexed under the
classifier's most probable partition; a query visits the several most probable ones, and all rows there are ranked by
their exact inner products. How many partitions a query visits is measured on held-out sample rows: as few as reach
the target recall.

Partitions of many rows are cut into blocks and their queries into chunks, so a task holds one block and one chunk
whatever the number of copies of a vector.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.llm.base import query, small_batches, table
from labelq.session import materialised

K = 20
SAMPLE_ROWS = 8192  # rows the graph and the classifier are fitted on, about; all other work is on every row
PARTITIONS = 64
PARTITION_ROWS = 100  # sample rows of a partition at least; a small sample has fewer partitions
GRAPH_DEGREE = 10
SLACK = 0.1  # how far the size of a partition may be from the mean
RECALL = 0.95  # share of held-out neighbours that lie in the visited partitions
HELD_OUT = 4  # one in so many sample rows measures recall and is not learned from
HIDDEN, EPOCHS, STEP = 128, 30, 3e-3
BLOCK_BYTES = 16 << 20  # vectors of one block or chunk
SCORES = 4 << 20  # inner products held at once


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest inner products of every row with the others, as row numbers."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[lo : lo + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """A partition of the graph's nodes into ``parts`` of nearly even size that few edges cross.

    Starts from halvings at the median of the widest direction; then nodes move to the partition that holds most of
    their neighbours, those with the largest gain first, as long as sizes stay within ``SLACK`` of the mean.
    """
    own = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            own[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(order) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    ends, others = np.concatenate([source, target]), np.concatenate([target, source])
    low, high = int(len(x) / parts * (1 - SLACK)), int(len(x) / parts * (1 + SLACK)) + 1
    sizes = np.bincount(own, minlength=parts)
    for r in range(rounds):
        held = np.bincount(ends * parts + own[others], minlength=len(x) * parts).reshape(len(x), parts)
        gain = held.max(axis=1) - held[np.arange(len(x)), own]
        movers = np.flatnonzero(gain > 0)
        movers = movers[movers % 2 == r % 2]  # neighbours rarely move past each other when half of them stay
        moved = 0
        for i in movers[np.argsort(-gain[movers], kind="stable")]:
            for to in np.argsort(-held[i], kind="stable")[:3]:
                if held[i, to] <= held[i, own[i]]:
                    break
                if sizes[to] < high and sizes[own[i]] > low:
                    sizes[own[i]] -= 1
                    sizes[to] += 1
                    own[i] = to
                    moved += 1
                    break
        if moved == 0 and r % 2:
            break
    return own


class Router:
    """Vector to partitions: one hidden layer and a softmax."""

    def __init__(self, scale: float, weights: list[np.ndarray], visits: int):
        self.scale, self.weights, self.visits = scale, weights, visits

    @property
    def parts(self) -> int:
        return self.weights[3].shape[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x * self.scale).astype(np.float32) @ w1 + b1, 0) @ w2 + b2

    def order(self, x: np.ndarray) -> np.ndarray:
        """All partitions of every row, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def train(x: np.ndarray, goal: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Weights that predict the rows of ``goal`` (shares of partitions) from ``x``, by Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], goal.shape[1]
    weights = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    weights = [w.astype(np.float32) for w in weights]
    mean, square, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            w1, b1, w2, b2 = weights
            hidden = np.maximum(x[rows] @ w1 + b1, 0)
            z = hidden @ w2 + b2
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = (z / z.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (error @ w2.T) * (hidden > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                weights[i] = weights[i] - STEP * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
                weights[i] = weights[i].astype(np.float32)
    return weights


def fit(x: np.ndarray, n_rows: int, k: int = K, partitions: int = PARTITIONS, recall: float = RECALL) -> Router:
    """Partitions, classifier and number of visits from sample vectors ``x`` of a table of ``n_rows``."""
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(7).permutation(len(x))]
    scale = 1.0 / max(np.sqrt((x * x).sum(axis=1).mean() / x.shape[1]), 1e-300) if len(x) else 1.0
    scaled = (x * scale).astype(np.float32)
    test, rows = scaled[: len(x) // HELD_OUT], scaled[len(x) // HELD_OUT :]
    parts = max(1, min(partitions, len(rows) // PARTITION_ROWS))
    if parts == 1:
        return Router(scale, [np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)], 1)
    graph = neighbour_graph(rows, GRAPH_DEGREE)
    own = balanced_partitions(rows, graph, parts)
    near = np.concatenate([own[:, None], own[graph]], axis=1)
    goal = np.zeros((len(rows), parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(rows)), near.shape[1]), near.ravel()), 1.0 / near.shape[1])
    router = Router(scale, train(rows, goal), parts)
    # The k nearest of n rows are as far away, in share of rows, as the first few among the held-out rows.
    close = max(1, min(len(test) - 1, round(k * len(test) / max(n_rows, 1))))
    order = router.order(test / scale)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(test), 0), 1)
    need = np.take_along_axis(rank, order[:, 0][neighbour_graph(test, close)], 1)
    router.visits = int(np.searchsorted(np.cumsum(np.bincount(need.ravel(), minlength=parts)) / need.size, recall)) + 1
    return router


def usable(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows (id, vector) that take part: id known, vector not null, not zero, all of it finite, one row an id.

    Of rows that share an id the smallest vector stays. All vectors have one length: that of most rows (of equally
    many the larger); rows of another length take no part.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    good = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(finite).groupBy("id").agg(F.min(vector).alias("vector"))
    good = materialised(good, "vectors")
    length = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return good.where(F.size("vector") == (length["n"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _fitted(n_rows: int, k: int, partitions: int, recall: float):
    def run(sample: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([pickle.dumps(fit(_matrix(sample.column("vector")), n_rows, k, partitions, recall))], pa.binary())})
    return run


def learned(rows: DataFrame, n_rows: int, k: int, sample_rows: int, partitions: int, recall: float) -> Router:
    """The router, fitted in one task on about ``sample_rows`` rows drawn by a hash; only the model reaches the driver."""
    cut = min((1 << 63) - 1, int(min(1.0, sample_rows / max(n_rows, 1)) * 2.0**64) - (1 << 63))
    drawn = rows.where(F.xxhash64(F.lit("fit"), F.col("id")) <= cut).select("vector")
    model = drawn.groupBy(F.lit(1).alias("_one")).applyInArrow(_fitted(n_rows, k, partitions, recall), "model binary").first()
    return pickle.loads(model["model"]) if model else fit(np.zeros((0, 1)), 0)


def _homes(router: Router, width: int, out: pa.Schema):
    """The first ``width`` partitions of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = router.order(_matrix(b.column(1)))[:, :width].astype(np.int32) if b.num_rows else np.zeros((0, width), np.int32)
            last = pa.array(order[:, 0]) if width == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * width), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(out.field(1).type), last.cast(out.field(2).type)], schema=out)
    return run


def _with_homes(rows: DataFrame, router: Router, width: int, name: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    kind = T.IntegerType() if width == 1 else T.ArrayType(T.IntegerType())
    schema = T.StructType([*rows.select("id", "vector").schema.fields, T.StructField(name, kind)])
    return rows.select("id", "vector").mapInArrow(_homes(router, width, to_arrow_schema(schema)), schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two equally long matrices, summed from the first component on."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _ranked(k: int, schema: pa.Schema):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if held.num_rows == 0 or asked.num_rows == 0:
            return schema.empty_table()
        ids, x = held.column("id").to_numpy(), _matrix(held.column("vector"))
        wanted, q = asked.column("id").to_numpy(), _matrix(asked.column("vector"))
        # Matrix products may round equal vectors differently; so much apart they still count as equal here.
        room = 1e-12 * np.sqrt((x * x).sum(axis=1).max())
        found = []
        for lo in range(0, len(q), max(1, SCORES // len(x))):
            part = q[lo : lo + max(1, SCORES // len(x))]
            s = part @ x.T
            s[wanted[lo : lo + len(part), None] == ids[None, :]] = -np.inf
            if len(x) > k:
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                row, col = np.nonzero((s >= least - room * np.sqrt((part * part).sum(axis=1))[:, None]) & (s > -np.inf))
            else:
                row, col = np.nonzero(s > -np.inf)
            score = products(part[row], x[col])
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place < k
            found.append((wanted[lo + row[first]], ids[col[first]], score[first]))
        return pa.table([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, sample_rows: int = SAMPLE_ROWS, partitions: int = PARTITIONS, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query: query_id, rank, id, score.

    Both inputs have id and vector; a query's own id is no candidate. Rows and queries whose id is null or whose
    vector is null, zero, of another length or holds null or non-finite components take no part (``usable``); of
    rows that share an id one counts. Ties go to the smaller id. Scores are exact products of the vectors as given,
    in double precision. With fewer than ``k`` candidates all are returned, and as many partitions are visited as
    hold ``k`` of them. Other columns are ignored; empty inputs give no rows.
    """
    small_batches(rows.sparkSession)
    spark = rows.sparkSession
    good = usable(rows)
    n_rows = good.count()
    asked = usable(queries)
    if n_rows == 0:
        return good.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).where(F.lit(False))
    width = len(good.first()["vector"])
    asked = asked.where(F.size("vector") == width)
    router = learned(good, n_rows, k, sample_rows, partitions, recall)
    index = materialised(_with_homes(good, router, 1, "home"), "index")
    sizes = {r["home"]: r["c"] for r in index.groupBy("home").agg(F.count("*").alias("c")).collect()}  # at most ``partitions`` rows

    # Visit the chosen number of partitions, and more where those hold too few rows for k others.
    listed = F.create_map(*[F.lit(x) for h in range(router.parts) for x in (h, sizes.get(h, 0))])
    if router.parts == 1:
        routed = asked.select("id", "vector", F.lit(0).alias("home"))
    else:
        visit = F.posexplode("homes").alias("_at", "home")
        before = F.aggregate(F.slice("homes", F.lit(1), F.col("_at")), F.lit(0).cast("long"), lambda t, h: t + listed[h])
        routed = _with_homes(asked, router, router.parts, "homes").select("id", "vector", "homes", visit)
        routed = routed.where((F.col("_at") < router.visits) | (before < k + 1)).select("id", "vector", "home")
    routed = materialised(routed, "routed")
    block_rows = max(1, block_bytes // (8 * width))
    met = {r["home"]: r["c"] for r in routed.groupBy("home").agg(F.count("*").alias("c")).collect()}
    cells = spark.createDataFrame([(h, -(-c // block_rows), -(-met.get(h, 0) // block_rows)) for h, c in sizes.items()] or [(0, 0, 0)], "home int, blocks long, chunks long")
    cells = cells.where("blocks > 0 and chunks > 0")

    def dealt(side: DataFrame, own: str, other: str, count: str, others: str) -> DataFrame:
        """Rows with their own block number, once for each block of the other side."""
        joined = side.join(F.broadcast(cells), "home").withColumn(own, F.pmod(F.xxhash64("id"), F.col(count)))
        return joined.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).select("home", "block", "chunk", "id", "vector")

    held = dealt(index, "block", "chunk", "blocks", "chunks").groupBy("home", "block", "chunk")
    sent = dealt(routed, "chunk", "block", "chunks", "blocks").groupBy("home", "block", "chunk")
    kind = good.schema["id"].dataType.simpleString()
    ids = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    schema = pa.schema([("query_id", ids), ("id", ids), ("score", pa.float64())])
    found = held.cogroup(sent).applyInArrow(_ranked(k, schema), f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


@query("op13_learned_partitions")
def op13_learned_partitions(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, rows.where(F.col("id") % 20 == 0)).withColumnRenamed("id", "vec_id")
