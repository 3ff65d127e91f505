"""Exact nearest neighbours by packed blocks, bounds and, where needed, a tree of pivots.

No pair table is ever formed. ``knn`` packs the rows where they are read: a task writes blocks of near vectors into a
file of the shared folder, with a centre and a radius each. That is the only copy of the vectors. A chunk of queries (of
a table searched in itself: a block) then meets the blocks by rising least distance, read from those files, and stops
where nothing nearer can follow. Nothing is shuffled but names of chunks, and only k rows per query are written.

Where tasks cannot open the shared folder themselves, and for ``within_radius`` and ``far_pairs``, rows are dealt to about sqrt(N / block) top pivots and, inside each, to pivots
drawn from its own rows, so nodes grow in number and not in size when the data grow. Of a node only its pivot,
a count and a distance range are kept; its rows are packed into blocks. Queries go down the same tree and are
packed into chunks of near queries with a centre and a radius. A chunk first meets one block of its own node,
which bounds the k-th distance of each of its queries; then it is shipped, once per node, to the few nearest
nodes, and with the bounds found there to all others that can still hold something nearer. A task compares
one block with some chunks and returns at most k rows per query, and none beyond the bound it came with.

Metrics: ``cosine`` (1 - cos), ``euclidean``, ``cityblock``, ``inner`` (minus the inner product) and
``product`` (minus the product of two inner products). The last two become distances by one more coordinate
that gives all data the same length; a product of two vectors is never written out.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelq.functions import arrays, rand
from labelq.session import materialised, mounted, scratch_path

BLOCK_ROWS = 4096
CHUNK_ROWS = 512      # queries shipped together
TASK_CHUNKS = 16      # chunks one task compares with a block
NEXT_NODES = 4        # nodes visited before the bounds are taken again
SALT_ROWS = 65536     # rows of one top cell that a task deals to its nodes
DIGITS = 9
SLACK = 1e-9
NODE = ["grp", "top", "node"]
OFTEN = 10_000        # hashes of vectors with too many copies that are looked up by a broadcast table
PACK_BYTES = 32 << 20  # of vectors that a task puts in order at once
SEARCH_CHUNKS = 4     # chunks that a task searches one after another


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 0))


def _cityblock(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|x-y|_1 in slices of x, so that the differences held at once stay bounded."""
    step = max(1, 4_000_000 // max(1, y.size))
    return np.concatenate([np.abs(x[s:s + step, None, :] - y[None, :, :]).sum(2) for s in range(0, len(x), step)]) if len(x) else np.zeros((0, len(y)))


@dataclass(frozen=True)
class Geometry:
    """A metric, and the space in which it obeys the triangle inequality ("root" distances).

    ``split`` is the width of the first factor of ``product``; ``square`` the common squared length of the
    data for ``inner`` and ``product``, whose vectors end with the coordinate that fills them up (0 for queries).
    """

    metric: str
    split: int = 0
    square: float = 0.0

    @property
    def filled(self) -> bool:
        return self.metric in ("inner", "product")

    def dot(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.metric != "product":
            return x @ y.T
        s = self.split
        return (x[:, :s] @ y[:, :s].T) * (x[:, s:-1] @ y[:, s:-1].T) + np.outer(x[:, -1], y[:, -1])

    def squares(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "product":
            return (x * x).sum(1)
        s = self.split
        return (x[:, :s] ** 2).sum(1) * (x[:, s:-1] ** 2).sum(1) + x[:, -1] ** 2

    def root(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """All distances in root space."""
        if self.metric == "cityblock":
            return _cityblock(x, y)
        return np.sqrt(np.maximum(self.squares(x)[:, None] + self.squares(y)[None, :] - 2.0 * self.dot(x, y), 0.0))

    def order(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A matrix that orders a block for a chunk; up to rounding the reported distance, squared for Euclid."""
        if self.metric == "cosine":
            return 1.0 - x @ y.T
        if self.filled:
            return -self.dot(x, y)
        if self.metric == "cityblock":
            return _cityblock(x, y)
        return self.squares(x)[:, None] + self.squares(y)[None, :] - 2.0 * (x @ y.T)

    def reported(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Row-wise distance of paired vectors, rounded as reported."""
        s = self.split
        if self.metric == "cosine":
            d = 1.0 - (x * y).sum(1)
        elif self.metric == "inner":
            d = -(x[:, :-1] * y[:, :-1]).sum(1)
        elif self.metric == "product":
            d = -(x[:, :s] * y[:, :s]).sum(1) * (x[:, s:-1] * y[:, s:-1]).sum(1)
        elif self.metric == "cityblock":
            d = np.abs(x - y).sum(1)
        else:
            d = np.sqrt(((x - y) ** 2).sum(1))
        return np.round(d, DIGITS)

    def limit(self, x: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """The root distance beyond which nothing is as near to a query as ``dist``."""
        if self.metric == "cosine":
            return np.sqrt(np.maximum(2.0 * (dist + SLACK), 0.0))
        if self.filled:
            return np.sqrt(np.maximum(self.squares(x) + self.square + 2.0 * (dist + SLACK), 0.0))
        return dist + SLACK

    def slack(self, *lengths: np.ndarray | float) -> np.ndarray | float:
        """Rounding of a root distance between vectors of these squared lengths, so no bound cuts off an exact tie."""
        return 1e-6 * (1.0 + np.sqrt(sum(lengths)))


def prepared(df: DataFrame, metric: str, group: str | None, factor: str | None = None) -> DataFrame:
    """(id, label, grp, vec); cosine works on unit vectors, ``product`` on both factors one after the other."""
    vec = arrays.unit("features") if metric == "cosine" else F.col("features").cast("array<double>")
    if metric == "product":
        vec = F.concat(F.col(factor).cast("array<double>"), vec)
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    return df.select("id", "label", g.alias("grp"), vec.alias("vec"))


def _limit_copies(data: DataFrame, keep: int) -> DataFrame:
    """Of identical vectors only the ``keep`` lowest ids can be among the nearest; the rest are never needed.

    The group limit runs before the shuffle as well, so a hot set of copies is not collected.
    """
    w = W.partitionBy("grp", "vec").orderBy("id")
    return data.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def _limit_hot(data: DataFrame, keep: int) -> tuple[DataFrame, bool]:
    """``_limit_copies`` that moves only rows whose vector's hash is too frequent, and whether there are any."""
    hashed = data.withColumn("_h", F.xxhash64("vec"))
    counts = hashed.groupBy("grp", "_h").agg(F.count("*").alias("_n")).filter(F.col("_n") > keep).select("grp", "_h")
    often = counts.limit(OFTEN + 1).collect()
    if not often:
        return data, False
    if len(often) > OFTEN:
        return _limit_copies(data, keep), True
    hot = F.broadcast(data.sparkSession.createDataFrame(often, counts.schema))
    rare, copies = (hashed.join(hot, ["grp", "_h"], how).select(*data.columns) for how in ("left_anti", "left_semi"))
    return rare.unionByName(_limit_copies(copies, keep)), True


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _square(vec: str, split: int) -> Column:
    """Squared length of a vector, or of the product of its two factors."""
    square = lambda a: arrays.dot(a, a)
    if not split:
        return square(F.col(vec))
    return square(F.slice(vec, 1, split)) * square(F.slice(vec, F.lit(split + 1), F.size(vec) - split))


def _geometry(points: DataFrame, queries: DataFrame, metric: str, split: int = 0) -> tuple[Geometry, DataFrame, DataFrame]:
    """The geometry, and both tables with the coordinate that fills vectors up where the metric needs it."""
    if metric not in ("inner", "product"):
        return Geometry(metric), points, queries
    longest = float(points.agg(F.max(_square("vec", split))).first()[0] or 0.0)
    rest = F.sqrt(F.greatest(F.lit(longest) - _square("vec", split), F.lit(0.0)))
    filled = points.withColumn("vec", F.concat("vec", F.array(rest)))
    return Geometry(metric, split, longest), filled, queries.withColumn("vec", F.concat("vec", F.array(F.lit(0.0))))


@dataclass
class Tree:
    """Top cells on the driver (about sqrt(N / block) per group), nodes per top cell and packed blocks as tables."""

    geo: Geometry
    pivots: np.ndarray
    grp: np.ndarray
    top: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    packs: DataFrame
    blocks: DataFrame
    n_nodes: int
    n_blocks: int
    split: bool


def _to_top(rows: DataFrame, geo: Geometry, pivots: np.ndarray, own: set[tuple[int, int]] | None = None) -> DataFrame:
    """Add the nearest top pivot and its distance; with ``own`` only (group, pivot) pairs that hold data count."""
    allowed: dict[int, np.ndarray] = {}
    for g, t in own or ():
        allowed.setdefault(g, np.full(len(pivots), np.inf))[t] = 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if own is not None:
                pdf = pdf[pdf["grp"].isin(list(allowed))]
            if not len(pdf):
                continue
            d = geo.root(_stack(pdf["vec"]), pivots)
            if own is not None:
                d = d + np.stack([allowed[g] for g in pdf["grp"]])
            top = d.argmin(1)
            yield pdf.assign(top=top.astype(np.int32), r=d[np.arange(len(pdf)), top])

    return rows.mapInPandas(run, f"{_fields(rows)}, top int, r double")


def _to_node(rows: DataFrame, geo: Geometry, packs: DataFrame) -> DataFrame:
    """Replace the distance to the top pivot by the nearest node of the top cell and the distance to its pivot.

    ``packs`` is (grp, top, nodes); a busy top cell is dealt by a hash of the id, its nodes go to every share.
    """
    counts = rows.groupBy("grp", "top").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("id", F.lit(11)), F.col("shares").cast("long")).cast("int")
    q = rows.join(counts, ["grp", "top"]).withColumn("share", share).drop("shares")
    p = packs.select("grp", "top", "nodes").join(counts, ["grp", "top"])
    p = p.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    columns = [*rows.columns, "node"]

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame(columns=columns)
        nodes = p["nodes"].iloc[0]
        at, y = np.array([v["node"] for v in nodes], np.int32), _stack(pd.Series([v["vec"] for v in nodes]))
        near, r = np.zeros(len(q), np.int64), np.zeros(len(q))
        for s in range(0, len(q), 4096):
            d = geo.root(_stack(q["vec"].iloc[s:s + 4096]), y)
            near[s:s + 4096] = d.argmin(1)
            r[s:s + 4096] = d.min(1)
        return q.assign(r=r, node=at[near])[columns]

    return _together(q, p, ["grp", "top", "share"], run, f"{_fields(rows)}, node int")


def _together(p: DataFrame, d: DataFrame, keys: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Both tables' rows of a key in one task; the second gets fresh column identities, as both may come from one table."""
    d = d.toDF(*d.columns)
    return p.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(kernel, schema)


def _packed(rows: DataFrame, geo: Geometry, size: int) -> DataFrame:
    """One row per about ``size`` rows of a node: ids, labels and vectors as bytes, with a centre and a radius.

    The centre is the row whose farthest other row of a sample is nearest. ``aux``, where present, is packed too.
    """
    counts = rows.groupBy(*NODE).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts").cast("long")).cast("int")
    types = dict(rows.dtypes)
    aux = "aux" in types

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _stack(pdf["vec"])
        some = x[:: max(1, len(x) // 256)]
        centre = some[geo.root(some, some).max(1).argmin()]
        radius = float(geo.root(x, centre[None, :]).max() + geo.slack(geo.squares(x).max()))
        row = {c: pdf[c].iloc[0] for c in (*NODE, "part")}
        row |= {"centre": centre, "radius": radius, "ids": pdf["id"].to_numpy(), "labels": pdf["label"].to_numpy(), "vecs": x.tobytes()}
        if aux:
            row["auxs"] = _stack(pdf["aux"]).tobytes()
        return pd.DataFrame({c: [v] for c, v in row.items()})

    schema = f"grp long, top int, node int, part int, centre array<double>, radius double, ids array<{types['id']}>, labels array<{types['label']}>, vecs binary" + (", auxs binary" if aux else "")
    return rows.join(counts, NODE).withColumn("part", part).groupBy(*NODE, "part").applyInPandas(run, schema)


def _split(placed: DataFrame, geo: Geometry, cells: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their node, and the nodes of every top cell; split cells draw nodes from their own rows.

    The top pivot is a node of every cell, so none is without.
    """
    h = rand.uniform("node", "id")
    inner = placed.join(cells.filter("split"), ["grp", "top"]).filter(h < F.col("rate"))
    inner = inner.groupBy("grp", "top").agg(F.array_sort(F.collect_list(F.struct(h.alias("h"), "id", "vec"))).alias("drawn"))
    vecs = F.concat(F.array("pivot"), F.coalesce(F.transform("drawn", lambda v: v["vec"]), F.array().cast("array<array<double>>")))
    nodes = F.transform(vecs, lambda v, i: F.struct(i.cast("int").alias("node"), v.alias("vec")))
    named = materialised(cells.join(inner, ["grp", "top"], "left").select("grp", "top", nodes.alias("nodes")), "pivots")
    placed = materialised(_to_node(placed, geo, named), "nodes")
    held = placed.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    each = named.select("grp", "top", F.explode("nodes").alias("v")).select("grp", "top", "v.node", "v.vec").join(held, NODE)
    parts = F.ceil(F.col("n") / block_rows).cast("int").alias("parts")
    return placed, materialised(each.groupBy("grp", "top").agg(F.array_sort(F.collect_list(F.struct("node", "vec", "lo", "hi", parts))).alias("nodes")), "packs")


def build(points: DataFrame, geo: Geometry, block_rows: int = BLOCK_ROWS) -> Tree:
    """The tree over (id, label, grp, vec[, aux]), a stored table.

    The driver sees about sqrt(N / block_rows) pivots and one row of statistics per group and pivot. A top cell
    gets a node per ``block_rows`` of its rows, four times the number of top pivots at most: a cell that holds
    more has bigger nodes, of more blocks.
    """
    spark = points.sparkSession
    n_top = max(1, int(np.ceil(np.sqrt(points.count() / block_rows))))
    drawn = points.orderBy(rand.hash32("pivot", "id"), "id").limit(n_top).select("vec").collect()
    pivots = np.array([r["vec"] for r in drawn] or [[0.0]], dtype=float)
    placed = materialised(_to_top(points, geo, pivots), "top")
    stats = placed.groupBy("grp", "top").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    wide = [geo.slack(s["hi"] ** 2, *geo.squares(pivots[s["top"]][None, :])) for s in stats]
    split = any(s["n"] > block_rows for s in stats)
    if split:
        cells = [(s["grp"], s["top"], [float(v) for v in pivots[s["top"]]], min(4 * n_top, -(-s["n"] // block_rows)) / s["n"], s["n"] > block_rows) for s in stats]
        placed, packs = _split(placed, geo, spark.createDataFrame(cells, "grp long, top int, pivot array<double>, rate double, split boolean"), block_rows)
    else:  # every top cell is one node of one block
        placed = placed.withColumn("node", F.lit(0))
        one = [(s["grp"], s["top"], [(0, [float(v) for v in pivots[s["top"]]], s["lo"], s["hi"], 1)]) for s in stats]
        packs = spark.createDataFrame(one, "grp long, top int, nodes array<struct<node:int,vec:array<double>,lo:double,hi:double,parts:int>>")
    blocks = materialised(_packed(placed, geo, block_rows), "blocks")
    sizes = packs.agg(F.sum(F.size("nodes")), F.sum(F.aggregate("nodes", F.lit(0), lambda s, v: s + v["parts"]))).first() if split else (len(stats), len(stats))
    return Tree(geo, pivots, np.array([s["grp"] for s in stats], np.int64), np.array([s["top"] for s in stats], np.int64),
                np.array([s["lo"] for s in stats]) - wide, np.array([s["hi"] for s in stats]) + wide, packs, blocks, int(sizes[0] or 0), int(sizes[1] or 0), split)


def chunks_of(queries: DataFrame, tree: Tree, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Queries packed by the node they fall into, each chunk with a number and the number of blocks of its node.

    Queries of a group without data have no node and are left out.
    """
    own = set(zip(tree.grp.tolist(), tree.top.tolist()))
    placed = _to_top(queries, tree.geo, tree.pivots, own)
    placed = _to_node(materialised(placed, "asked"), tree.geo, tree.packs) if tree.split else placed.withColumn("node", F.lit(0))
    packed = _packed(materialised(placed, "asked"), tree.geo, chunk_rows).drop("part")
    nodes = tree.packs.select("grp", "top", F.explode("nodes").alias("v")).select("grp", "top", "v.node", F.col("v.parts").alias("parts"))
    return materialised(packed.join(nodes, NODE).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def home(chunks: DataFrame) -> DataFrame:
    """(chunk, grp, top, node, part, least): one block of the chunk's own node."""
    return chunks.select("chunk", *NODE, F.pmod("chunk", F.col("parts").cast("long")).cast("int").alias("part"), F.lit(0.0).alias("least"))


def _vectors(row, name: str = "vecs") -> np.ndarray:
    return np.frombuffer(row[name]).reshape(len(row["ids"]), -1)


def bounded(chunks: DataFrame, found: DataFrame, geo: Geometry, k: int) -> DataFrame:
    """Chunks with ``bounds``, the k-th distance found for each query (infinite where fewer are), and the widest root limit."""
    w = W.partitionBy("chunk", "pos").orderBy("dist", "nbr_id")
    kth = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k)
    kth = kth.groupBy("chunk").agg(F.collect_list(F.struct("pos", "dist")).alias("_b"))
    state = chunks.join(kth, "chunk", "left")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bounds, limits = [], []
            for _, row in pdf.iterrows():
                b = np.full(len(row["ids"]), np.inf)
                for v in row["_b"] if row["_b"] is not None else ():
                    b[v["pos"]] = v["dist"]
                bounds.append(b)
                limits.append(float(geo.limit(_vectors(row), b).max()))
            yield pdf.drop(columns="_b").assign(bounds=bounds, limit=limits)

    return state.mapInPandas(run, f"{types}, bounds array<double>, limit double")


def pairs(state: DataFrame, tree: Tree, far: bool = False) -> DataFrame:
    """(chunk, grp, top, node, part, least): the blocks a chunk has to meet, by its centre, radius and ``limit``.

    A chunk is compared with the top cells first and with the nodes of those that stay. ``least`` is the
    smallest root distance a pair can have. With ``far`` the blocks are those where a pair can be as far as the limit.
    """
    geo, pivots, grp, top, lo, hi = tree.geo, tree.pivots, tree.grp, tree.top, tree.lo, tree.hi

    def needed(d: np.ndarray, radius: np.ndarray, limit: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = radius[:, None]
        if far:
            return -(d + r + high[None, :]), d + r + high[None, :] >= limit[:, None]
        least = np.maximum(0.0, np.maximum(d - r - high[None, :], low[None, :] - d - r))
        return least, least <= limit[:, None]

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            _, keep = needed(geo.root(_stack(pdf["centre"]), pivots)[:, top], pdf["radius"].to_numpy(), pdf["limit"].to_numpy(), lo, hi)
            i, j = np.nonzero(keep & (pdf["grp"].to_numpy()[:, None] == grp[None, :]))
            yield pdf.iloc[i].assign(top=top[j].astype(np.int32))[["chunk", "grp", "top", "centre", "radius", "limit"]]

    thin = state.select("chunk", "grp", "centre", "radius", "limit")
    some = thin.mapInPandas(tops, "chunk long, grp long, top int, centre array<double>, radius double, limit double")
    shares = max(1, thin.count() // TASK_CHUNKS // 64)
    some = some.withColumn("share", F.pmod("chunk", F.lit(shares)))
    packs = tree.packs.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))

    def nodes(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        columns = ["chunk", *NODE, "parts", "least"]
        if not len(q) or not len(p):
            return pd.DataFrame(columns=columns)
        held = p["nodes"].iloc[0]
        y = _stack(pd.Series([v["vec"] for v in held]))
        high, low = np.array([v["hi"] for v in held]), np.array([v["lo"] for v in held])
        wide = geo.slack(high ** 2, geo.squares(y))
        least, keep = needed(geo.root(_stack(q["centre"]), y), q["radius"].to_numpy(), q["limit"].to_numpy(), low - wide, high + wide)
        i, j = np.nonzero(keep)
        at, parts = np.array([v["node"] for v in held]), np.array([v["parts"] for v in held])
        return q.iloc[i][["chunk", "grp", "top"]].assign(node=at[j], parts=parts[j], least=least[i, j])[columns]

    got = _together(some, packs, ["grp", "top", "share"], nodes, "chunk long, grp long, top int, node int, parts int, least double")
    return got.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("chunk", *NODE, "part", "least")


def visit(todo: DataFrame, state: DataFrame, tree: Tree, kernel: Callable, schema: str) -> DataFrame:
    """Ship every chunk once to each block it has to meet; a busy block is copied per ``TASK_CHUNKS`` chunks.

    ``kernel(chunk row, block row)`` returns a frame.
    """
    keys = [*NODE, "part"]
    counts = todo.groupBy(*keys).agg(F.ceil(F.count("*") / TASK_CHUNKS).cast("int").alias("copies"))
    copy = F.pmod(F.xxhash64("chunk", F.lit(7)), F.col("copies").cast("long")).cast("int")
    q = todo.join(counts, keys).withColumn("copy", copy).drop("copies", "least")
    q = q.join(state.drop(*NODE, "parts", "centre", "radius", "limit"), "chunk")
    d = tree.blocks.drop("centre", "radius").join(counts, keys).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame(columns=names)
        block = d.iloc[0]
        return pd.concat([kernel(row, block) for _, row in q.iterrows()], ignore_index=True)[names]

    return _together(q, d, [*keys, "copy"], run, schema)


def _topk(geo: Geometry, k: int, exclude_self: bool) -> Callable:
    def run(q, d) -> pd.DataFrame:
        y, ids, labels = _vectors(d), np.asarray(d["ids"]), np.asarray(d["labels"])
        x, own, names, bounds = _vectors(q), np.asarray(q["ids"]), np.asarray(q["labels"]), np.asarray(q["bounds"])
        dist = geo.order(x, y)
        if exclude_self:
            dist[own[:, None] == ids[None, :]] = np.inf
        m = min(k, dist.shape[1]) - 1
        limit = np.partition(dist, m, axis=1)[:, m]
        r, c = np.nonzero((dist <= limit[:, None] + 1e-8 * (1.0 + np.abs(limit[:, None]))) & np.isfinite(dist))
        exact = geo.reported(x[r], y[c])
        near = exact <= bounds[r]
        r, c, exact = r[near], c[near], exact[near]
        order = np.lexsort((ids[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.r_[0, np.nonzero(np.diff(r))[0] + 1] if len(r) else np.array([], int)
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        r, c, exact = r[place < k], c[place < k], exact[place < k]
        return pd.DataFrame({"chunk": q["chunk"], "pos": r.astype(np.int32), "grp": q["grp"], "id": own[r], "label": names[r], "nbr_id": ids[c], "nbr_label": labels[c], "dist": exact})

    return run


# ---- search in packed files ----

@dataclass
class Index:
    """Rows of a table in blocks of near vectors: Arrow files in a mounted folder, and one row per block.

    ``table`` (file, at, grp, n, centre, radius, wide) is stored in the folder ``folder``; ``wide`` is the greatest
    squared length. ``rows`` is the table that the blocks were made of.
    """

    rows: DataFrame
    metric: str
    keep: int
    geo: Geometry
    table: DataFrame
    folder: str
    types: dict[str, str]
    limited: bool


def _bisected(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in parts of at most ``most`` rows, halved across the line between two rows far apart."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        v = x[rows]
        far = v[((v - v[0]) ** 2).sum(1).argmax()]
        other = v[((v - far) ** 2).sum(1).argmax()]
        side = np.argsort(v @ (far - other), kind="stable")
        half = most * max(1, round(len(rows) / most / 2))
        todo += [rows[side[:half]], rows[side[half:]]]
    return done


def _arrow_types(df: DataFrame) -> dict[str, pa.DataType]:
    return {f.name: to_arrow_type(f.dataType) for f in df.select("id", "label").schema.fields}


def _pack(rows: DataFrame, geo: Geometry, folder: str, most: int) -> DataFrame:
    """(file, at, grp, n, centre, radius, wide): every task writes its rows as blocks of at most ``most`` near vectors.

    A block is a record batch of a file in ``folder``. No row is moved; a task holds ``PACK_BYTES`` of vectors at once.
    """
    kinds = _arrow_types(rows)
    schema = pa.schema([("id", kinds["id"]), ("label", kinds["label"]), ("vec", pa.large_list(pa.float64()))])

    def blocks(writer: pa.ipc.RecordBatchFileWriter, held: pa.Table, name: str, at: int) -> Iterator[dict]:
        held = held.combine_chunks()
        if held["vec"].null_count or len(pc.unique(pc.list_value_length(held["vec"]))) > 1:
            raise ValueError("vectors are null or differ in length")
        x = _matrix(held["vec"].chunk(0)) if held.num_rows else np.zeros((0, 0))
        if np.isnan(x).any():
            raise ValueError("vectors hold null or NaN")
        grp = held["grp"].to_numpy()
        for g in np.unique(grp):
            own = np.nonzero(grp == g)[0]
            for part in _bisected(x[own], most):
                take = own[part]
                v = x[take]
                some = v[:: max(1, len(v) // 128)]
                centre = some[geo.root(some, some).max(1).argmin()]
                squares = geo.squares(v)
                radius = float(geo.root(v, centre[None, :]).max() + geo.slack(squares.max()))
                vec = pa.LargeListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int64()), pa.array(v.ravel()))
                writer.write_batch(pa.record_batch([held["id"].take(pa.array(take)).combine_chunks(), held["label"].take(pa.array(take)).combine_chunks(), vec], schema=schema))
                yield {"file": name, "at": at, "grp": int(g), "n": len(v), "centre": centre.tolist(), "radius": radius, "wide": float(squares.max())}
                at += 1

    out = pa.schema([("file", pa.string()), ("at", pa.int32()), ("grp", pa.int64()), ("n", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("wide", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, at, size, held, writer = f"{task.partitionId():05d}-{task.taskAttemptId()}.arrow", 0, 0, [], None
        for batch in _and_end(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.column("vec").nbytes
            if held and (batch is None or size >= PACK_BYTES):
                if writer is None:
                    os.makedirs(folder, exist_ok=True)
                    writer = pa.ipc.new_file(f"{folder}/{name}", schema)
                made = list(blocks(writer, pa.Table.from_batches(held), name, at))
                at, size, held = at + len(made), 0, []
                yield pa.RecordBatch.from_pylist(made, schema=out)
        if writer is not None:
            writer.close()

    made = rows.select("id", "label", "grp", "vec").mapInArrow(run, "file string, at int, grp long, n int, centre array<double>, radius double, wide double")
    return materialised(made, "blocks")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(data: DataFrame, keep: int, metric: str = "cosine", group: str | None = None, factor: str | None = None, rows_each: int = CHUNK_ROWS) -> Index | None:
    """``data`` packed for searches of up to ``keep`` - 1 neighbours each; None where the shared folder is not mounted.

    The blocks are the only copy of the vectors that is stored.
    """
    folder = mounted(data.sparkSession, scratch_path(data.sparkSession, "packed"))
    if folder is None:
        return None
    points, limited = _limit_hot(prepared(data, metric, group, factor), keep)
    split = (data.select(F.size(factor)).first() or [0])[0] if factor else 0
    geo, filled, _ = _geometry(points, points, metric, split)
    return Index(data, metric, keep, geo, _pack(filled, geo, folder, rows_each), folder, dict(points.dtypes), limited)


class _Blocks:
    """Blocks by name and number, from files that stay open."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def __call__(self, file: str, at: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        if file not in self.files:
            if len(self.files) >= 256:
                self.files.clear()
            self.files[file] = pa.ipc.open_file(pa.memory_map(f"{self.folder}/{file}"))
        b = self.files[file].get_batch(at)
        ids = b.column(0)
        ids = ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.asarray(ids.to_pylist())
        return _matrix(b.column(2)), ids, b.column(1)


class _Nearest:
    """The k nearest so far of the queries of a chunk, ties by id."""

    def __init__(self, geo: Geometry, x: np.ndarray, own: np.ndarray | None, k: int):
        self.geo, self.x, self.own, self.k = geo, x, own, k
        self.bounds = np.full(len(x), np.inf)
        self.row, self.dist, self.block, self.pos = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = None
        self.square = geo.squares(x).max()
        # The screen of these metrics is one product of single precision; what it lets pass is measured in double.
        self.single = x.astype(np.float32) if geo.metric in ("cosine", "inner") else None

    def limit(self) -> float:
        return float(self.geo.limit(self.x, self.bounds).max())

    def _candidates(self, y: np.ndarray, wide: float, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        open_ = not np.isfinite(self.bounds).all()
        if self.single is not None and not open_:
            slack = 1e-8 + (y.shape[1] + 8) * 1.2e-7 * np.sqrt(self.square * wide)
            least = ((1.0 if self.geo.metric == "cosine" else 0.0) - self.bounds - slack).astype(np.float32) - np.float32(1e-6) * np.abs(self.bounds).astype(np.float32)
            hit = np.flatnonzero(self.single @ y.astype(np.float32).T >= least[:, None])
            return hit // len(y), hit % len(y)
        order = self.geo.order(self.x, y)
        if self.own is not None:
            order[self.own[:, None] == ids[None, :]] = np.inf
        limit = np.square(self.bounds) if self.geo.metric == "euclidean" else self.bounds
        if open_:
            m = min(self.k, order.shape[1]) - 1
            limit = np.minimum(limit, np.partition(order, m, axis=1)[:, m])
        with np.errstate(invalid="ignore"):
            slack = 1e-8 * (1.0 + np.abs(limit)) + 1e-13 * (self.square + wide)
            return np.nonzero((order <= (limit + slack)[:, None]) & np.isfinite(order))

    def meet(self, y: np.ndarray, ids: np.ndarray, number: int, wide: float) -> None:
        r, c = self._candidates(y, wide, ids)
        if self.own is not None and len(r):
            other = self.own[r] != ids[c]
            r, c = r[other], c[other]
        if not len(r):
            return
        exact = self.geo.reported(self.x[r], y[c])
        near = exact <= self.bounds[r]
        r, c, exact = r[near], c[near], exact[near]
        if not len(r):
            return
        touched = np.zeros(len(self.x), bool)
        touched[r] = True
        old = touched[self.row]
        rest = ~old
        row, dist = np.r_[self.row[old], r], np.r_[self.dist[old], exact]
        block, pos = np.r_[self.block[old], np.full(len(r), number)], np.r_[self.pos[old], c]
        names = ids[c] if self.ids is None else np.concatenate([self.ids[old], ids[c]])
        order = np.lexsort((names, dist, row))
        row = row[order]
        first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        full = order[place == self.k - 1]
        order = order[place < self.k]
        row = np.r_[self.row[old], r]
        self.bounds[row[full]] = dist[full]
        self.ids = names[order] if self.ids is None else np.concatenate([self.ids[rest], names[order]])
        self.row, self.dist = np.r_[self.row[rest], row[order]], np.r_[self.dist[rest], dist[order]]
        self.block, self.pos = np.r_[self.block[rest], block[order]], np.r_[self.pos[rest], pos[order]]


def _search(chunks: DataFrame, chunk_folder: str, data: Index, k: int, exclude_self: bool, types: dict[str, str], out: DataFrame) -> DataFrame:
    """(grp, id, label, rank, nbr_id, nbr_label, dist): every chunk meets the blocks by rising least distance.

    It stops where the least distance to a block is beyond the k-th found for each of its queries. Nothing is shuffled
    but the names of the chunks; a task holds one chunk, one block and the table of blocks' centres in slices.
    """
    geo, folder = data.geo, data.folder
    table = mounted(chunks.sparkSession, data.table.inputFiles()[0].rsplit("/", 1)[0]) if data.table.inputFiles() else None
    kinds = _arrow_types(out)
    schema = pa.schema([("grp", pa.int64()), ("id", kinds["id"]), ("label", kinds["label"]), ("rank", pa.int32()),
                        ("nbr_id", to_arrow_type(data.rows.schema["id"].dataType)), ("nbr_label", to_arrow_type(data.rows.schema["label"].dataType)), ("dist", pa.float64())])

    def near(chunk: dict) -> tuple[list, list, np.ndarray, np.ndarray]:
        """Name, number, least distance and greatest square of the blocks of the chunk's group, nearest first."""
        file, at, least, wide = [], [], [], []
        for batch in ds.dataset(table, format="parquet").to_batches(filter=ds.field("grp") == chunk["grp"], columns=["file", "at", "centre", "radius", "wide"]):
            if batch.num_rows:
                d = geo.root(np.asarray(chunk["centre"])[None, :], _matrix(batch.column("centre")))[0]
                least.append(d - chunk["radius"] - batch.column("radius").to_numpy())
                wide.append(batch.column("wide").to_numpy())
                file += batch.column("file").to_pylist()
                at += batch.column("at").to_pylist()
        if not file:
            return [], [], np.zeros(0), np.zeros(0)
        least, wide = np.concatenate(least), np.concatenate(wide)
        order = np.argsort(least, kind="stable")
        return [file[i] for i in order], [at[i] for i in order], least[order], wide[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = _Blocks(folder), _Blocks(chunk_folder)
        for batch in batches:
            for chunk in batch.to_pylist():
                x, ids, labels = own(chunk["file"], chunk["at"])
                found = _Nearest(geo, x, ids if exclude_self else None, k)
                file, at, least, wide = near(chunk)
                limit = np.inf
                for j in range(len(file)):
                    if least[j] > limit:
                        break
                    y, names, _ = of(file[j], at[j])
                    found.meet(y, names, j, float(wide[j]))
                    if j % 8 == 0:
                        limit = found.limit()
                if not len(found.row):
                    continue
                order = np.lexsort((found.ids, found.dist, found.row))
                row, block, pos = found.row[order], found.block[order], found.pos[order]
                first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
                rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) + 1
                tags = np.empty(len(row), object)
                for j in np.unique(block):
                    here = np.flatnonzero(block == j)
                    tags[here] = of(file[j], at[j])[2].take(pa.array(pos[here])).to_pylist()
                yield pa.record_batch([pa.array(np.full(len(row), chunk["grp"])), pa.array(ids[row].tolist(), schema.field("id").type), labels.take(pa.array(row)).cast(schema.field("label").type),
                                       pa.array(rank.astype(np.int32)), pa.array(found.ids[order].tolist(), schema.field("nbr_id").type), pa.array(tags.tolist(), schema.field("nbr_label").type), pa.array(found.dist[order])], schema=schema)

    n = chunks.count()
    dealt = chunks.repartition(max(1, min(n, max(chunks.sparkSession.sparkContext.defaultParallelism, n // SEARCH_CHUNKS))), "file", "at")
    names = dealt.select("file", "at", "grp", "centre", "radius")
    return names.mapInArrow(run, f"grp long, id {types['id']}, label {types['label']}, rank int, nbr_id {data.types['id']}, nbr_label {data.types['label']}, dist double")


def _knn_packed(queries: DataFrame, data: Index, k: int, query_group: str | None, exclude_self: bool, same: bool, factor: str | None, chunk_rows: int) -> tuple[DataFrame, str]:
    """What is found, and the folder of the packed queries."""
    q = prepared(queries, data.metric, query_group, factor)
    if same and not data.limited:
        chunks, folder = data.table, data.folder
    else:
        folder = mounted(q.sparkSession, scratch_path(q.sparkSession, "packed"))
        asked = q.withColumn("vec", F.concat("vec", F.array(F.lit(0.0)))) if data.geo.filled else q
        chunks = _pack(asked, data.geo, folder, chunk_rows)
    found = _search(chunks, folder, data, k, exclude_self, dict(q.dtypes), queries)
    if q.groupBy("grp", "id").count().filter("count > 1").isEmpty():
        return found, folder
    w = W.partitionBy("grp", "id").orderBy("dist", "nbr_id")  # rows that share an id share its k places
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), folder


def knn(
    queries: DataFrame,
    data: DataFrame | Index,
    k: int,
    metric: str = "cosine",
    query_group: str | None = None,
    data_group: str | None = None,
    exclude_self: bool = True,
    keep_group: bool = False,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    factor: str | None = None,
) -> DataFrame:
    """(id, label, rank, nbr_id, nbr_label, dist): the k nearest rows of ``data``, ranks from 1.

    Distances are rounded to 9 digits and ties go to the lower id. With groups, a query only meets
    data of its own group (few groups: classes, rounds); ``keep_group`` adds it as ``grp``, so that a row
    may be asked in several groups. ``factor`` names the second vector column of the metric ``product``. An ``index`` that was made of the data before
    is searched as it is; without one, the data is packed by the tasks that read it, or, where the shared folder is
    not mounted, sent through the tree. The result is stored, so that no use of it searches again.
    """
    made = data if isinstance(data, Index) else index(data, k + int(exclude_self), metric, data_group, factor, chunk_rows)
    out = (*(["grp"] if keep_group else []), "id", "label", "rank", "nbr_id", "nbr_label", "dist")
    if made is not None:
        if made.keep < k + int(exclude_self):
            raise ValueError("the index keeps too few copies of a vector for this search")
        same = queries is made.rows and query_group == data_group and not made.geo.filled
        found, asked = _knn_packed(queries, made, k, query_group, exclude_self, same, factor, chunk_rows)
        found = materialised(found.select(*out), "found")
        # The result is stored: what was packed for this search alone is not kept.
        for folder in {asked, made.folder} - ({made.folder} if made is data else set()):
            shutil.rmtree(folder, ignore_errors=True)
        return found
    return materialised(_knn_tree(queries, data, k, metric, query_group, data_group, exclude_self, block_rows, chunk_rows, factor).select(*out), "found")


def _knn_tree(queries: DataFrame, data: DataFrame, k: int, metric: str, query_group: str | None, data_group: str | None, exclude_self: bool,
              block_rows: int, chunk_rows: int, factor: str | None) -> DataFrame:
    """The search by the tree, for shared folders that tasks cannot open themselves."""
    points = materialised(_limit_copies(prepared(data, metric, data_group, factor), k + int(exclude_self)), "points")
    width = points.select(F.size("vec")).first()
    split = data.select(F.size(factor)).first()[0] if factor and width else 0
    geo, filled, q = _geometry(points, prepared(queries, metric, query_group, factor), metric, split)
    ids, labels = dict(points.dtypes)["id"], dict(points.dtypes)["label"]
    schema = f"chunk long, pos int, grp long, id {dict(q.dtypes)['id']}, label {dict(q.dtypes)['label']}, nbr_id {ids}, nbr_label {labels}, dist double"
    tree = build(filled, geo, block_rows)
    chunks = chunks_of(q, tree, chunk_rows)
    unbounded = chunks.withColumn("bounds", F.transform("ids", lambda _: F.lit(float("inf"))))
    kernel = _topk(geo, k, exclude_self)
    found = visit(home(chunks), unbounded, tree, kernel, schema)
    if tree.n_blocks > 1:
        found = materialised(found, "near")
        state = materialised(bounded(chunks, found, geo, k), "state")
        todo = pairs(state, tree).join(home(chunks), ["chunk", *NODE, "part"], "left_anti")
        place = F.row_number().over(W.partitionBy("chunk").orderBy("least", *NODE, "part"))
        todo = materialised(todo.withColumn("place", place), "visits")
        found = materialised(found.unionByName(visit(todo.filter(F.col("place") <= NEXT_NODES).drop("place"), state, tree, kernel, schema)), "near")
        state = materialised(bounded(chunks, found, geo, k), "state")
        rest = todo.filter(F.col("place") > NEXT_NODES).drop("place").join(state.select("chunk", "limit"), "chunk").filter("least <= limit").drop("limit")
        found = found.unionByName(visit(rest, state, tree, kernel, schema))
    w = W.partitionBy("grp", "id").orderBy("dist", "nbr_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within_radius(
    queries: DataFrame, data: DataFrame, radius: float, score: Callable, score_column: str,
    query_group: str | None = None, data_group: str | None = None, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per query: how many rows lie within a Euclidean radius, and the one with the greatest score.

    ``score_column`` is a vector on both tables; ``score`` maps (chunk vectors, block vectors, chunk
    features, block features) to a matrix. Only one row per query and block leaves a task.
    """
    def side(df: DataFrame, group: str | None) -> DataFrame:
        g = F.col(group).cast("long") if group else F.lit(0).cast("long")
        return df.select("id", "label", g.alias("grp"), F.col("features").cast("array<double>").alias("vec"), F.col(score_column).alias("aux"))

    geo = Geometry("euclidean")
    tree = build(materialised(side(data, data_group), "points"), geo, block_rows)
    chunks = chunks_of(side(queries, query_group), tree, chunk_rows).withColumn("limit", F.lit(float(radius) + SLACK))

    def run(q, d) -> pd.DataFrame:
        x, y, own, ids = _vectors(q), _vectors(d), np.asarray(q["ids"]), np.asarray(d["ids"])
        near = np.maximum(geo.order(x, y), 0.0) <= (radius + SLACK) ** 2
        near &= own[:, None] != ids[None, :]
        s = np.where(near, np.round(score(_vectors(q, "auxs"), _vectors(d, "auxs"), x, y), DIGITS), -np.inf)
        best = s.argmax(1)
        return pd.DataFrame({"id": own, "n": near.sum(1), "nbr_id": ids[best], "score": s.max(1)})[near.any(1)]

    rows = visit(pairs(chunks, tree), chunks, tree, run, f"id {dict(queries.dtypes)['id']}, n long, nbr_id {dict(data.dtypes)['id']}, score double")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("nbr_id")))
    return rows.groupBy("id").agg(F.sum("n").alias("n_within"), best.alias("_b")).select("id", "n_within", F.col("_b.nbr_id").alias("nbr_id"), (-F.col("_b.s")).alias("score"))


def far_pairs(df: DataFrame, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> tuple[float, Tree, DataFrame, DataFrame]:
    """A distance that is attained, the tree, the chunks, and the visits that could show a greater one.

    The farthest row of each top pivot is a corner; the greatest distance between corners, or from a pivot to its
    corner, is attained. A chunk has to meet a block only where both centres and radii allow more.
    """
    geo = Geometry("euclidean")
    points = materialised(prepared(df, "euclidean", None), "points")
    tree = build(points, geo, block_rows)
    pivots = tree.pivots

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far, rows = np.full(len(pivots), -1.0), [None] * len(pivots)
        for pdf in batches:
            if not len(pdf):
                continue
            x = _stack(pdf["vec"])
            d = geo.root(pivots, x)
            best = d.argmax(1)
            for i in np.nonzero(d[np.arange(len(pivots)), best] > far)[0]:
                far[i], rows[i] = d[i, best[i]], x[best[i]]
        yield pd.DataFrame([(i, f, v) for i, (f, v) in enumerate(zip(far, rows)) if v is not None], columns=["pivot", "far", "vec"])

    seen = points.mapInPandas(corners, "pivot int, far double, vec array<double>").groupBy("pivot").agg(F.max_by("vec", "far").alias("vec")).collect()
    ends = np.array([r["vec"] for r in seen], dtype=float)
    known = 0.0
    for v in ends:
        known = max(known, float(np.sqrt(((ends - v) ** 2).sum(1)).max()), float(np.sqrt(((pivots - v) ** 2).sum(1)).max()))
    chunks = chunks_of(points, tree, chunk_rows).withColumn("limit", F.lit(known))
    return known, tree, chunks, pairs(chunks, tree, far=True)


def diameter(df: DataFrame, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> float:
    """Greatest pairwise Euclidean distance; every visited block returns one number. 0 for an empty table."""
    known, tree, chunks, todo = far_pairs(df, block_rows, chunk_rows)
    geo = tree.geo

    def run(q, d) -> pd.DataFrame:
        x, y = _vectors(q), _vectors(d)
        b = geo.order(x, y)
        i, j = np.unravel_index(b.argmax(), b.shape)
        return pd.DataFrame({"far": [float(np.sqrt(((x[i] - y[j]) ** 2).sum()))]})

    got = visit(todo, chunks, tree, run, "far double").agg(F.max("far")).first()[0]
    return max(known, got or 0.0)


def local_neighbourhood(df: DataFrame, centre: DataFrame, n: int = 250) -> DataFrame:
    """The n nearest rows to one centre vector (a one-row table with ``features``)."""
    c = centre.select("features").scalar()
    near = df.withColumn("_c", c).withColumn("dist", F.round(arrays.distance("features", "_c"), DIGITS)).drop("_c")
    return near.orderBy("dist", "id").limit(n)


def pairwise_distance(df: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """Distance of every row to each of a few points (id, features), e.g. class centres."""
    few = points.agg(F.collect_list(F.struct(F.col("id").alias("point"), F.col("features").alias("v"))).alias("p"))
    wide = df.withColumn("_p", F.explode(few.scalar()))
    return wide.select("id", F.col("_p.point").alias("point"), arrays.distance("features", F.col("_p.v"), metric).alias("dist"))
