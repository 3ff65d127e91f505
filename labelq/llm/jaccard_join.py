"""Exact Jaccard join of shingle sets by signature trees.

1. Sets. Every text becomes a set of hashed shingles. Texts with the same set are one class, represented by the
   smallest doc_id; only representatives go on.
2. Trees. In any global order of tokens, two sets with enough overlap share a token among their first
   n - ceil(n * percent / 100) + 1. The order puts tokens that many sets share last. The sets that share a token
   of these prefixes form a signature tree; tokens shared by the same sets are one tree, and a tree above
   ``TREE_ROWS`` is cut into parts, whose pairs are separate tasks. The dual traversal of a tree rules out pairs of
   nodes by size ranges and by the largest possible overlap of their OR-combined bitmaps of half the tokens.
   A spanning forest of the pairs that remain leaves the task; its components are families.
3. Families. Linked sets are always in one family. Its full sets come together, in signature trees with bitmaps of
   all tokens; pairs that the traversal leaves and that are not connected yet are compared exactly. Large families
   are cut into parts by size band and hash, and only parts of the same or the next band meet. Again a spanning
   forest, now of links, leaves the task. Where links are counted, all pairs that the traversal leaves are compared,
   and a task also gives the number of links of each set; no two sets meet in more than one part.
4. Components of these links, with the smallest doc_id as their name.

Nothing is sampled or capped: the order of tokens, sizes of trees and links found early decide how much work is
done, never which sets end up connected. A group of thousands of near copies never becomes a list of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm import signatures as S
from labelq.llm.base import SMALL_ROWS, batch, query, small_batches, table
from labelq.llm.components import components
from labelq.llm.shingle_sets import shingle_sets
from labelq.session import materialised

QUARTER = np.uint64(62)  # tokens whose two highest bits are zero: the quarter of the hash space that is counted
HALF = np.uint64(63)  # tokens whose highest bit is zero: the half that the bitmaps of step 2 show
COMMON = 64  # tokens of more sets than this come last in the order
COMMON_LISTED = 1 << 20  # most tokens in that list, which every task gets; a longer one is cut at a higher count
TREE_ROWS = 2048
LISTED = 64  # up to so many sets of a token are gathered as a list, so that equal lists become one tree
BULK = 32  # trees of up to this many sets are one leaf node and are handled together
FAMILY_ROWS, FAMILY_TOKENS = 1024, 1 << 21  # most of a family, or of one of its parts, in one tree


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _features(k: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("m", pa.int32()), ("sig", pa.binary()), ("inner", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2), k), strict=True):
                cut = int(np.searchsorted(s, np.uint64(1) << QUARTER))
                n = len(s)
                out["doc_id"].append(doc_id)
                out["text_key"].append(key)
                out["n"].append(n)
                out["f1"].append(int(s.sum(dtype=np.uint64).astype(np.int64)) if n else 0)
                out["f2"].append(int(np.bitwise_xor.reduce(s).astype(np.int64)) if n else 0)
                shown = s[:int(np.searchsorted(s, np.uint64(1) << HALF))]
                out["m"].append(len(shown))
                out["sig"].append(S.bitmap(shown, 2 * n) if n else b"")
                out["inner"].append(s[:cut].view(np.int64))
                out["rest"].append(s[cut:cut + prefix_length(n, percent)].view(np.int64) if n else [])
            yield batch(schema, out)
    return run


def features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return named.mapInArrow(_features(k, percent), "doc_id long, text_key long, n int, f1 long, f2 long, m int, sig binary, inner array<long>, rest array<long>")


def _prefixes(percent: int, common):
    schema = pa.schema([("id", pa.int64()), ("first", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, n, inner, rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                inner, rest = inner.values.to_numpy(), rest.values.to_numpy()
                at = np.searchsorted(late, inner)
                hot = (at < len(late)) & (late[np.minimum(at, len(late) - 1)] == inner) if len(late) else np.zeros(len(inner), bool)
                order = np.concatenate([inner[~hot], rest, inner[hot]])[:prefix_length(n, percent)]
                for name, v in zip(out, (doc_id, int(inner[0] if len(inner) else rest[0]), order), strict=True):
                    out[name].append(v)
            yield batch(schema, out)
    return run


def _common(counts: DataFrame) -> np.ndarray:
    """The tokens that come last: those of more than ``COMMON`` sets, or of more than the count that keeps the list
    to ``COMMON_LISTED``. They only steer the order."""
    steps = counts.where(F.col("c") > COMMON).groupBy(F.floor(F.log2("c")).alias("g")).agg(F.count("*").alias("k")).collect()
    least, held = COMMON, 0
    for row in sorted(steps, key=lambda r: -r["g"]):
        held += row["k"]
        if held > COMMON_LISTED:
            least = 1 << (row["g"] + 1)
            break
    rows = counts.where(F.col("c") > least).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy())


def _levels(r: dict, rows: np.ndarray, w: int) -> S.Level:
    bits = np.frombuffer(b"".join(S.folded(np.frombuffer(r["sig"][x], "<u8")[None, :], w).tobytes() for x in rows), "<u8").reshape(len(rows), -1)
    seen = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    n, m, own = r["n"][rows], r["m"][rows], r["id"][rows]
    return S.Level(bits, m - seen, n - m, n, n, own, own)


def _small_trees(r: dict, starts: np.ndarray, ends: np.ndarray, percent: int) -> Iterator[tuple]:
    """All pairs of rows inside small trees, checked together: (i, j, bound)."""
    if not len(starts):
        return
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
    later = np.repeat(ends, ends - starts) - rows - 1
    i = np.repeat(rows, later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    low, high = np.minimum(r["n"][i], r["n"][j]), np.maximum(r["n"][i], r["n"][j])
    cross = (r["side"][i] != r["side"][j]) | (r["side"][i] == 0)
    ok = cross & (100 * low >= percent * high) & (r["id"][i] != r["id"][j])
    i, j = i[ok], j[ok]
    klass = np.minimum(r["w"][i], r["w"][j])
    for w in np.unique(klass):
        mine = klass == w
        need, place = np.unique(np.concatenate([i[mine], j[mine]]), return_inverse=True)
        level = _levels(r, need, int(w))
        x, y = place[:mine.sum()], place[mine.sum():]
        good, most = S.possible(level, x, level, y, percent)
        yield i[mine][good], j[mine][good], most[good]


def _large_tree(r: dict, s: int, e: int, percent: int) -> Iterator[tuple]:
    """One larger tree, or the cross of two parts: one traversal for each pair of bitmap widths that can meet."""
    side = r["side"][s:e]
    sides = [s + np.flatnonzero(side == x) for x in (1, 2)] if side.any() else [np.arange(s, e)]
    by_width = [{int(w): x[r["w"][x] == w] for w in np.unique(r["w"][x])} for x in sides]
    for u, own in by_width[0].items():
        for v, other in by_width[-1].items():
            if abs(u - v) > 1 or (len(sides) == 1 and u > v):
                continue
            # Sets of one family lie next to each other, so that nodes stay thin.
            xs, ys = (x[np.lexsort((r["n"][x], r["first"][x]))] for x in (own, other))
            alone = len(sides) == 1 and u == v
            a = S.tree(_levels(r, xs, min(u, v)))
            b = None if alone else S.tree(_levels(r, ys, min(u, v)))
            for i, j, most in S.traverse(a, b, percent):
                yield xs[i], ys[j], most


class _Joined:
    """Union-find over ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(keys[0])]])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int, size: int) -> Iterator[pa.Table]:
    """Tables of a sorted partition that hold whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < size:
            continue
        t = pa.Table.from_batches(held)
        starts, _ = _groups([t.column(k).to_numpy() for k in keys])
        if starts[-1]:
            yield t.slice(0, int(starts[-1]))
            held = t.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(sorted({(min(p), max(p)) for p in pairs}), np.int64).reshape(-1, 2)
    return batch(PAIRS, {"a": found[:, 0], "b": found[:, 1]})


def _spanning(r: dict, s: int, e: int, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that one larger tree leaves; the traversal ends once all its sets are connected."""
    joined, open_ = _Joined(), len(np.unique(r["id"][s:e])) - 1
    for i, j, _ in _large_tree(r, s, e, percent):
        for x, y in zip(r["id"][i].tolist(), r["id"][j].tolist(), strict=True):
            if joined.join(x, y):
                yield x, y
                open_ -= 1
        if not open_:
            return


def _candidate_forest(percent: int):
    """Step 2 in a partition sorted by (token, part): spanning forests of the pairs that the trees leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ("token", "part"), 5_000, 1 << 23):
            r = {x: t.column(x).to_numpy() for x in ("token", "part", "side", "id", "first")}
            r["n"], r["m"] = (t.column(x).to_numpy().astype(np.int64) for x in ("n", "m"))
            r["sig"], r["w"] = t.column("sig").to_pylist(), S.width_class(2 * r["n"])
            starts, ends = _groups([r["token"], r["part"]])
            size = ends - starts
            some = (size > 1) & (size <= BULK)
            # Near copies leave nearly all pairs of a large tree: they are joined slice by slice and never held together.
            pairs = [x for s, e in zip(starts[size > BULK].tolist(), ends[size > BULK].tolist(), strict=True) for x in _spanning(r, s, e, percent)]
            found = list(_small_trees(r, starts[some], ends[some], percent))
            if found:
                i, j, _ = (np.concatenate(x) for x in zip(*found, strict=True))
                group = np.repeat(np.arange(len(starts)), size)
                order = np.argsort(group[i], kind="stable")
                joined, last = _Joined(), -1
                for g, x, y in zip(group[i][order].tolist(), r["id"][i][order].tolist(), r["id"][j][order].tolist(), strict=True):
                    if g != last:
                        joined, last = _Joined(), g
                    if joined.join(x, y):
                        pairs.append((x, y))
            if pairs:
                yield _pairs(pairs)
    return run


LINKS = pa.schema([*PAIRS, ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("links", pa.int64())])


def _linked(codes: dict, tokens: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of the non-empty sets ``codes`` (numbers below ``tokens``) are links; one set against many at once."""
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    seen = np.zeros(tokens, np.int32)
    for s, e in zip(*_groups([i[order]]), strict=True):
        for at in np.split(order[s:e], range(1024, e - s, 1024)):
            own, others = codes[int(i[at[0]])], [codes[int(y)] for y in j[at]]
            size = np.array([len(x) for x in others])
            seen[own] = 1
            both = np.add.reduceat(seen[np.concatenate(others)], np.cumsum(size) - size)
            seen[own] = 0
            out[at] = 100 * both >= percent * (len(own) + size - both)
    return out


def _link_forest(percent: int, count: bool):
    """Step 3 in a partition sorted by (family, part): spanning forests of the links, and with ``count`` a row for each
    set and part with the number of documents it is linked to there, from the ``weight`` of the sets (0: not counted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ("family", "part"), 2_000, 1 << 25):
            r = {x: t.column(x).to_numpy() for x in ("family", "part", "side", "id", "f1", "f2")}
            weight = t.column("weight").to_numpy().copy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
            r["n"] = r["m"] = np.array([len(x) for x in sets], np.int64)
            r["first"] = np.array([int(x[0] >> np.uint64(1)) if len(x) else 0 for x in sets], np.int64)
            r["w"] = S.width_class(4 * r["n"])
            starts, ends = _groups([r["family"], r["part"]])
            pairs, links = [], np.zeros(len(sets), np.int64)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                r["sig"] = {x: S.bitmap(sets[x], 4 * len(sets[x])) for x in range(s, e)}
                some = (np.array([s]), np.array([e]))
                found = _small_trees(r, *some, percent) if e - s <= BULK else _large_tree(r, s, e, percent)
                joined = _Joined()
                if count:
                    # Rows that repeat an id and text are one set.
                    once: set = set()
                    for x in np.flatnonzero(weight[s:e]) + s:
                        key = (r["id"][x], r["n"][x], r["f1"][x], r["f2"][x])
                        weight[x] *= key not in once
                        once.add(key)
                    tokens, place = np.unique(np.concatenate(sets[s:e]), return_inverse=True)
                    codes = dict(zip(range(s, e), np.split(place, np.cumsum(r["n"][s:e])[:-1]), strict=True))
                for i, j, most in found:
                    if count:
                        both = (weight[i] > 0) & (weight[j] > 0)
                        x, y = (v[both & (r["id"][i] != r["id"][j])] for v in (i, j))
                        if len(x):
                            good = _linked(codes, len(tokens), x, y, percent)
                            x, y = x[good], y[good]
                            np.add.at(links, x, weight[y])
                            np.add.at(links, y, weight[x])
                            pairs += [(a, b) for a, b in zip(r["id"][x].tolist(), r["id"][y].tolist(), strict=True) if joined.join(a, b)]
                        i, j, most = i[~both], j[~both], most[~both]
                    share = most / np.maximum(r["n"][i] + r["n"][j] - most, 1)
                    for k in np.argsort(-share, kind="stable").tolist():
                        x, y = int(i[k]), int(j[k])
                        a, b = int(r["id"][x]), int(r["id"][y])
                        if a == b or joined.root(a) == joined.root(b):
                            continue
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            joined.join(a, b)
                            pairs.append((a, b))
            forest, some = _pairs(pairs), np.flatnonzero(links)
            none = [None] * forest.num_rows
            yield batch(LINKS, {"a": forest.column(0), "b": forest.column(1), "n": none, "f1": none, "f2": none, "links": none})
            yield batch(LINKS, {"a": r["id"][some], "b": r["id"][some], "n": r["n"][some], "f1": r["f1"][some], "f2": r["f2"][some], "links": links[some]})
    return run


def _trees(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of the trees: (token, part, side, id).

    Tokens that the same few sets share become one tree. Trees above ``TREE_ROWS`` become pairs of parts.
    """
    listed = postings.join(counts, "token")
    lists = listed.where(F.col("c") <= LISTED).groupBy("token").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    few = lists.select(F.xxhash64("ids").alias("token"), F.lit(0).alias("part"), F.lit(0).alias("side"), F.explode("ids").alias("id"))
    more = listed.where((F.col("c") > LISTED) & (F.col("c") <= TREE_ROWS)).select("token", F.lit(0).alias("part"), F.lit(0).alias("side"), "id")
    large = listed.where(F.col("c") > TREE_ROWS).withColumn("_p", F.ceil(F.col("c") / TREE_ROWS).cast("int"))
    large = large.withColumn("_m", F.pmod(F.xxhash64("id"), F.col("_p")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    side = F.when(F.col("_m") == F.col("_o"), 0).when(F.col("_m") < F.col("_o"), 1).otherwise(2)
    part = F.least("_m", "_o") * F.col("_p") + F.greatest("_m", "_o")
    return few.unionByName(more).unionByName(large.select("token", part.cast("int").alias("part"), side.cast("int").alias("side"), "id"))


def _families(members: DataFrame, percent: int) -> DataFrame:
    """Places of sets in family trees: (id, n, family, part, side), from (id, n, family).

    A family above ``FAMILY_ROWS`` sets or ``FAMILY_TOKENS`` tokens is cut by size band, a factor of percent / 100
    wide, and hash; sets whose bands differ by two or more cannot be linked.
    """
    sizes = members.groupBy("family").agg(F.count("*").alias("_c"), F.sum("n").alias("_t"))
    whole = (F.col("_c") <= FAMILY_ROWS) & (F.col("_t") <= FAMILY_TOKENS)
    placed = members.join(sizes, "family")
    small = placed.where(whole).select("id", "n", "family", F.lit("").alias("part"), F.lit(0).alias("side"))
    width = -np.log(percent / 100) * 1.0001
    banded = placed.where(~whole).select("id", "n", "family", F.floor(F.log("n") / width).cast("int").alias("band"))
    bands = banded.groupBy("family", "band").agg(F.greatest(F.ceil(F.count("*") / FAMILY_ROWS), F.ceil(F.sum("n") / FAMILY_TOKENS)).cast("int").alias("_p"))
    own = banded.join(bands, ["family", "band"]).withColumn("_m", F.pmod(F.xxhash64("id"), F.col("_p")).cast("int"))
    met = own.withColumn("_b", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    met = met.join(bands.select("family", F.col("band").alias("_b"), F.col("_p").alias("_q")), ["family", "_b"])
    met = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
    here, there = F.struct(F.col("band").alias("x"), F.col("_m").alias("y")), F.struct(F.col("_b").alias("x"), F.col("_o").alias("y"))
    side = F.when(here == there, 0).when(here < there, 1).otherwise(2)
    low, high = F.least(here, there), F.greatest(here, there)
    part = F.concat_ws("/", low["x"], low["y"], high["x"], high["y"])
    return small.unionByName(met.select("id", "n", "family", part.alias("part"), side.alias("side"))).distinct()


def _sums(s: np.ndarray) -> tuple[int, int]:
    return (int(s.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(s).astype(np.int64))) if len(s) else (0, 0)


def _sets(k: int):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            f1, f2 = zip(*map(_sums, sets), strict=True) if sets else ([], [])
            yield batch(schema, {"id": b.column(0), "tokens": [s.tobytes() for s in sets], "n": [len(s) for s in sets], "f1": f1, "f2": f2})
    return run


def _links(docs: DataFrame, places: DataFrame, weights: DataFrame | None, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all linked sets; ``places`` is the result of ``_families``. With ``weights`` (id, n, f1,
    f2, weight) of the sets that count, also rows with ``links`` (a, n, f1, f2): their sum is a set's number of links."""
    ids = materialised(places.select("id").distinct(), "members")
    few = ids.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = named.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(_sets(k), "id long, tokens binary, n int, f1 long, f2 long")
    if weights is None:
        sets = sets.withColumn("weight", F.lit(0).cast("long"))
    else:
        mine = materialised(weights.join(ids, "id", "left_semi"), "weights")
        sets = sets.join(F.broadcast(mine) if few and mine.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else mine, ["id", "n", "f1", "f2"], "left")
    there = places.withColumnRenamed("n", "_n")
    placed = sets.join(F.broadcast(there) if few and places.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else there, "id")
    # A set counts in the places of its own size; an id with several texts has others as well.
    weight = F.when(F.col("n") == F.col("_n"), F.coalesce("weight", F.lit(0))).otherwise(F.lit(0)).cast("long")
    ordered = placed.select("family", F.xxhash64("part").alias("part"), "side", "id", "f1", "f2", weight.alias("weight"), "tokens").repartition("family", "part").sortWithinPartitions("family", "part", "side", "id")
    return ordered.mapInArrow(_link_forest(percent, weights is not None), "a long, b long, n int, f1 long, f2 long, links long")


def near_components(docs: DataFrame, k: int = 4, percent: int = 85, count: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key (a hash of the text), n_shingles, component_id.

    Rows are linked where 100 * |intersection| >= ``percent`` * |union| of their shingle sets. Texts without words
    (null, empty, white space) have no shingle and no link. Repeated rows keep a row each and share a component;
    rows with one id and other texts are each placed by their own text, links of either count for both. A row with
    a null id has no link and a null component. With ``count`` there is also n_links, the number of links of a row's
    own text to documents with other ids, those with an equal set included; repeated rows are one document, and texts
    of one id with different sets are several. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = materialised(features(docs, k, percent), "features")
    rows = made.count()
    thin = made.select("doc_id", "text_key", "n", "f1", "f2")
    known = thin.where("n > 0 and doc_id is not null")
    classes = materialised(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.countDistinct("doc_id").alias("weight")), "classes", rows)
    copies = materialised(known.join(classes.where("rows > 1"), ["n", "f1", "f2"]).where("doc_id <> id").select("doc_id", "n", "f1", "f2"), "copies", rows)
    few = copies.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    reps = made.where("n > 0 and doc_id is not null").join(F.broadcast(copies) if few else copies, ["doc_id", "n", "f1", "f2"], "left_anti")
    counts = materialised(reps.select(F.explode("inner").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    common = spark.sparkContext.broadcast(_common(counts))
    heads = materialised(reps.select("doc_id", "n", "inner", "rest").mapInArrow(_prefixes(percent, common), "id long, first long, prefix array<long>"), "heads")
    listed = heads.select("id", F.explode("prefix").alias("token"))
    inside = (F.col("token") >= 0) & (F.col("token") < F.lit(1 << 62))
    shared = listed.where(inside).join(counts.select("token"), "token", "left_semi").unionByName(listed.where(~inside))
    postings = materialised(shared.distinct(), "postings")
    sizes = materialised(postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    nodes = reps.select(F.col("doc_id").alias("id"), "n", "m", "f1", "sig").join(heads.select("id", "first").distinct(), "id").dropDuplicates(["id", "n", "f1"])

    trees = materialised(_trees(postings, sizes), "trees").join(nodes, "id").select("token", "part", "side", "id", "n", "m", "first", "sig")
    ordered = trees.repartition("token", "part").sortWithinPartitions("token", "part", "side", "id")
    candidates = materialised(ordered.mapInArrow(_candidate_forest(percent), "a long, b long").distinct(), "candidates")
    family = components(candidates)
    sized = reps.select(F.col("doc_id").alias("id"), "n").distinct()
    members = materialised(family.withColumnRenamed("component", "family").join(sized, "id"), "families", rows)
    weights = classes.select("id", "n", "f1", "f2", "weight") if count else None
    links = materialised(_links(docs, materialised(_families(members, percent), "places"), weights, k, percent), "links")
    final = materialised(components(links.where("links is null").select("a", "b").distinct()), "components", rows)
    placed = classes.join(final, "id", "left")
    if count:
        others = links.where("links is not null").groupBy("n", "f1", "f2").agg(F.sum("links").alias("links"))
        placed = placed.join(others, ["n", "f1", "f2"], "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("links", F.lit(0)))
    number = ["n_links"] if count else []
    placed = placed.select("n", "f1", "f2", F.coalesce("component", "id").alias("component_id"), *number)
    out = thin.join(materialised(placed, "placed", rows), ["n", "f1", "f2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
                      *[F.when(F.col("doc_id").isNotNull(), F.coalesce(x, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(x) for x in number])


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of ``near_components``: the one with the smallest doc_id; of repeated rows one.

    Documents without words and rows with a null doc_id all stay. The result has the columns of ``docs``.
    """
    found = materialised(near_components(docs, k, percent), "near")
    rows = found.count()
    gone = materialised(found.where("doc_id <> component_id").select("doc_id", "text_key").distinct(), "gone", rows)
    twice = materialised(found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "twice", rows)
    match = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_key"])
    few = gone.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, match, "left_anti")
    if twice.isEmpty():
        return kept
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


@query("op1_jaccard_join")
def op1_jaccard_join(spark, sf):
    return near_components(table(spark, sf, "documents"), count=True).drop("text_key")
