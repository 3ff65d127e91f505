"""Order-dependent operations that never sort a whole table, or one hot group, in a single task.

``take_first``  the n smallest rows of each group, by counting hash buckets and cutting at one row
``ranked``      exact row numbers, from ranks inside order-preserving buckets plus bucket offsets
``quantile``    exact interpolated quantiles, by bracketing them with a sketch and counting digits in the bracket
``halo``        rows of a long series cut into chunks that overlap, so bounded frames stay correct

Keys of ``take_first`` and ``quantile`` must have few values (classes, rounds, methods): their
per-key cut tables hold one row per key. Keys of ``ranked`` and ``halo`` may be many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.session import materialised

BUCKET_SHIFT = 18  # 2^14 buckets of a 32-bit hash
DIGIT = 16  # bits a counted pass of ``quantile`` looks at


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Add the columns of a table of bounded size: one row (no keys) or one row per class."""
    keys = list(keys)
    if not keys:
        cols = small.columns
        one = small.agg(F.first(F.struct(*cols)).alias("s"))
        return df.withColumn("_one", one.scalar()).select(*df.columns, *[F.col("_one")[c].alias(c) for c in cols])
    return df.join(F.broadcast(small), keys, how)


def cut_rows(df: DataFrame, n: Column, order: Column, tie: Column, keys: Sequence[str] = ()) -> list[Row]:
    """Per key (keys.., group_rows, n, cut_order, cut_tie): the n-th smallest row by (order, tie).

    ``order`` is a non-negative long, usually a keyed hash; ``n`` is an expression over ``group_rows``.
    Two thin passes run at once: bucket counts, then the rows of one boundary bucket per key. One row
    per key reaches the driver, and the caller's plan is left with constants.
    """
    keys = list(keys)
    spark = df.sparkSession
    thin = df.select(*keys, order.alias("_o"), tie.alias("_t")).withColumn("_b", F.shiftright("_o", BUCKET_SHIFT))
    w = W.partitionBy(*keys)
    hist = (
        thin.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
        .withColumn("group_rows", F.sum("_c").over(w))
        .withColumn("_cum", F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("n", n.cast("long"))
    )
    before = F.col("_cum") - F.col("_c")
    holds = (F.col("_cum") >= F.col("n")) & (before < F.col("n"))
    edges = hist.groupBy(*keys).agg(
        F.max("group_rows").alias("group_rows"), F.max("n").alias("n"),
        F.max(F.when(holds, F.struct("_b", (F.col("n") - before).alias("need")))).alias("e"))
    schema = edges.schema
    found = edges.collect()
    some = [r for r in found if r["e"] is not None]
    if keys:
        wanted = spark.createDataFrame(some, schema).select(*keys, "e._b", "e.need")
        inner = thin.join(F.broadcast(wanted), [*keys, "_b"])
    elif some:
        inner = thin.filter(F.col("_b") == some[0]["e"]["_b"]).withColumn("need", F.lit(some[0]["e"]["need"]))
    else:
        inner = thin.withColumn("need", F.lit(0)).limit(0)
    inner = inner.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_o", "_t")))
    rows = inner.filter(F.col("_rn") == F.col("need")).select(*keys, F.col("_o").alias("cut_order"), F.col("_t").alias("cut_tie"))
    cuts = {tuple(r[k] for k in keys): r for r in rows.collect()}
    none = Row(cut_order=None, cut_tie=None)
    out = []
    for r in found:
        c = cuts.get(tuple(r[k] for k in keys), none)
        out.append(Row(**{k: r[k] for k in keys}, group_rows=r["group_rows"], n=r["n"], cut_order=c["cut_order"], cut_tie=c["cut_tie"]))
    return out


def flag_first(df: DataFrame, n: Column, order: Column, tie: Column, keys: Sequence[str] = (), out: str = "taken") -> DataFrame:
    """Add a 0/1 flag for the ``n`` smallest rows by (order, tie), per key; no row is moved."""
    keys = list(keys)
    cuts = cut_rows(df, n, order, tie, keys)
    if not cuts:
        return df.withColumn(out, F.lit(0))
    probe = df.select(*keys, order.alias("cut_order"), tie.alias("cut_tie")).schema
    names = {"_g": "group_rows", "_n": "n", "_co": "cut_order", "_ct": "cut_tie"}
    types = {"_g": T.LongType(), "_n": T.LongType(), "_co": T.LongType(), "_ct": probe["cut_tie"].dataType}
    if keys:
        schema = T.StructType([*[probe[k] for k in keys], *[T.StructField(c, types[c]) for c in names]])
        local = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) + tuple(r[v] for v in names.values()) for r in cuts], schema)
        wide = df.join(F.broadcast(local), keys, "left")
        cell = {c: F.col(c) for c in names}
    else:
        wide = df
        cell = {c: F.lit(cuts[0][v]).cast(types[c]) for c, v in names.items()}
    inside = (order < cell["_co"]) | ((order == cell["_co"]) & (tie <= cell["_ct"]))
    flag = (cell["_n"] >= cell["_g"]) | ((cell["_n"] > 0) & F.coalesce(inside, F.lit(False)))
    return wide.withColumn(out, F.coalesce(flag, F.lit(False)).cast("int")).drop(*names)


def take_first(df: DataFrame, n: Column, order: Column, tie: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` smallest rows by (order, tie), per key."""
    return flag_first(df, n, order, tie, keys, out="_taken").filter("_taken = 1").drop("_taken")


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    tie: Column,
    last: Sequence[Column] = (),
    out: str = "rank",
    bucket: Column | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Exact 1-based row number by (value, tie, *last) within ``keys``.

    Rows are spread over (keys, bucket), where buckets follow the order: either a given
    order-preserving ``bucket``, or global sketch splits of ``value``; rows that equal a split
    (heavy ties) are spread further by splits of ``tie``. The splits only steer the load, the
    result is exact whatever they are. ``value`` and ``tie`` must be numeric. A row with a null key
    gets a null rank.
    """
    keys = list(keys)
    names = df.columns
    base = df.withColumn("_v", value).withColumn("_t", tie)
    if bucket is None:
        grid = [i / buckets for i in range(1, buckets)]
        # Fetched now (2 * buckets numbers): numbering and offsets below must see the same splits.
        found = df.select(value.cast("double").alias("_v"), tie.cast("double").alias("_t")).agg(
            F.percentile_approx("_v", grid, 10000), F.percentile_approx("_t", grid, 10000)).first()
        by_value, by_tie = (F.array(*[F.lit(x) for x in sorted(set(f or [0.0]))]) for f in found)
        v, t = F.col("_v").cast("double"), F.col("_t").cast("double")
        below = F.size(F.filter(by_value, lambda s: s < v))
        equal = F.array_contains(by_value, v)
        sub = F.when(equal, F.size(F.filter(by_tie, lambda s: s < t))).otherwise(F.lit(0))
        base = base.withColumn("_b", (below * 2 + equal.cast("int")) * F.lit(buckets) + sub)
    else:
        base = base.withColumn("_b", bucket)
    counts = base.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    offsets = counts.select(
        *keys, "_b",
        F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    numbered = base.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(F.col("_v"), F.col("_t"), *last)))
    # Plain equality keeps the partitioning of the numbering, so the rows are shuffled once.
    joined = numbered.join(offsets, [*keys, "_b"], "left")
    return joined.select(*names, (F.col("_rn") + F.col("_off")).cast("long").alias(out))


def quantile(
    df: DataFrame,
    value: str,
    fraction: float | DataFrame,
    keys: Sequence[str] = (),
    out: str = "quantile",
    grid: int = 1000,
) -> DataFrame:
    """Exact linearly interpolated quantile per key, one row per key: (keys, group_rows, out).

    ``fraction`` is a number, or a table (keys, fraction) or (keys, position) with a share, or a
    0-based place in ascending order, for every key.
    """
    keys = list(keys)
    thin = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sketch = thin.groupBy(*keys).agg(
        F.count("*").alias("group_rows"),
        F.percentile_approx("_v", [i / grid for i in range(grid + 1)], 10000).alias("_q"))
    last = F.greatest(F.col("group_rows") - 1, F.lit(1))
    if isinstance(fraction, DataFrame):
        by_position = "position" in fraction.columns
        given = F.col("position" if by_position else "fraction").cast("double")
        sketch = attach(sketch, fraction.select(*keys, given.alias("_g")), keys, "inner")
        position = F.col("_g") if by_position else F.col("_g") * (F.col("group_rows") - 1)
    else:
        position = F.lit(float(fraction)) * (F.col("group_rows") - 1)
    # The sketch is off by at most a fraction of a grid step; one row more or less matters in small groups.
    i = F.floor(position / last * grid)
    margin = 3 + F.ceil(2.0 * grid / F.col("group_rows"))
    inf = F.lit(float("inf"))
    bounds = sketch.select(
        *keys, "group_rows", position.alias("_pos"),
        F.when(i < margin, -inf).otherwise(F.get("_q", (i - margin).cast("int"))).alias("_lo"),
        F.when(i > grid - margin - 1, inf).otherwise(F.get("_q", (i + margin + 1).cast("int"))).alias("_hi"))
    near = attach(thin, bounds, keys, "inner").filter(F.col("_v") <= F.col("_hi"))
    # Everything under the bracket collapses into one counted row before the shuffle.
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")
    cells = near.groupBy(*keys, "group_rows", "_pos", inside).agg(F.count("*").alias("_c"))
    cells = materialised(cells.withColumn("_i", ordered_image(F.col("_v"))), "bracket")
    # _need: 0-based place among the cells of the bracket; no row below the bracket means no such cell.
    below = F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0))
    pick = cells.groupBy(*keys, "group_rows", "_pos").agg(below.alias("_below"))
    pick = pick.select(*keys, (F.floor("_pos") - F.col("_below")).alias("_need"), F.lit(0).cast("long").alias("_p"))
    inner = cells.filter(F.col("_v").isNotNull())
    for shift in range(64 - DIGIT, -1, -DIGIT):
        pick = _next_digit(inner, pick, keys, shift)
    # All bits are fixed: the lower value, its copies, and the smallest value above it.
    top = attach(inner, pick, keys, "inner").filter(F.col("_i") >= F.col("_p"))
    at = F.col("_i") == F.col("_p")
    picked = top.groupBy(*keys, "group_rows", "_pos", "_need").agg(
        F.min("_v").alias("_a"), F.sum(F.when(at, F.col("_c"))).alias("_n"), F.min(F.when(~at, F.col("_v"))).alias("_z"))
    upper = F.when(F.col("_n") > F.col("_need") + 1, F.col("_a")).otherwise(F.coalesce("_z", "_a"))
    part = F.col("_pos") - F.floor("_pos")
    step = F.when(part == 0, 0.0).otherwise((upper - F.col("_a")) * part)
    return picked.select(*keys, "group_rows", (F.col("_a") + step).alias(out))


def ordered_image(x: Column) -> Column:
    """A long in the order of the double ``x``: its bits, negated for negative numbers; NaN comes last.

    The exponent comes from the logarithm, corrected by one where that rounds; powers of two and the
    divisions by them are exact. Both zeros are 0; null stays null.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    two = F.lit(2.0)
    e = guess + F.when(size >= F.pow(two, guess + 1), 1).when(size < F.pow(two, guess), -1).otherwise(0)
    normal = (e + 1023) * F.lit(1 << 52) + ((size / F.pow(two, e) - 1.0) * F.lit(float(1 << 52))).cast("long")
    tiny = (size * F.lit(2.0 ** 1022) * F.lit(2.0 ** 52)).cast("long")
    bits = (F.when(F.isnan(x), 0x7FF8 << 48).when(size == float("inf"), 0x7FF0 << 48)
            .when(size < 2.0 ** -1022, tiny).otherwise(normal))
    return F.when(x.isNull(), F.lit(None)).when((x < 0) & ~F.isnan(x), -bits).otherwise(bits).cast("long")


def _next_digit(cells: DataFrame, pick: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """Fix one more digit of the wanted image per key: (keys, _need, _p) with ``_p`` the bits down to ``shift``.

    At most 2^DIGIT counts per key are put in order, however many values the bracket holds.
    """
    found = attach(cells, pick, keys, "inner")
    if shift + DIGIT < 64:
        found = found.filter(F.shiftright("_i", shift + DIGIT) == F.col("_p"))
    counts = found.groupBy(*keys, "_need", F.shiftright("_i", shift).alias("_d")).agg(F.sum("_c").alias("_c"))
    w = W.partitionBy(*keys).orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
    before = F.col("_cum") - F.col("_c")
    place = counts.withColumn("_cum", F.sum("_c").over(w)).filter((F.col("_cum") > F.col("_need")) & (before <= F.col("_need")))
    return place.select(*keys, (F.col("_need") - before).alias("_need"), F.col("_d").alias("_p"))


def halo(df: DataFrame, t: str, length: int, pad: int) -> DataFrame:
    """Cut series into chunks of ``length`` steps, each with ``pad`` steps of its neighbours.

    Adds ``chunk`` and ``core`` (false for the borrowed rows). Frames reaching at most ``pad`` rows
    away are right for core rows when windows partition by (series, chunk).
    """
    own = F.floor(F.col(t) / length)
    first = F.greatest(F.floor((F.col(t) - pad) / length), F.lit(0))
    last = F.floor((F.col(t) + pad) / length)
    return (
        df.withColumn("chunk", F.explode(F.sequence(first, last)))
        .withColumn("core", F.col("chunk") == own)
    )
