"""The margin accumulator with a state that closes.

State is kept row by row in Python workers: for streams that run on, whose state must not grow for ever.
A bounded folder is drained faster by ``aum_stream``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelq.operators.aum import margin


def accumulated(stream: DataFrame, n_epochs: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """(id, epochs, margins) of a stream of (id, epoch, target, logits): what a row has gathered, after each batch that changes it.

    The state of a row is one margin per epoch; an epoch that is delivered again changes nothing. It closes with
    the last of ``n_epochs`` epochs, or when nothing has come for ``idle_ms``; the timer keeps a query busy, so it is
    for streams that run on. Epochs that come after closing open a new state and are put together with the
    earlier ones by ``latest``, so closing loses nothing.
    Rows without a margin (null logits or target) are left out.
    """
    rows = stream.select("id", "epoch", margin().alias("m")).filter("epoch IS NOT NULL AND m IS NOT NULL")
    kind = dict(rows.dtypes)["id"]

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get)) if state.exists else {}
        before = len(held)
        for pdf in batches:
            for epoch, m in zip(pdf["epoch"].tolist(), pdf["m"].tolist()):
                held.setdefault(epoch, m)
        epochs = sorted(held)
        margins = [held[e] for e in epochs]
        if n_epochs is not None and len(epochs) >= n_epochs:
            state.remove()
        else:
            state.update((epochs, margins))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if len(held) > before:
            yield pd.DataFrame({"id": [key[0]], "epochs": [epochs], "margins": [margins]})

    return rows.groupBy("id").applyInPandasWithState(
        gather, f"id {kind}, epochs array<int>, margins array<double>", "epochs array<int>, margins array<double>",
        "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def start(stream: DataFrame, path: str, checkpoint: str, n_epochs: int | None = None, idle_ms: int | None = None):
    """Write every change to a parquet folder; a batch that is repeated after a failure overwrites its own part.

    Without ``idle_ms`` the query ends when all that has arrived is read; with it, it runs on.
    """
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = accumulated(stream, n_epochs, idle_ms).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if idle_ms is None else writer.trigger(processingTime="10 seconds")).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(id, aum, n_epochs): all changes of a row merged, one margin per epoch, the earliest delivered."""
    each = spark.read.parquet(path).select("id", "batch", F.explode(F.arrays_zip("epochs", "margins")).alias("v"))
    once = each.groupBy("id", F.col("v.epochs").alias("epoch")).agg(F.min_by("v.margins", "batch").alias("m"))
    state = once.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("epoch", "m"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["m"])
    return state.select("id", (total / F.size("s")).alias("aum"), F.size("s").cast("long").alias("n_epochs"))
