"""Windows over the event stream, and incremental writes; every streaming query has a batch twin with the same plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.store import upsert


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with a zoned ``ts``, and a watermark if they are a stream."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late and out.isStreaming else out


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    g = timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", every: str = "15 minutes", late: str | None = "10 minutes") -> DataFrame:
    g = timed(events, late).groupBy(F.window("ts", width, every), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    g = timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")


def distinct(events: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """One event of each key; of a stream, within the watermark."""
    t = timed(events, late)
    return t.dropDuplicatesWithinWatermark(list(keys)) if t.isStreaming else t.dropDuplicates(list(keys))


def usage_stream(uses: DataFrame, key: str, order: str, helpful: str, confidence0: float = 0.5) -> DataFrame:
    """(key, usage_count, success_rate, confidence) after every batch of a stream of uses: a clamped running confidence as keyed state.

    Uses of one batch are taken in order; those of later batches follow. Only their times and results are held, 9 bytes a
    use. The batch twin is ``learning.usage_fold``.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, c = state.get if state.exists else (0, 0, confidence0)
        parts = [(f[order].to_numpy(), f[helpful].to_numpy(dtype=bool)) for f in frames]
        at, good = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for ok in good[np.argsort(at, kind="stable")].tolist():
            n, s = n + 1, s + ok
            c = max(0.0, min(1.0, c + (0.05 if ok else -0.02)))
        state.update((n, s, c))
        yield pd.DataFrame({key: [k[0]], "usage_count": [n], "success_rate": [round(s / n, 6)], "confidence": [round(c, 6)]})

    out = f"`{key}` {dict(uses.dtypes)[key]}, usage_count bigint, success_rate double, confidence double"
    narrow = uses.select(key, order, helpful)
    return narrow.groupBy(key).applyInPandasWithState(fold, out, "n bigint, s bigint, c double", "update", GroupStateTimeout.NoTimeout)


def _snapshots(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, list[int]]:
    """The batches that wrote each bucket, in order, from the names of the folders ``batch=N/bucket=B`` of whole batches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(conf)
    out: dict[int, list[int]] = {}
    for batch in fs.listStatus(root) if fs.exists(root) else []:
        name = batch.getPath().getName()
        if not name.startswith("batch=") or not fs.exists(path(batch.getPath(), "_SUCCESS")):
            continue
        number = int(name[6:])
        if before is None or number < before:
            for bucket in fs.listStatus(batch.getPath()):
                if bucket.getPath().getName().startswith("bucket="):
                    out.setdefault(int(bucket.getPath().getName()[7:]), []).append(number)
    return {b: sorted(n) for b, n in out.items()}


def _read(spark: SparkSession, folder: str, newest: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{folder}/batch={n}/bucket={b}" for b, n in sorted(newest.items())]) if newest else None


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that ``upsert_stream`` keeps in a folder: the newest snapshot of every bucket; None if there is none yet."""
    return _read(spark, folder, {b: n[-1] for b, n in _snapshots(spark, folder).items()})


def upsert_stream(changes: DataFrame, folder: str, key: str, order: str, checkpoint: str, keep: tuple[str, ...] = (), buckets: int = 64, kept: int = 2):
    """Writes a stream of changes into a table of buckets by the hash of the key; ``current`` reads it.

    A batch rewrites, in one job, only the buckets that its keys fall in, as new snapshots beside the old, and drops all but
    the newest ``kept`` of those buckets. A batch that is replayed after a failure starts from the snapshots before it and
    writes the same again, so the result is the same.
    """
    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(place).distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        older = {b: n for b, n in _snapshots(spark, folder, before=number).items() if b in touched}
        base = _read(spark, folder, {b: n[-1] for b, n in older.items()})
        after = upsert(batch.limit(0) if base is None else base, batch, key, order, keep).withColumn("bucket", place)
        after.repartition(min(buckets, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for b, numbers in older.items():
            for n in numbers[: max(0, len(numbers) - kept + 1)]:
                fs.delete(path(f"{folder}/batch={n}/bucket={b}"), True)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
