"""The store's writes as new snapshots: upserts, insert-ignore, cascading deletes, caches and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table after changes: of each key the change that is last in ``order`` wins; columns in ``keep`` stay as first stored.

    Both sides are narrowed per key before they meet, so redelivered rows cost one row for each task.
    """
    columns = base.columns
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("__new"))
    old = base.select(F.col(key), F.struct(*columns).alias("__old"))
    joined = old.join(last, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"__old.{c}"), F.col(f"__new.{c}")) if c in keep or c == key else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return joined.select(*[pick(c).alias(c) for c in columns])


def insert_ignore(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows of new keys added; of equal new keys one stays."""
    fresh = rows.dropDuplicates([key]).join(base.select(key), key, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def delete_cascade(parents: DataFrame, key: str, doomed: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents without the doomed keys, and each child table without the rows that refer to them."""
    gone = doomed.select(F.col(key).alias("__gone")).distinct()
    out = {"": parents.join(gone, F.col(key) == F.col("__gone"), "left_anti")}
    for name, (child, reference) in children.items():
        out[name] = child.join(gone, F.col(reference) == F.col("__gone"), "left_anti")
    return out


def counts(documents: DataFrame, chunks: DataFrame, questions: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row: documents, chunks, embedded chunks, questions, and the share of chunks that are embedded (0 without any)."""
    d = documents.agg(F.count("*").alias("documents"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    q = questions.agg(F.count("*").alias("questions"))
    row = d.crossJoin(c).crossJoin(q)  # single rows
    return row.withColumn("embedding_coverage", F.round(F.coalesce(F.try_divide(F.col("embedded"), F.col("chunks")), F.lit(0.0)), 6))


def page(documents: DataFrame, newest: str, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the newest rows; ties by key."""
    return documents.orderBy(F.desc(newest), key).offset(offset).limit(limit)


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(model), text), 256)


def cache_probe(texts: DataFrame, cache: DataFrame, model: str, text: str) -> DataFrame:
    """The texts with ``cache_key`` and whether the cache, keyed by ``cache_key``, holds them."""
    keyed = texts.withColumn("cache_key", cache_key(model, F.col(text)))
    return keyed.join(cache.select("cache_key", F.lit(True).alias("hit")).dropDuplicates(["cache_key"]), "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def live(cache: DataFrame, stored: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries that haven't outlived their time."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(stored)) <= ttl_seconds)


def lru_trim(cache: DataFrame, accessed: str, key: str, most: int) -> DataFrame:
    """The most recently used entries; ties by key. A top-k by sort, without a global window."""
    return cache.orderBy(F.desc(accessed), key).limit(most)


def latest(rows: DataFrame, by: str) -> DataFrame:
    """The newest row."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.col(by)).alias("r")).select("r.*")


def ranked_within(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def clear(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, deleted): the rows that clearing each table removes; the new snapshots are ``limit(0)`` of the old ones."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.lit(name).alias("tbl"), F.count("*").alias("deleted"))
        out = n if out is None else out.unionByName(n)
    return out


def save(df: DataFrame, folder: str, partition_by: str | None = None, mode: str = "append") -> None:
    """Bulk write of a table; appended or as a new snapshot."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)


def by_key(table: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of a key; the predicate reaches the scan."""
    return table.where(F.col(key) == F.lit(value))


def pieces_of(chunks: DataFrame, document: object) -> DataFrame:
    """A document's chunks in the order of their place."""
    return by_key(chunks, "document_id", document).orderBy("start_char", "id")


def upsert_facts(facts: DataFrame, changes: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """Facts after changes: a stored fact takes only confidence, usage_count and success_rate of its last change."""
    changing = ("confidence", "usage_count", "success_rate", order)
    return upsert(facts, changes, key, order, keep=tuple(c for c in facts.columns if c not in changing))


def ingest_summary(documents: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: documents in total, those with text and those without (failed), chunks and questions made of them."""
    full = F.length(F.trim(F.coalesce("content", F.lit("")))) > 0
    d = documents.agg(F.count("*").alias("total"), F.count_if(full).alias("succeeded"), F.count_if(~full).alias("failed"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(questions.agg(F.count("*").alias("questions")))  # single rows


def cache_stats(cache: DataFrame, size: str, hit: Column) -> DataFrame:
    """One row: entries, bytes, megabytes and the share of probes that hit."""
    row = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(hit).alias("hits"))
    return row.select("entries", "bytes", F.round(F.col("bytes") / float(1 << 20), 2).alias("megabytes"), F.round(F.coalesce(F.try_divide("hits", "entries"), F.lit(0.0)), 6).alias("hit_rate"))


def with_latest(stats: DataFrame, scores: DataFrame, by: str, *values: str) -> DataFrame:
    """The one row of counts with the values of the newest score; NULL without any."""
    newest = scores.agg(F.max_by(F.struct(by, *values), F.col(by)).alias("r"))
    return stats.crossJoin(newest.select(*[F.col(f"r.{v}").alias(f"latest_{v}") for v in (by, *values)]))  # single rows


def create_tables(rows: dict[str, DataFrame], database: str, keys: dict[str, str], buckets: int = 64) -> None:
    """Create the store's tables from (empty) frames, bucketed and sorted by their join key, so joins on it need no shuffle."""
    for name, df in rows.items():
        writer = df.write.mode("ignore").format("parquet")
        if name in keys:
            writer = writer.bucketBy(buckets, keys[name]).sortBy(keys[name])
        writer.saveAsTable(f"{database}.{name}")


def cache_write(entries: DataFrame, folder: str, buckets: int = 64) -> None:
    """Append entries to a cache in folders by the hash of their key; ``latest_by_key`` of a read gives the last written."""
    entries.withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(folder)


def latest_by_key(rows: DataFrame, key: str, by: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(by)).alias("r")).select("r.*")


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, rows, status): how many rows each table has; a table that can't be read is down."""
    out = []
    for name, df in tables.items():
        try:
            out.append((name, df.count(), "up"))
        except Exception:  # noqa: BLE001  whatever the reason, the report says so
            out.append((name, None, "down"))
    return next(iter(tables.values())).sparkSession.createDataFrame(out, "tbl string, rows bigint, status string")


def export_json(report: DataFrame, folder: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(folder)
