"""Top-k retrieval by vectors and by words, and the fusion of two rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import words
from corvane.session import ship_package

#: Query vectors multiplied at a time, so a task's memory is bounded whatever the number of queries.
QUERY_BLOCK = 2048
#: The number of query vectors up to which they are sent to every task; more are taken in turns of this many.
QUERIES_AT_ONCE = 20_000
#: The number of query vectors that one call takes; for more, the neighbours of all rows are a task for an index.
MOST_QUERIES = 200_000
K1, B = 1.2, 0.75


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NULL for a NULL or zero vector, or for different widths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


def vector_topk(items: DataFrame, key: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """(key, similarity, rank): the k items most similar to the one vector of ``query`` (a single row)."""
    one = query.select(F.col(vector).alias("__query")).limit(1)
    scored = items.crossJoin(F.broadcast(one)).select(key, F.round(cosine(F.col(vector), F.col("__query")), 6).alias("similarity"))  # one row is broadcast
    best = scored.where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))  # k rows


def vector_topk_batch(items: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int) -> DataFrame:
    """(query_id, key, similarity, rank): the k items most similar to each query vector.

    A stated set of queries is held against all items: the query vectors go out in blocks of bounded size, each task keeps
    its own k best of each query, and only those are shuffled. Zero, NULL and wrongly sized vectors take no part. More than
    ``MOST_QUERIES`` queries are refused.
    """
    ship_package(items.sparkSession)
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint"), vector)
    number = rows.count()
    if number > MOST_QUERIES:
        raise ValueError(f"a query set may have {MOST_QUERIES} rows at most")
    turns, parts = max(1, -(-number // QUERIES_AT_ONCE)), []
    for turn in range(turns):  # one for any stated query set of usual size
        held = rows.where(F.pmod(F.xxhash64(query_key), F.lit(turns)) == turn).collect()
        width = len(held[0][1]) if held else 1
        good = [(r[0], r[1]) for r in held if len(r[1]) == width and any(r[1]) and None not in r[1]]
        ids = np.array([r[0] for r in good], np.int64)
        q = np.array([r[1] for r in good], np.float64).reshape(-1, width)
        q /= np.linalg.norm(q, axis=1, keepdims=True) if len(q) else 1

        def best(batches: Iterator[pa.RecordBatch], ids=ids, q=q, width=width) -> Iterator[pa.RecordBatch]:
            top_sim = np.full((len(q), k), -np.inf)
            top_key = np.full((len(q), k), np.iinfo(np.int64).max)
            for batch in batches:
                lists = batch.column(1)
                fits = np.flatnonzero((np.diff(lists.offsets.to_numpy()) == width) & ~lists.is_null().to_numpy(zero_copy_only=False))
                x = lists.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
                norms = np.linalg.norm(x, axis=1)
                ok = np.isfinite(norms) & (norms > 0)
                keys, x = batch.column(0).to_numpy(zero_copy_only=False)[fits][ok], x[ok] / norms[ok, None]
                for a in range(0, len(q) if len(keys) else 0, QUERY_BLOCK):  # the task's best so far against the batch
                    b = min(len(q), a + QUERY_BLOCK)
                    sims = np.concatenate((top_sim[a:b], np.round(q[a:b] @ x.T, 6)), axis=1)
                    names = np.concatenate((top_key[a:b], np.broadcast_to(keys, (b - a, len(keys)))), axis=1)
                    order = np.lexsort((names, -sims), axis=1)[:, :k]
                    top_sim[a:b], top_key[a:b] = np.take_along_axis(sims, order, 1), np.take_along_axis(names, order, 1)
            found = np.isfinite(top_sim)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(axis=1))), pa.array(top_key[found]), pa.array(top_sim[found])], names=["query_id", key, "similarity"])

        parts.append(items.select(F.col(key).cast("bigint"), vector).mapInArrow(best, f"query_id bigint, {key} bigint, similarity double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)))
    return ranked.where(F.col("rank") <= k)


def postings(documents: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, length): the inverted index of a corpus, terms counted where their document lies; of the terms in
    ``terms`` only, if given, which are sifted out ahead of the shuffle where Spark finds them small enough to broadcast."""
    split = documents.select(key, words(F.col(text)).alias("__w"))
    every = split.select(key, F.size("__w").alias("length"), F.explode("__w").alias("term"))
    return (every if terms is None else every.join(terms.select("term").distinct(), "term", "left_semi")).groupBy("term", key, "length").agg(F.count("*").alias("tf")).select("term", key, "tf", "length")


def write_index(documents: DataFrame, key: str, text: str, folder: str, buckets: int = 64) -> None:
    """Write the inverted index: postings in folders by the hash of their term, in order of terms within files, and the
    statistics of the corpus. A search reads the folders of its terms, and of those only the row groups that hold them."""
    index = postings(documents, key, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    index.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    documents.agg(F.count("*").alias("docs"), F.avg(F.size(words(F.col(text)))).alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/statistics")


def open_index(spark: SparkSession, folder: str, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """(postings of the terms, statistics) of a written index: folders and row groups are pruned by the terms."""
    statistics = spark.read.parquet(f"{folder}/statistics")
    buckets = statistics.first()["buckets"]
    hashed = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).collect()
    index = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(sorted({r[0] for r in hashed})) & F.col("term").isin(terms))
    return index.drop("bucket"), statistics


def bm25_of(matches: DataFrame, statistics: DataFrame, key: str, *group: str) -> DataFrame:
    """(*group, key, score) from (*group, key, term, tf, length, df) and the corpus's (docs, mean), one row."""
    joined = matches.crossJoin(F.broadcast(statistics.select("docs", "mean")))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy(*group, key).agg(F.round(F.sum(part), 6).alias("score"))


def indexed_topk(spark: SparkSession, folder: str, key: str, terms: list[str], k: int, every: bool = False) -> DataFrame:
    """(key, score, rank) of the best documents by a written index; with ``every``, of those that hold all terms."""
    index, statistics = open_index(spark, folder, terms)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    scores = bm25_of(index.join(F.broadcast(df), "term"), statistics, key)  # as many rows as terms
    if every:
        full = index.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(set(terms)))
        scores = scores.join(full.select(key), key, "left_semi")
    best = scores.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def bm25_batch(documents: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query; ``queries`` has query_id, term, a row for each term.

    One pass over the corpus serves all queries: postings meet the queries' terms by one join, whose hot terms adaptive
    skew handling splits, and the k best of a query are cut in each task first.
    """
    wanted = queries.select("query_id", "term").distinct()
    index = postings(documents, key, text, wanted)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    statistics = documents.agg(F.count("*").alias("docs"), F.avg(F.size(words(F.col(text)))).alias("mean"))
    scores = bm25_of(index.join(wanted.join(df, "term"), "term"), statistics, key, "query_id")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


def term_matches(documents: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, length, term, tf): how often each term occurs in each document that has any, with the document's length.

    Words of a document are counted where it lies; only documents that match are kept.
    """
    wanted = F.array(*[F.lit(t) for t in terms])
    split = documents.select(key, words(F.col(text)).alias("__w"))
    hits = split.select(key, F.size("__w").alias("length"), F.explode(F.transform(wanted, lambda t: F.struct(t.alias("term"), F.size(F.filter("__w", lambda w: w == t)).alias("tf")))).alias("t"))
    return hits.select(key, "length", "t.term", "t.tf").where(F.col("tf") > 0)


def bm25(documents: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) of every document with a term; scores rounded to 6 decimals. Statistics cover all documents."""
    sized = documents.select(F.size(words(F.col(text))).alias("n"))
    totals = sized.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    matches = term_matches(documents, key, text, terms)
    df = matches.groupBy("term").agg(F.count("*").alias("df"))
    joined = matches.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # as many rows as terms, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def bm25_topk(documents: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    best = bm25(documents, key, text, terms).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def fulltext_and(documents: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    """(key, hits, rank): documents that hold every term, by the number of occurrences."""
    full = term_matches(documents, key, text, terms).groupBy(key).agg(F.sum("tf").alias("hits"), F.count("*").alias("n")).where(F.col("n") == len(set(terms)))
    best = full.select(key, "hits").orderBy(F.desc("hits"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), key)))  # k rows


def fuse_batch(by_vector: DataFrame, by_text: DataFrame, key: str, alpha: float = 0.5, k: int = 60, top: int = 5) -> DataFrame:
    """(query_id, key, combined_score, rank): weighted reciprocal rank fusion of both rankings of each query."""
    v = by_vector.select("query_id", key, F.col("rank").alias("rank_v"))
    b = by_text.select("query_id", key, F.col("rank").alias("rank_b"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))
    fused = v.join(b, ["query_id", key], "full_outer").withColumn("combined_score", F.round(part(float(alpha), "rank_v") + part(1.0 - alpha, "rank_b"), 9))
    order = [F.desc("combined_score"), F.asc_nulls_last("rank_v"), F.asc_nulls_last("rank_b"), F.asc(key)]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top).select("query_id", key, "combined_score", "rank")


def fuse(by_vector: DataFrame, by_text: DataFrame, key: str, alpha: float = 0.5, k: int = 60, top: int = 10, min_score: float = 0.0) -> DataFrame:
    """(key, combined_score, rank_v, rank_b, rank): weighted reciprocal rank fusion of two rankings with a ``rank``.

    A missing rank adds nothing. Ties: the vector ranking first, then the text ranking, then the key.
    """
    v = by_vector.select(key, F.col("rank").alias("rank_v"))
    b = by_text.select(key, F.col("rank").alias("rank_b"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))
    score = F.round(part(float(alpha), "rank_v") + part(1.0 - alpha, "rank_b"), 9)
    order = [F.desc("combined_score"), F.asc_nulls_last("rank_v"), F.asc_nulls_last("rank_b"), F.asc(key)]
    fused = v.join(b, key, "full_outer").withColumn("combined_score", score).where(F.col("combined_score") >= min_score)
    return fused.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top rows


def hybrid_search(items: DataFrame, documents: DataFrame, key: str, vector: str, text: str, query: DataFrame, terms: list[str], top: int = 5, alpha: float = 0.5, fetch: int = 20, min_score: float = 0.0) -> DataFrame:
    """The best of both rankings: ``fetch`` rows by vectors and by words each, fused, cut at a score and at ``top``."""
    v = vector_topk(items, key, vector, query, fetch)
    b = bm25_topk(documents, key, text, terms, fetch)
    return fuse(v, b, key, alpha, top=top, min_score=min_score)
