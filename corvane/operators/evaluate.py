"""Knowledge evaluation: precision, accuracy and coverage of retrieval, the weighted score, trends and improvement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def question_scores(retrieved: DataFrame, threshold: float = 0.3, score: str = "combined_score", limit: int = 2000) -> DataFrame:
    """(question_id, precision, accuracy): retrieved has question_id, expected_answer, chunk content, a score and a rank.

    Precision is the share of chunks whose score reaches the threshold; the context is the chunks in order, cut to a length.
    """
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n")
    grouped = retrieved.groupBy("question_id").agg(F.first("expected_answer").alias("expected_answer"), F.avg(F.when(F.col(score) >= threshold, 1.0).otherwise(0.0)).alias("precision"), F.left(ordered, F.lit(limit)).alias("context"))
    return grouped.select("question_id", F.round("precision", 6).alias("precision"), F.round(T.accuracy(F.col("expected_answer"), F.col("context")), 6).alias("accuracy"))


def evaluation(scores: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: mean precision and accuracy, the share of embedded chunks retrieved at all, and the weighted score."""
    means = scores.agg(F.count("*").alias("questions_evaluated"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("p"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("a"))
    seen = retrieved.agg(F.count_distinct("chunk_id").alias("seen"))
    all_ = chunks.agg(F.count("embedding").alias("embedded"))
    row = means.crossJoin(seen).crossJoin(all_).withColumn("c", F.coalesce(F.try_divide(F.col("seen"), F.col("embedded")), F.lit(0.0)))  # single rows
    return row.select("questions_evaluated", F.round("p", 6).alias("retrieval_precision"), F.round("a", 6).alias("answer_accuracy"), F.round("c", 6).alias("coverage_ratio"), F.round(T.overall_score(F.col("p"), F.col("a"), F.col("c")), 6).alias("overall_score"))


def trend(scores: DataFrame, at: str, days: int = 30, **values: Column) -> DataFrame:
    """(day, evaluations, means) of the newest ``3 days`` scores by day."""
    newest = scores.orderBy(F.desc(at), *[c for c in scores.columns if c != at][:1]).limit(days * 3)
    means = [F.round(F.avg(v), 6).alias(n) for n, v in values.items()]
    return newest.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("evaluations"), *means)


def deltas(scores: DataFrame, at: str, value: str) -> DataFrame:
    """(day, mean, delta): the mean score of each day with its change from the day before that has any; a window over days."""
    daily = scores.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.round(F.avg(value), 6).alias("mean"))
    return daily.withColumn("delta", F.round(F.col("mean") - F.lag("mean").over(Window.orderBy("day")), 6))  # a row for each day


def improvement(scores: DataFrame, value: str, at: str) -> DataFrame:
    """(first, last, percent): the change from the first to the last score."""
    ends = scores.agg(F.min_by(value, F.col(at)).alias("first"), F.max_by(value, F.col(at)).alias("last"))
    return ends.withColumn("percent", F.round(F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100, 6))


def durations(rows: DataFrame, group: str, value: str, passed: Column) -> DataFrame:
    """(group, runs, passed, total, mean, least, most) of durations."""
    return rows.groupBy(group).agg(F.count("*").alias("runs"), F.count_if(passed).alias("passed"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def with_model_scores(scores: DataFrame, reply: str) -> DataFrame:
    """The scores with ``accuracy`` from a model's reply (a column with its JSON) where it holds one, else as they are."""
    return scores.withColumn("accuracy", T.model_score(F.col(reply), F.col("accuracy")))


def store_score(row: DataFrame, folder: str, at: Column | None = None) -> None:
    """Append an evaluation to the table of scores; one without questions isn't stored."""
    row.where(F.col("questions_evaluated") > 0).withColumn("created_at", F.current_timestamp() if at is None else at).write.mode("append").parquet(folder)


def slowest(rows: DataFrame, key: str, value: str, over: float = 1.0, most: int = 5) -> DataFrame:
    """The slowest operations above a duration."""
    return rows.where(F.col(value) > over).orderBy(F.desc(value), key).limit(most)
