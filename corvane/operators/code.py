"""Code metrics, file clusters, findings and file trees."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.session import ship_package

_BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except|when)\b|&&|\|\||\?(?=[^:?]*:)")
_DEF = re.compile(r"^\s*(?:async\s+)?(?:def|function|func)\s+\w+|^\s*(?:public|private|protected|static)[\w<>\[\] ]+\(", re.MULTILINE)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def complexity(text: str, language: str) -> tuple[float, int, int, int]:
    """(mean cyclomatic complexity, lines of code, tokens, functions).

    Python by its syntax tree; other languages, and Python that doesn't parse, by counting branch words: an approximation.
    """
    lines = sum(1 for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "//", "/*", "*", "--")))
    tokens = len(_TOKEN.findall(text))
    if language.lower() == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            tree = None
        if tree is not None:
            functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
            kinds = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)
            each = [1 + sum(isinstance(x, kinds) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(f)) for f in functions]
            return (sum(each) / len(each) if each else 0.0, lines, tokens, len(each))
    functions = len(_DEF.findall(text))
    branches = len(_BRANCH.findall(text))
    return ((functions + branches) / functions if functions else 0.0, lines, tokens, functions)


def analyse(files: DataFrame, key: str, content: str, language: Column, size: Column, churn: Column | int = 0) -> DataFrame:
    """(key, complexity, nloc, token_count, function_count, score): score is complexity + size / 1000 + churn / 10."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [complexity(c or "", lang or "") for c, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int32(), pa.int32(), pa.int32()), strict=True)), batch.column(3), batch.column(4)], names=[key, "complexity", "nloc", "token_count", "function_count", "size", "churn"])

    narrow = files.select(key, F.col(content), language.alias("__l"), F.coalesce(size.cast("bigint"), F.lit(0)).cast("bigint").alias("size"), (F.lit(churn) if isinstance(churn, int) else churn).cast("bigint").alias("churn"))
    out = narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)[key]}, complexity double, nloc int, token_count int, function_count int, size bigint, churn bigint")
    return out.withColumn("score", F.round(F.col("complexity") + F.col("size") / 1000 + F.col("churn") / 10, 2))


def top(files: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return files.orderBy(F.desc(score), key).limit(n)


def group_summary(files: DataFrame, group: str, path: str, size: str, language: str) -> DataFrame:
    """(group, file_count, total_size, dominant_language, languages, prefix): two levels of counts, so no list of a group's files is gathered.

    Of equally frequent languages the first by name dominates; the prefix is that of the least and greatest path.
    """
    by = files.groupBy(group, F.coalesce(F.col(language), F.lit("Unknown")).alias("__l")).agg(F.count("*").alias("n"), F.sum(size).alias("s"), F.min(path).alias("low"), F.max(path).alias("high"))
    g = by.groupBy(group).agg(
        F.sum("n").alias("file_count"), F.sum("s").alias("total_size"), F.min_by("__l", F.struct(-F.col("n"), "__l")).alias("dominant_language"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__l", "n"))), lambda x: F.concat(x["__l"], F.lit("="), x["n"].cast("string"))), ",").alias("languages"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    return g.select(group, "file_count", "total_size", "dominant_language", "languages", P.common_prefix(F.col("low"), F.col("high")).alias("prefix"))


def representatives(files: DataFrame, group: str, size: str, key: str, per_group: int) -> DataFrame:
    """Files from the middle of each group's sizes: all of a small group, else those from ``(n - p) // 2`` on; ties by key.

    Counts by size tell in which few sizes the middle lies; only files of those sizes are put in order, so a large group is
    not sorted as a whole.
    """
    counts = files.groupBy(group, F.col(size).alias("__s")).agg(F.count("*").alias("__c"))
    sizes = Window.partitionBy(group)
    upto = F.sum("__c").over(sizes.orderBy(F.asc_nulls_first("__s")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("__n", F.sum("__c").over(sizes)).withColumn("__upto", upto)
    first = F.when(F.col("__n") <= per_group, 0).otherwise(F.greatest(F.floor((F.col("__n") - per_group) / 2), F.lit(0)))
    wanted = placed.withColumn("__first", first).withColumn("__before", F.col("__upto") - F.col("__c")).where((F.col("__upto") > F.col("__first")) & (F.col("__before") < F.col("__first") + per_group))
    middle = wanted.groupBy(group).agg(F.min(F.struct(F.col("__before"), F.col("__first"))).alias("m"))
    inside = files.alias("f").join(wanted.select(F.col(group).alias("__g"), "__s").alias("w"), F.col(f"f.{group}").eqNullSafe(F.col("__g")) & F.col(f"f.{size}").eqNullSafe(F.col("__s"))).select("f.*")
    ranked = inside.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_first(size), key)) - 1)
    joined = ranked.alias("r").join(middle.select(F.col(group).alias("__g"), F.col("m.__before").alias("__b"), F.col("m.__first").alias("__f")), F.col(f"r.{group}").eqNullSafe(F.col("__g")))
    return joined.where((F.col("__r") + F.col("__b") >= F.col("__f")) & (F.col("__r") + F.col("__b") < F.col("__f") + per_group)).select("r.*").drop("__r")


def path_tree(files: DataFrame, path: str, size: str) -> DataFrame:
    """(directory, depth, files, bytes) of every directory: each file counts in all its ancestors."""
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.select(F.explode(ancestors).alias("directory"), F.col(size).alias("__s"))
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum("__s").alias("bytes")).withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))))


def findings(files: DataFrame, key: str, issues: str, *keep: str) -> DataFrame:
    """(key, *keep, issue), one row for each issue."""
    return files.select(key, *keep, F.explode(issues).alias("issue"))


def rollup(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def term_statistics(files: DataFrame, key: str, content: str, most: int) -> DataFrame:
    """(term, df, tf): the terms in most files, of letters, digits and underscores, lower-cased; ties by term."""
    found = F.regexp_extract_all(F.lower(content), F.lit(r"([a-z_][a-z0-9_]*)"), 1)
    per_file = files.select(key, F.explode(found).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return per_file.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).orderBy(F.desc("df"), F.desc("tf"), "term").limit(most)


def cluster(files: DataFrame, key: str, content: str, clusters: int = 5, features: int = 1000, seed: int = 42) -> DataFrame:
    """(key, cluster): TF-IDF over the commonest terms and k-means; fewer files than clusters form cluster 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover

    rows = files.select(key, F.coalesce(F.col(content), F.lit("")).alias("__c"))
    if rows.limit(clusters).count() < clusters:
        return rows.select(key, F.lit(0).alias("cluster"))
    stages = [
        RegexTokenizer(inputCol="__c", outputCol="__w", gaps=False, pattern="[a-zA-Z_][a-zA-Z0-9_]*"), StopWordsRemover(inputCol="__w", outputCol="__k"), CountVectorizer(inputCol="__k", outputCol="__f", vocabSize=features),
        IDF(inputCol="__f", outputCol="__i"), Normalizer(inputCol="__i", outputCol="__x"), KMeans(featuresCol="__x", predictionCol="cluster", k=clusters, seed=seed),
    ]
    return Pipeline(stages=stages).fit(rows).transform(rows).select(key, "cluster")
