"""Scans of directories of files."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths as P

#: Names taken in by default.
PATTERNS = ("*.md", "*.txt", "*.rst", "*.py", "*.js", "*.ts", "*.json", "*.yaml")


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = P.EXCLUDED, max_size: int = 10 << 20, content_limit: int = 20 << 10, max_files: int | None = None) -> DataFrame:
    """(path, name, size, language, last_modified, content) of the files below a root; content only up to a size.

    Hidden directories and excluded ones are left out, at the root too. ``max_files`` keeps the first by path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    prefix = re.sub(r"^file:/+", "/", top.getFileSystem(conf).makeQualified(top).toString()).rstrip("/")
    bare = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    relative = F.regexp_replace(F.replace(bare, F.lit(prefix), F.lit("")), "^/+", "")
    files = raw.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith("."))
    kept = files.where((F.col("size") <= max_size) & ~hidden & ~P.excluded(F.col("path"), exclude) & P.matches(P.name(F.col("path")), include))
    out = kept.select("path", P.name(F.col("path")).alias("name"), "size", P.language(F.col("path")).alias("language"), "last_modified", F.when(F.col("size") <= content_limit, F.decode("content", "UTF-8")).alias("content"))
    return out if max_files is None else out.orderBy("path").limit(max_files)


def ingest(spark: SparkSession, root: str, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Documents (id, source, content, metadata, created_at) of a directory; the id follows from the path, so reruns agree."""
    files = scan(spark, root, include=patterns, content_limit=10 << 20)
    meta = F.create_map(F.lit("filename"), F.col("name"), F.lit("extension"), P.extension(F.col("path")), F.lit("size_bytes"), F.col("size").cast("string"))
    return files.select(F.sha2("path", 256).alias("id"), F.col("path").alias("source"), "content", meta.alias("metadata"), F.col("last_modified").alias("created_at"))


def ingest_text(spark: SparkSession, content: str, source: str, metadata: dict[str, str] | None = None) -> DataFrame:
    row = spark.createDataFrame([(source, content, metadata or {})], "source string, content string, metadata map<string,string>")
    return row.select(F.sha2(F.concat_ws(":", "source", "content"), 256).alias("id"), "source", "content", "metadata", F.current_timestamp().alias("created_at"))


def single(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One document of one file."""
    raw = spark.read.format("binaryFile").load(path)
    meta = F.create_map(F.lit("filename"), P.name(F.col("path")), F.lit("extension"), P.extension(F.col("path")), F.lit("size_bytes"), F.col("length").cast("string"))
    return raw.select(F.sha2("path", 256).alias("id"), F.col("path").alias("source"), F.decode("content", encoding).alias("content"), meta.alias("metadata"), F.col("modificationTime").alias("created_at"))


def analyses(files: DataFrame) -> DataFrame:
    """Scanned files as rows for analysis: (path, size, language, content, file_hash)."""
    return files.select("path", "size", P.language(F.col("path")).alias("language"), "content", F.sha2("content", 256).alias("file_hash"))


#: Extensions of code.
CODE = ("py", "js", "ts", "java", "go", "rs", "cpp", "c", "cs", "rb", "php")


def code_files(files: DataFrame, most: int = 15, extensions: tuple[str, ...] = CODE) -> DataFrame:
    """The first code files by path, in the order of their extensions, outside of excluded folders."""
    kept = files.where(P.extension(F.col("path")).isin(*extensions) & ~P.excluded(F.col("path")))
    return kept.orderBy("path").limit(most).orderBy(P.extension(F.col("path")), "path")  # a page of a listing


def config(path: str | None = None, overrides: dict | None = None, prefix: str = "CORVANE_") -> dict:
    """Settings from a JSON or YAML file, then from the environment by prefix, then from overrides; later ones win."""
    out: dict = {}
    if path:
        with open(path) as f:
            text = f.read()
        try:
            out = json.loads(text)
        except ValueError:
            import yaml  # only for files in YAML

            out = yaml.safe_load(text) or {}
    out |= {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    return out | (overrides or {})
