"""A Python data source that lists the files of hosted repositories from a client; offline the client reads JSON files."""

from __future__ import annotations

import base64
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions import paths as P
from corvane.session import ship_package

SCHEMA = "repo string, path string, name string, type string, size bigint, sha string, content string, encoding string"


class Folder(InputPartition):
    def __init__(self, repo: str, path: str) -> None:
        self.repo, self.path = repo, path


class _Reader(DataSourceReader):
    """One partition for each directory below the root of each repository; deeper ones are followed inside it."""

    def __init__(self, root: str, depth: int) -> None:
        self.root, self.depth = root, depth

    def _listing(self, repo: str, path: str) -> list[dict]:
        file = os.path.join(self.root, *repo.split("/"), *[p for p in path.split("/") if p], "listing.json")
        if not os.path.exists(file):
            return []
        with open(file) as f:
            found = json.load(f)
        return [found] if isinstance(found, dict) else found  # a single file is answered as an object

    def partitions(self) -> list[Folder]:
        out = []
        for owner in sorted(os.listdir(self.root)):
            if os.path.isdir(os.path.join(self.root, owner)):
                for name in sorted(os.listdir(os.path.join(self.root, owner))):
                    repo = f"{owner}/{name}"
                    out.append(Folder(repo, ""))
                    out += [Folder(repo, e["path"]) for e in self._listing(repo, "") if e["type"] == "dir"]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [(partition.path, 1 if partition.path else 0)]
        while todo:
            path, depth = todo.pop()
            for e in self._listing(partition.repo, path):
                yield (partition.repo, e["path"], e.get("name") or e["path"].rsplit("/", 1)[-1], e["type"], e.get("size"), e.get("sha"), e.get("content"), e.get("encoding"))
                if e["type"] == "dir" and partition.path and depth < self.depth:
                    todo.append((e["path"], depth + 1))


class HostedFiles(DataSource):
    """``spark.read.format("hosted_files").load(folder)``: every entry of the repositories whose listings lie in a folder."""

    @classmethod
    def name(cls) -> str:
        return "hosted_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], int(self.options.get("depth", "10")))


def hosted(spark: SparkSession, folder: str, depth: int = 10) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(HostedFiles)
    return spark.read.format("hosted_files").option("depth", str(depth)).load(folder)


def decoded(files: DataFrame) -> DataFrame:
    """The files with base64 content decoded; content that can't be decoded stays."""
    clean = F.regexp_replace("content", r"\s", "")
    plain = F.when(F.col("encoding") == "base64", F.coalesce(F.decode(F.try_to_binary(clean, F.lit("base64")), "UTF-8"), F.col("content"))).otherwise(F.col("content"))
    return files.withColumn("content", plain)


def scan(files: DataFrame, max_size: int = 100_000, include: tuple[str, ...] = ("*",), max_files: int | None = None) -> DataFrame:
    """Files of a listing within the size, not excluded and included, with their language; the first by path with a cap."""
    kept = files.where((F.col("type") == "file") & (F.coalesce("size", F.lit(0)) <= max_size) & ~P.excluded(F.col("path")) & (P.matches(F.col("path"), include) | P.matches(P.name(F.col("path")), include)))
    out = kept.withColumn("language", P.language(F.col("path")))
    return out if max_files is None else out.orderBy("path").limit(max_files)


def encode(text: str) -> str:
    return base64.encodebytes(text.encode()).decode()


#: What a host tells of a repository, by file of its listing: the schema of one entry.
ABOUT = {
    "repository": "full_name string, description string, default_branch string, stargazers_count bigint, language string",
    "branches": "name string, protected boolean, commit struct<sha:string>",
    "pulls": "number bigint, title string, state string, user struct<login:string>, created_at timestamp, merged_at timestamp",
    "commits": "sha string, commit struct<message:string,author:struct<name:string,date:timestamp>>",
}


def about(spark: SparkSession, folder: str, what: str, most: int | None = None) -> DataFrame:
    """(repo, ...) of the repositories whose metadata lie in a folder: ``repository``, ``branches``, ``pulls`` or ``commits``.

    ``most`` keeps as many entries of a listing as one page of the host would give.
    """
    raw = spark.read.schema(ABOUT[what]).option("multiLine", "true").json(f"{folder}/*/*/{what}.json").withColumn("repo", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)/[^/]+$", 1))
    if most is not None:
        key = F.desc("number") if what == "pulls" else F.col("sha") if what == "commits" else F.col("name")
        raw = raw.withColumn("__r", F.row_number().over(Window.partitionBy("repo").orderBy(key))).where(F.col("__r") <= min(most, 100)).drop("__r")
    return raw


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, language, bytes) of the repositories' languages, a map in their ``languages.json``."""
    raw = spark.read.text(f"{folder}/*/*/languages.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)/[^/]+$", 1).alias("repo"), F.from_json("value", "map<string,bigint>").alias("m"))
    return raw.select("repo", F.explode("m").alias("language", "bytes"))


class RateLimit:
    """The pace of calls to a host: a pause between calls, and a wait where its headers say that none are left."""

    def __init__(self, spacing: float = 0.1, longest: float = 300.0, clock=time.time, sleep=time.sleep) -> None:  # noqa: ANN001
        self.spacing, self.longest, self.clock, self.sleep = spacing, longest, clock, sleep
        self.remaining, self.reset, self.last = None, 0.0, 0.0

    def told(self, headers: dict[str, str]) -> None:
        """Take over what the headers of a reply say."""
        lower = {k.lower(): v for k, v in headers.items()}
        if "x-ratelimit-remaining" in lower:
            self.remaining = int(lower["x-ratelimit-remaining"])
        if "x-ratelimit-reset" in lower:
            self.reset = float(lower["x-ratelimit-reset"])

    def ahead(self) -> float:
        """Wait as long as the next call has to, and say how long that was; an error if it is too long."""
        now = self.clock()
        wait = max(0.0, self.last + self.spacing - now)
        if self.remaining == 0 and self.reset > now:
            wait = max(wait, self.reset - now)
        if wait > self.longest:
            raise TimeoutError(f"the host's limit is reached for {wait:.0f} s")
        if wait:
            self.sleep(wait)
        self.last = self.clock()
        return wait

    def call(self, request, tries: int = 3):  # noqa: ANN001, ANN201
        """(status, headers, body) of a request, tried again with growing pauses while the host refuses for its limit."""
        for attempt in range(tries):
            self.ahead()
            status, headers, body = request()
            self.told(headers)
            if status not in (403, 429) and "rate limit" not in str(body).lower()[:500]:
                break
            if attempt + 1 < tries:
                self.sleep(min(self.longest, 2.0**attempt))
        return status, headers, body
