"""Agents that look at files and report findings: a registry, their fan-out as one narrow map, prompts, replies and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import ship_package

#: An agent: from path and text to (severity, message, line or None) of each finding.
Agent = Callable[[str, str], list[tuple]]
ISSUE = "struct<severity:string,message:string,line:int>"


class Registry:
    """Agents by name, with category and priority; names come once."""

    def __init__(self) -> None:
        self._held: dict[str, tuple[Agent, str, int]] = {}

    def register(self, name: str, agent: Agent, category: str = "general", priority: int = 0) -> None:
        if name in self._held:
            raise ValueError(f"an agent named {name} is registered already")
        self._held[name] = (agent, category, priority)

    def get(self, name: str) -> Agent:
        if name not in self._held:
            raise KeyError(f"no agent named {name}; there are {', '.join(sorted(self._held))}")
        return self._held[name][0]

    def names(self, category: str | None = None) -> list[str]:
        return sorted(n for n, (_, c, _) in self._held.items() if category in (None, c))

    def agents(self, category: str | None = None) -> dict[str, Agent]:
        return {n: self._held[n][0] for n in self.names(category)}


def run(files: DataFrame, key: str, path: str, content: str, agents: dict[str, Agent], tries: int = 2) -> DataFrame:
    """(key, agent, status, issues): what each agent finds in each file.

    All agents look at a file where it lies, in one pass; one that fails every try gives the status ``failed`` for that file
    and no findings, and the others go on.
    """
    ship_package(files.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("severity", pa.string()), ("message", pa.string()), ("line", pa.int32())]))
        for batch in batches:
            rows = []
            for k, where, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for name, agent in agents.items():
                    found, status = [], "failed"
                    for _ in range(tries):
                        try:
                            found = [{"severity": s, "message": m, "line": n} for s, m, n in agent(where or "", text or "")]
                            status = "completed"
                            break
                        except Exception:  # noqa: BLE001  an agent's failure is its result
                            continue
                    rows.append((k, name, status, found))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.string(), pa.string(), kind), strict=True)], names=[key, "agent", "status", "issues"])

    narrow = files.select(key, path, F.col(content).cast("string"))
    return narrow.mapInArrow(look, f"`{key}` {dict(narrow.dtypes)[key]}, agent string, status string, issues array<{ISSUE}>")


def summary(results: DataFrame) -> DataFrame:
    """One row: results completed and failed, findings in all and by severity."""
    each = lambda level: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == level)))
    return results.agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues"),
        *[F.coalesce(each(level), F.lit(0)).alias(level) for level in ("critical", "high", "medium", "low")],
    )


def with_status(analyses: DataFrame, status: str | None, newest: str, key: str, most: int = 10) -> DataFrame:
    """The newest analyses, of one status if it is given."""
    kept = analyses if status is None else analyses.where(F.col("status") == status)
    return kept.orderBy(F.desc(newest), key).limit(most)


def progress(tasks: DataFrame, status: str) -> DataFrame:
    """One row: tasks completed, running, failed and in all, and how many percent are done; no tasks are all done."""
    s = F.col(status)
    row = tasks.agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "running").alias("running"), F.count_if(s == "failed").alias("failed"), F.count("*").alias("total"))
    return row.withColumn("percent", F.round(F.coalesce(F.try_divide((F.col("completed") + F.col("failed")) * 100.0, F.col("total")), F.lit(100.0)), 6))


def running(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return [(i.stageId, i.numCompletedTasks, i.numTasks) for i in infos if i]


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def prompt_files(files: DataFrame, path: str, content: str, most: int = 10, longest: int = 2000) -> DataFrame:
    """(path, text) of the first files by path; texts of ``longest`` characters or more are left out, their files named."""
    first = files.orderBy(path).limit(most)  # what a prompt has room for
    return first.select(F.col(path).alias("path"), F.when(F.length(content) < longest, F.col(content)).alias("text"))


def parsed(reply: Column) -> Column:
    """The findings of a model's reply: the JSON array of issues in it, NULL where there is none; unknown keys are ignored."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(\[[\s\S]*\])", 1), F.lit("")), f"array<{ISSUE}>")
