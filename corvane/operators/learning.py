"""Learning from feedback: routing, running averages, knowledge lookup and the context made of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.retrieval import vector_topk
from corvane.session import ship_package

POSITIVE, CORRECTION_CONFIDENCE = 0.6, 0.8
#: The text of a context: its head and foot, the heads of its sections and the parts of their lines.
CONTEXT_HEAD, CONTEXT_FOOT = "# Relevant Knowledge from Previous Sessions\n\n", "\n\n---\n"
FACTS_HEAD = "## Previously Learned Facts\n\n"
CORRECTIONS_HEAD = "## Important Corrections\n\n*The following are corrections from previous sessions. Use the corrected information.*\n\n"
CHAINS_HEAD = "## Example Reasoning Patterns\n\n*Use similar step-by-step reasoning for your answer.*\n\n"
FACT_LINE = ("• **", "**: ")
CORRECTION_LINE = ("❌ **Previous (incorrect)**: ", "...\n✅ **Correct**: ", "\n")
CHAIN_LINE = ("**Example Question**: ", "\n**Reasoning Steps**:\n", "\n**Answer**: ", "\n")


def route(feedback: DataFrame) -> DataFrame:
    """(id, kind, content, confidence): what one pass over feedback gives to store.

    Every row is stored (``feedback``); a rating of 0.6 or more gives facts and, from two steps on, a reasoning chain; a negative one with a correction
    gives that as a fact; ratings between give nothing more. A NULL rating counts as between.
    """
    good = F.col("rating") >= POSITIVE
    confidence = F.least(F.lit(1.0), 0.5 + 0.3 * F.col("rating"))
    learned = F.when(good, F.transform(T.facts(F.col("answer")), lambda f: F.struct(F.lit("fact").alias("kind"), f.alias("content"), F.round(confidence, 6).alias("confidence"))))
    chain = F.when(good & (F.size(T.steps(F.col("answer"))) >= 2), F.array(F.struct(F.lit("chain").alias("kind"), T.conclusion(F.col("answer")).alias("content"), F.round(F.col("rating"), 6).alias("confidence"))))
    corrected = F.when((F.col("rating") < 0) & F.col("correction").isNotNull(), F.array(F.struct(F.lit("correction").alias("kind"), F.col("correction").alias("content"), F.lit(CORRECTION_CONFIDENCE).alias("confidence"))))
    stored = F.array(F.struct(F.lit("feedback").alias("kind"), F.col("answer").alias("content"), F.col("rating").alias("confidence")))
    none = F.array().cast("array<struct<kind:string,content:string,confidence:double>>")
    every = F.concat(stored, F.coalesce(learned, none), F.coalesce(chain, none), F.coalesce(corrected, none))
    return feedback.select("id", F.explode(every).alias("r")).select("id", "r.*")


def refinements(pairs: DataFrame) -> DataFrame:
    """Stored only if both queries are given and differ; improvement is the rating, success starts at 1."""
    ok = F.col("original_query").isNotNull() & F.col("refined_query").isNotNull() & (F.col("original_query") != F.col("refined_query"))
    return pairs.where(ok).select("original_query", "refined_query", F.col("rating").alias("improvement_score"), F.lit(1.0).alias("success_rate"))


def usage_fold(events: DataFrame, key: str, order: str, helpful: Column, rate0: float = 0.5, count0: int = 0, confidence0: float = 0.5) -> DataFrame:
    """(key, usage_count, success_rate, confidence) after uses in order: confidence rises by 0.05 or falls by 0.02, clamped to [0, 1].

    The rate has a closed form. The clamped confidence is an ordered fold, and clamped shifts compose: a run of them is
    ``x -> min(high, max(low, x + shift))``. Uses are put in order by ranges of key and time, so a hot key lies in as many
    ranges as it fills; each range folds its runs to three numbers, and only those are folded by key. Of uses at one time,
    helpful ones come first.
    """
    ship_package(events.sparkSession)
    used = events.select(F.col(key), F.col(order).alias("__o"), F.coalesce(helpful, F.lit(False)).cast("int").alias("__x"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "first", "n", "s", "shift", "low", "high"]
        run: list | None = None  # of the key whose run goes on
        for batch in batches:
            done = []
            for k, o, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if run is None or run[0] != k:
                    if run is not None:
                        done.append(tuple(run))
                    run = [k, o, 0, 0, 0.0, float("-inf"), float("inf")]
                d = 0.05 if x else -0.02
                run[2:] = [run[2] + 1, run[3] + x, run[4] + d, max(0.0, min(1.0, run[5] + d)), max(0.0, min(1.0, run[6] + d))]
            types = [batch.column(0).type, batch.column(1).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 7, types, strict=True)], names=names)
        if run is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(run, types, strict=True)], names=names)

    kinds = dict(used.dtypes)
    ordered = used.repartitionByRange(key, "__o").sortWithinPartitions(key, "__o", F.desc("__x"))
    forms = ordered.mapInArrow(fold, f"`{key}` {kinds[key]}, first {kinds['__o']}, n bigint, s bigint, shift double, low double, high double")
    whole = forms.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array_sort(F.collect_list(F.struct("first", "shift", "low", "high"))).alias("__forms"))  # a row for each range
    confidence = F.aggregate("__forms", F.lit(float(confidence0)), lambda c, e: F.least(e["high"], F.greatest(e["low"], c + e["shift"])))
    rate = (F.lit(rate0 * count0) + F.col("s")) / (F.lit(count0) + F.col("n"))
    return whole.select(key, (F.col("n") + count0).alias("usage_count"), F.round(rate, 6).alias("success_rate"), F.round(confidence, 6).alias("confidence"))


def memory_stats(facts: DataFrame, chains: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row of counts and averages; averages of nothing are 0. facts has confidence, success_rate; chains was_correct."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    f = facts.agg(F.count("*").alias("facts"), mean("confidence").alias("avg_confidence"), mean("success_rate").alias("avg_success_rate"))
    c = chains.agg(F.count("*").alias("chains"), F.count_if("was_correct").alias("correct_chains"))
    b = feedback.agg(F.count("*").alias("feedback"))
    return f.crossJoin(c).crossJoin(b)  # single rows


def nearest_facts(facts: DataFrame, key: str, vector: str, query: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """(key, similarity, rank) of the facts of enough confidence that are most similar to the query's vector."""
    return vector_topk(facts.where(F.col("confidence") >= least), key, vector, query, k)


def nearest_chains(chains: DataFrame, key: str, vector: str, query: DataFrame, k: int = 3, only_correct: bool = True) -> DataFrame:
    """(key, similarity, rank) of the reasoning chains most similar to the query's vector; by default of right ones."""
    return vector_topk(chains.where("was_correct") if only_correct else chains, key, vector, query, k)


def by_topic(facts: DataFrame, topic: str, order: str) -> DataFrame:
    """(topic, facts, first, place): topics in the order in which their first fact was stored."""
    grouped = facts.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("facts"), F.min(order).alias("first"))
    return grouped.withColumn("place", F.row_number().over(Window.orderBy("first", "topic")))  # a row for each topic


def refinements_leaderboard(refined: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The refinements of most success, then of most uses."""
    return refined.orderBy(F.desc("success_rate"), F.desc("times_applied"), key).limit(most)


def preferences(answers: DataFrame, question: str, answer: str, rating: str) -> DataFrame:
    """(question, chosen, rejected, margin): the best and the worst rated answer of each question, where they differ.

    One pair a question, found by aggregation, so a question asked by a third of all rows gives no product of its answers.
    """
    rated = answers.where(F.col(rating).isNotNull() & F.col(answer).isNotNull())
    ends = rated.groupBy(F.col(question).alias("question")).agg(F.max(F.struct(F.col(rating).alias("r"), F.col(answer).alias("a"))).alias("best"), F.min(F.struct(F.col(rating).alias("r"), F.col(answer).alias("a"))).alias("worst"))
    return ends.where((F.col("best.r") > F.col("worst.r")) & (F.col("best.a") != F.col("worst.a"))).select("question", F.col("best.a").alias("chosen"), F.col("worst.a").alias("rejected"), F.round(F.col("best.r") - F.col("worst.r"), 6).alias("margin"))


def corrections(feedback: DataFrame, query: str, newest: int = 100, most: int = 3) -> DataFrame:
    """Of the newest corrections those whose question holds any term of the query, the first few."""
    recent = feedback.where((F.col("feedback_type") == "correction") & F.col("correction").isNotNull()).orderBy(F.desc("created_at"), "id").limit(newest)
    terms = [t for t in query.lower().split() if t]
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("question"), F.lit(t))
    return recent.where(hit).orderBy(F.desc("created_at"), "id").limit(most)


def find_refinement(refined: DataFrame, query: str, least: float = 0.3, success: float = 0.5) -> DataFrame:
    """The stored refinement whose original is most alike by trigrams."""
    scored = refined.withColumn("similarity", F.round(T.trigram_similarity(F.col("original_query"), F.lit(query)), 6))
    return scored.where((F.col("similarity") > least) & (F.col("success_rate") > success)).orderBy(F.desc("similarity"), "original_query").limit(1)


def context(facts: DataFrame, corrected: DataFrame, chains: DataFrame, least: float = 0.4) -> DataFrame:
    """One row with the sections of facts, corrections and reasoning examples, in their orders; '' if there are none.

    The inputs are the few rows retrieved for one query: facts (pos, topic, fact, confidence), corrected (pos, answer,
    correction), chains (pos, question, steps, final_answer).
    """
    def section(rows: DataFrame, head: str, name: str, *line: Column | str) -> DataFrame:
        written = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in line])
        lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", written.alias("line")))), lambda x: x["line"])
        return rows.agg(F.concat(F.lit(head), F.nullif(F.array_join(lines, "\n"), F.lit(""))).alias(name))

    numbered = F.array_join(F.transform("steps", lambda step, i: F.format_string("  %d. %s", i + 1, step)), "\n")
    parts = (
        section(facts.where(F.col("confidence") >= least), FACTS_HEAD, "f", FACT_LINE[0], F.col("topic"), FACT_LINE[1], F.col("fact")),
        section(corrected, CORRECTIONS_HEAD, "c", CORRECTION_LINE[0], F.left("answer", F.lit(200)), CORRECTION_LINE[1], F.col("correction"), CORRECTION_LINE[2]),
        section(chains, CHAINS_HEAD, "r", CHAIN_LINE[0], F.col("question"), CHAIN_LINE[1], numbered, CHAIN_LINE[2], F.col("final_answer"), CHAIN_LINE[3]),
    )
    row = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # single rows
    body = F.concat_ws("\n\n", "f", "c", "r")
    return row.select(F.when(body == "", "").otherwise(F.concat(F.lit(CONTEXT_HEAD), body, F.lit(CONTEXT_FOOT))).alias("context"))


def relevant_facts(facts: DataFrame, topic: str | None = None, least: float = 0.3) -> DataFrame:
    """Facts of enough confidence, of a topic if one is given."""
    out = facts.where(F.col("confidence") >= least)
    return out if topic is None else out.where(F.contains(F.lower("topic"), F.lit(topic.lower())))


def leaderboard(facts: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The facts of most confidence, then of most uses."""
    return facts.orderBy(F.desc("confidence"), F.desc("usage_count"), key).limit(most)


def prompt(context_row: DataFrame, question: str, system: str, refined: DataFrame | None = None) -> DataFrame:
    """One row (system, user, refined_query): the context goes ahead of the system text, a refined query replaces the question."""
    best = F.lit(question)
    rows = context_row
    if refined is not None:
        rows = rows.join(F.broadcast(refined.select("refined_query").limit(1)), F.lit(True), "left")  # one row
        best = F.coalesce("refined_query", best)
    return rows.select(F.concat_ws("\n\n", F.nullif("context", F.lit("")), F.lit(system)).alias("system"), best.alias("user"), best.alias("refined_query"))


def training_lines(pairs: DataFrame) -> DataFrame:
    """(value): one JSON object a line for (prompt, completion) pairs, ready for ``write.text``."""
    ok = pairs.where(F.col("prompt").isNotNull() & F.col("completion").isNotNull())
    return ok.select(F.to_json(F.struct("prompt", "completion")).alias("value"))
