import glob
import math
import os

import duckdb
import pytest

from corvane.plans import catalogue, more  # noqa: F401


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(_norm(x) for x in v)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, name):
    compare(spark, data, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_every_query_without_sql_is_held_by_a_test():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"chunk_auto", "complexity_scores", "fact_extract", "feedback_learned", "hashed_embeddings", "knowledge_bundle", "reasoning_detect", "tfidf_kmeans"}


def test_chunk_auto_cuts_every_text_into_its_own_characters(spark, data):
    chunks = catalogue.QUERIES["chunk_auto"](spark, data).collect()
    texts = {r.id: r.content for r in spark.read.parquet(f"{data}/rag_documents.parquet").select("id", "content").collect()}
    by: dict = {}
    for r in chunks:
        by.setdefault(r.id, []).append(r)
    assert {k for k, t in texts.items() if t and t.strip()} <= set(by)
    for key, own in by.items():
        own.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own))) and {r.total_chunks for r in own} == {len(own)}
        covered = [False] * len(texts[key])
        for r in own:
            covered[r.start_char : r.end_char] = [True] * (r.end_char - r.start_char)
        assert all(c or t.isspace() for c, t in zip(covered, texts[key], strict=True))


def test_extracted_facts_and_steps_stand_in_the_answers(spark, data):
    answers = {r.id: r.answer for r in spark.read.parquet(f"{data}/rag_user_feedback.parquet").select("id", "answer").collect()}
    facts = catalogue.QUERIES["fact_extract"](spark, data).collect()
    assert facts and all(all(part.strip() in answers[r.id] for part in r.fact.split(" → ")) for r in facts)
    steps = catalogue.QUERIES["reasoning_detect"](spark, data).collect()
    assert all(len(r.steps) >= 2 for r in steps)
    learned = {(r.id, r.kind) for r in catalogue.QUERIES["feedback_learned"](spark, data).collect()}
    assert learned and {k for _, k in learned} <= {"fact", "chain", "correction", "feedback"}


def test_complexity_embeddings_and_bundle(spark, data):
    scores = catalogue.QUERIES["complexity_scores"](spark, data)
    assert scores.count() > 0 and scores.where("complexity < 0 OR nloc < 0 OR score < complexity").count() == 0
    vectors = catalogue.QUERIES["hashed_embeddings"](spark, data).collect()
    assert vectors
    kinds = {r.kind for r in catalogue.QUERIES["knowledge_bundle"](spark, data).collect()}
    assert kinds and kinds <= {"fact", "chain", "correction", "refinement"}
