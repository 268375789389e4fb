import numpy as np
import pytest

from corvane.llm import catalogue, credentials
from tests.test_catalogue import compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, name):
    compare(spark, data, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs_without_repeats(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    if name.endswith("_found"):
        assert df.count() == df.distinct().count() > 0
    else:
        assert df.count() > 0


def test_neighbours_against_brute_force(spark, data):
    """Recall of at least 0.95 on the data's own vectors, and every similarity as brute force has it."""
    rows = {r.id: r.embedding for r in spark.read.parquet(f"{data}/rag_chunks.parquet").select("id", "embedding").collect()}
    ok = sorted((i, v) for i, v in rows.items() if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v))
    ids, x = [i for i, _ in ok], np.array([v for _, v in ok], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.rint(np.clip(x @ x.T, -1, 1) * 1e6)
    at = {i: k for k, i in enumerate(ids)}
    got = {}
    for r in catalogue.QUERIES["p5_neighbours"](spark, data).collect():
        assert abs(r.similarity * 1e6 - s[at[r.id], at[r.neighbour]]) < 1.5 and r.id != r.neighbour
        got.setdefault(r.id, set()).add(r.neighbour)
    np.fill_diagonal(s, -9e6)
    want = {i: {ids[j] for j in np.argsort(-s[k], kind="stable")[:5]} for i, k in at.items()}
    assert sum(len(got.get(i, set()) & w) for i, w in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_redacted_files_hold_no_credentials_and_lose_nothing_else(spark, data):
    clean = catalogue.QUERIES["p4_redacted"](spark, data)
    before = {r.file_id: r for r in spark.read.parquet(f"{data}/github_files.parquet").select("file_id", "path", "content", "encoding").collect()}
    found = {r.file_id for r in catalogue.QUERIES["p4_found"](spark, data).where("tbl = 'github_files'").collect()}
    rows = clean.collect()
    assert {r.file_id for r in rows} == set(before)
    for r in rows:
        old = before[r.file_id]
        if r.file_id not in found:
            assert r.content == old.content
        else:
            new, text = credentials.decoded(r.content, r.encoding), credentials.decoded(old.content, old.encoding)
            assert new != text and new.count("\n") == text.count("\n")
            left = credentials.spans(new, r.path or "")
            assert not [x for x in left if x[2] != "key"], (r.path, left)


def test_fill_and_derived_queries(spark, data):
    assert all(0.9 <= r.fill <= 1 and r.containers >= r.least for r in catalogue.QUERIES["p7_fill"](spark, data).collect())
    faults = {(r.id, r.fault) for r in catalogue.QUERIES["p1_recut"](spark, data).where("kind = 'fault'").collect()}
    assert faults == {tuple(r) for r in catalogue.QUERIES["p1_found"](spark, data).collect()}
    verdicts = {r.file_id: r.verdict for r in catalogue.QUERIES["p3_verdicts"](spark, data).collect()}
    assert set(verdicts) == {r.file_id for r in catalogue.QUERIES["p3_found"](spark, data).collect()} and set(verdicts.values()) <= {"generated", "minified", "vendored", "data"}
    records = sum(spark.read.parquet(f"{data}/{t}.parquet").select("id").distinct().count() for t in ("rag_documents", "rag_chunks"))
    assert catalogue.QUERIES["p2_classes"](spark, data).count() == records


@pytest.mark.parametrize("name", ["p4_found", "p6_found", "p9_found", "p3_found"])
def test_empty_tables(spark, data, tmp_path, name):
    for t in ("github_files", "file_analysis", "library_files", "rag_knowledge_questions", "rag_user_feedback", "documents"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("name", "source", "stamp"), [("p4_redacted", "github_files", "scanned_at"), ("p4_redacted_analysis", "file_analysis", "last_modified")])
def test_redaction_gives_whole_tables(spark, data, tmp_path, name, source, stamp):
    """Every column and row of both file tables: two contents of one key, rows without a key, repeated rows once."""
    whole = spark.read.parquet(f"{data}/{source}.parquet")
    again = whole.where("content != ''").orderBy("file_id").limit(1)
    odd = [(-1, "a.py", 'pwd = "Qx81!zzT4"\n'), (-1, "a.py", 'x = 1\npwd = "k7Xq-93hdYtt"\n'), (None, "b.py", "x = 1\n"), (None, "c.py", 'token = "mysql8Xk2pQ9"\n')]
    rows = whole.unionByName(again).unionByName(spark.createDataFrame(odd, "file_id bigint, path string, content string"), allowMissingColumns=True)
    rows.coalesce(1).write.parquet(str(tmp_path / f"{source}.parquet"))
    clean = catalogue.QUERIES[name](spark, str(tmp_path))
    assert clean.schema == whole.schema
    want = {}
    for r in sorted(rows.collect(), key=lambda r: str(r[stamp])):  # the latest of repeated rows stays
        old, encoding = r.asDict(), r.asDict().get("encoding")
        text = credentials.decoded(r.content, encoding)
        if credentials.spans(text, r.path or ""):
            new = credentials.redact(text, r.path or "")
            old["content"] = credentials.encoded(new) if encoding == "base64" else new
        want[r.file_id, r.path, r.content] = repr(old)
    assert sorted(repr(r.asDict()) for r in clean.collect()) == sorted(want.values())
    assert {r.content for r in clean.where("file_id IS NULL OR file_id < 0").collect()} == {'pwd = "REDACTED"\n', 'token = "REDACTED"\n', "x = 1\n", 'x = 1\npwd = "REDACTED"\n'}
