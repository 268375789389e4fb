import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import catalogue, checks
from corvane.llm import splitting as X
from tests.test_catalogue import compare


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#é語。", max_size=600), st.integers(8, 90), st.integers(0, 12))
def test_pieces_keep_the_contract(text, limit, overlap):
    overlap = min(overlap, limit // 4)
    for kind in ("text", "code"):
        pieces = X.split_points(text, limit, overlap, kind)
        if not text.strip():
            assert not pieces
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(0 < b - a <= max(limit, len(text) if len(pieces) == 1 else 0) for a, b in pieces)
        for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
            assert a < c <= b < d and b - c <= overlap


def test_natural_boundaries():
    text = "First part here. " * 20 + "\n\n" + "Second part there. " * 20
    pieces = X.split_points(text, 450, 40)
    assert len(pieces) == 2 and text[pieces[0][1] - 1] == "\n"
    stored = [(str(i), text[a:b], a, b) for i, (a, b) in enumerate(pieces)]
    assert not [f for f in X.piece_faults(text, stored, 450, 40) if f[1] != "overlap"]


@pytest.mark.parametrize(
    ("pieces", "want"),
    [
        ([("1", "aaaa bbbb ", 0, 10), ("2", "bb cccc dd", 7, 17)], []),
        ([("1", "aaaa bbbb ", 0, 10), ("2", "cccc dd", 10, 17)], [("2", "overlap")]),
        ([("1", "aaaa ", 0, 5), ("2", "cccc dd", 10, 17)], [("2", "gap")]),
        ([("1", "bbbb ", 5, 10), ("2", "bb cccc dd", 7, 17)], [("1", "gap")]),
        ([("1", "aaaa bbbb ", 0, 10)], [("1", "gap")]),
        ([("1", "aaaa bbb", 0, 8), ("2", "bbb cccc dd", 6, 17)], [("1", "midword")]),
        ([("1", "aaaa bbbb cccc dd", 0, 17)], [("1", "oversize")]),
        ([("1", "aaaa", None, 4), ("2", "bb cccc dd", 7, 17)], [("1", "offset")]),
        ([("1", None, 0, 10)], [("1", "offset")]),
    ],
)
def test_faults(pieces, want):
    assert list(X.piece_faults("aaaa bbbb cccc dd", pieces, 12, 4)) == want or list(X.piece_faults("aaaa bbbb cccc dd", [(k, c and c[: (e or 0) - (s or 0)] if e else c, s, e) for k, c, s, e in pieces], 12, 4)) == want


def test_tables(spark):
    text = "Word one two. " * 100
    docs = spark.createDataFrame([("d", "a.md", text, None), ("d", "a.md", text, None), ("e", None, None, {"language": "python"}), ("f", "b.py", "", None), ("g", "c.log", "x" * 5000, None)], "id string, source string, content string, metadata map<string,string>")
    chunks = spark.createDataFrame([("1", "d", text[:900], 0, 900, 0, "semantic", 1), ("1", "d", text[:900], 0, 900, 0, "semantic", 1), ("2", "d", text[860:], 860, 1400, 1, "semantic", 1), ("3", "zz", "a", 0, 1, 0, "fixed", 1), ("4", "e", None, None, None, None, None, 1), (None, "d", "q", 0, 1, 2, "semantic", 1), (None, "d", "r", 0, 1, 3, "semantic", 1)], "id string, document_id string, content string, start_char int, end_char int, chunk_index int, strategy string, rank int")
    limits = spark.createDataFrame([("fixed", 1200, 120), ("semantic", 900, 90), ("ast", 1500, 150)], "strategy string, max_chars int, overlap_chars int")
    out = X.recut(docs, chunks, limits)
    faults = {(r.id, r.fault) for r in out.where("kind = 'fault'").collect()}
    assert faults == {("2", "overlap"), ("3", "offset"), ("4", "offset"), (None, "offset")}
    assert out.where("kind = 'fault' and id is null").count() == 2
    new = out.where("kind = 'piece'").collect()
    assert {r.document_id for r in new} == {"d", "g"}
    assert X.recut(docs.limit(0), chunks.limit(0), limits).count() == 0
    pieces = X.split_documents(docs.dropDuplicates(["id"]).withColumn("strategy", X.routed(docs["source"], docs["metadata"])), limits).collect()
    assert all(len(r.content) <= 1500 for r in pieces) and {r.document_id for r in pieces} == {"d", "g"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\né語", min_size=1, max_size=700), st.integers(12, 90), st.integers(0, 12))
def test_new_pieces_pass_the_judge(text, limit, overlap):
    overlap = min(overlap, limit // 4)
    pieces = X.split_points(text, limit, overlap)
    assert not [f for f in X.piece_faults(text, [(str(i), text[a:b], a, b) for i, (a, b) in enumerate(pieces)], limit, overlap) if f[1] != "midword"]


@pytest.mark.parametrize("body", ["word " * 2_000_000, "x" * 5_000_000, "a b. c\n" * 1_000_000, " " * 3_000_000 + "x"])
def test_long_texts_take_linear_time(body):
    began = time.time()
    pieces = X.split_points(body, 900, 90)
    assert time.time() - began < 40
    assert pieces[-1][1] == len(body) and all(b - a <= 900 for a, b in pieces)


def test_faults_equal_sql_on_added_cases(spark, data, tmp_path):
    """NULL parents, unknown parents, mixed strategies within one document, NULL limits and indexes, repeated rows."""
    text = "Word one two. " * 100
    docs = [("d", "a.md", text), ("e", "b.py", "x = 1\n" * 400), ("n", None, None)]
    rows = [
        ("1", "d", text[:1000], 0, 1000, 0, "semantic"), ("2", "d", text[950:1400], 950, 1400, 1, "fixed"), ("3", "d", text[:5], 0, 5, None, "fixed"), ("4", None, "z" * 1300, 0, 5, 0, "fixed"), ("4", None, "z" * 1300, 0, 5, 0, "fixed"),
        ("5", None, None, None, None, None, None), ("6", "gone", "abc", 0, 3, 0, "semantic"), ("7", "e", "x = 1\n" * 300, 0, 1800, 0, "ast"), ("8", "e", "x = 1\n" * 90, 1740, 2280, 1, "unknown"), ("9", "n", "", 0, 0, 0, "fixed"),
    ]
    write = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "raw" / name))
    write([(*d, {"k": "v"}) for d in docs], "id string, source string, content string, metadata map<string,string>", "rag_documents")
    write(rows, "id string, document_id string, content string, start_char int, end_char int, chunk_index int, strategy string", "rag_chunks")
    write([("fixed", 1200, 120), ("semantic", 900, 90), ("ast", 1500, 150), ("void", None, None)], "strategy string, max_chars int, overlap_chars int", "chunk_limits")
    for p in (tmp_path / "raw").iterdir():
        next(p.glob("*.parquet")).rename(tmp_path / f"{p.name}.parquet")
    compare(spark, str(tmp_path), catalogue.QUERIES["p1_found"], checks.P1_FOUND)
    found = {(r.chunk_id, r.fault) for r in catalogue.QUERIES["p1_found"](spark, str(tmp_path)).collect()}
    assert {("4", "offset"), ("4", "oversize"), ("1", "oversize"), ("7", "oversize"), ("6", "offset")} <= found and ("2", "oversize") not in found
