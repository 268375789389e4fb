import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import session
from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.functions.tokenizer import encoding
from corvane.operators import agents, chunking, evaluate, learning, models, retrieval, store
from corvane.sources import files, hosting


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_scripts_are_cut_by_blocks_not_by_lines(spark):
    body = "".join(f"export function f{i}(a) {{\n  const s = '}}';\n  return a + {i};\n}}\n\n" for i in range(60))
    docs = spark.createDataFrame([(1, "a.js", body), (2, "b.ts", body), (3, "c.py", "x = 1\n" * 300)], "id int, source string, content string")
    got = {}
    for r in chunking.auto(docs, "id", "content", "source").orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got[1] == got[2] and "".join(got[1]) == body and all(c.startswith("export function") for c in got[1])
    assert [(a, b) for a, b in chunking.line_spans("x = 1\n" * 300)] and len(got[3]) == len(chunking.line_spans("x = 1\n" * 300))


def test_code_pieces():
    big = "def big():\n" + "    x = 1\n" * 900
    text = "import os\n\n" + big + "def small():\n    return 1\n"
    kinds = [k for _, _, k in chunking.code_pieces(text)]
    assert kinds[0] == "blocks" and "partial" in kinds and kinds[-1] == "blocks"
    assert text[chunking.code_pieces(text)[0][0] : chunking.code_pieces(text)[0][1]].strip() == "import os"
    assert [b[:2] for b in chunking.code_blocks("def a(:\n  broken\nasync def b():\n  pass\nclass C:\n  x = (\n", "Python")] == [("function", "b"), ("class", "C")] or chunking.code_blocks("def a(:\n", "python")
    assert chunking.code_blocks("anything", "go") == []
    assert [b[1] for b in chunking.script_blocks("const a = 1\nconst f = async (x) => {\n  return x\n}\nlet g = function (y) { return y }\nconst h = z => z * 2\ntype T = { a: string }\nenum E { A }\nif (a) { f() }\nfunction* gen() {}\n")] == ["f", "g", "h", "T", "E", "gen"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab {}()'\"`/\\=>;\nfunctioclsdey:", max_size=200))
def test_code_readers_take_any_text(text):
    for language in ("python", "typescript"):
        blocks = chunking.code_blocks(text, language)
        assert all(0 <= a < b <= len(text) for _, _, a, b in blocks)
        assert all(x[3] <= y[2] for x, y in zip(blocks, blocks[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(2, 20))
def test_token_windows_cover_any_text(text, size):
    enc = encoding()
    spans = chunking.token_spans(text, enc.encode_ordinary, enc.decode_tokens_bytes, size, 0.2)
    assert bool(spans) == bool(text)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b[0] <= a[1] and 0 < a[3] - a[2] <= size for a, b in zip(spans, spans[1:], strict=False))


def test_index_equals_the_scan(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    retrieval.write_index(docs, "doc_id", "text", str(tmp_path / "index"), buckets=8)
    terms = ["cache", "index", "partition"]
    want = [tuple(r) for r in retrieval.bm25_topk(docs, "doc_id", "text", terms, 20).collect()]
    assert [tuple(r) for r in retrieval.indexed_topk(spark, str(tmp_path / "index"), "doc_id", terms, 20).collect()] == want and want
    full = {r.doc_id for r in retrieval.fulltext_and(docs, "doc_id", "text", terms, 10_000).collect()}
    assert {r.doc_id for r in retrieval.indexed_topk(spark, str(tmp_path / "index"), "doc_id", terms, 10_000, every=True).collect()} == full
    plan = retrieval.open_index(spark, str(tmp_path / "index"), terms)[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters" in plan
    assert retrieval.indexed_topk(spark, str(tmp_path / "index"), "doc_id", ["nosuchterm"], 5).count() == 0


def test_batches_keep_the_best_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        items = spark.range(100).select(F.col("id").alias("k"), F.array(F.cos(F.col("id") / 50), F.sin(F.col("id") / 50)).cast("array<float>").alias("v"))
        got = retrieval.vector_topk_batch(items.coalesce(1), "k", "v", items.where("k in (0, 40)"), "k", 3)
        assert {(r.query_id, r.k) for r in got.collect()} == {(0, 0), (0, 1), (0, 2), (40, 40), (40, 39), (40, 41)}
        assert got.count() == 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_agents(spark):
    held = agents.Registry()
    held.register("a", lambda p, t: [("low", "m", 1)], "x")
    with pytest.raises(ValueError, match="registered already"):
        held.register("a", lambda p, t: [])
    with pytest.raises(KeyError, match="no agent"):
        held.get("b")
    assert held.names("x") == ["a"] and held.names("y") == []
    df = spark.createDataFrame([(1, "p", "t"), (2, None, None)], "id int, path string, content string")
    out = agents.run(df, "id", "path", "content", {"ok": lambda p, t: [("high", "found", None)], "bad": lambda p, t: [("x",)]})
    got = agents.summary(out).first()
    assert (got.completed, got.failed, got.issues, got.high, got.low) == (2, 2, 2, 2, 0)
    assert agents.summary(out.limit(0)).first().issues == 0
    row = agents.progress(spark.createDataFrame([("completed",), ("failed",), ("running",), ("running",)], "s string"), "s").first()
    assert (row.completed, row.running, row.failed, row.total, row.percent) == (1, 2, 1, 4, 50.0)
    assert agents.progress(spark.createDataFrame([], "s string"), "s").first().percent == 100.0
    assert one(spark, F.size(agents.parsed(F.lit('so [{"severity": "high", "message": "m", "line": 3, "other": 1}]')))) == 1 and one(spark, agents.parsed(F.lit("none"))) is None
    assert agents.running(spark) == []


def test_rate_limit():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = hosting.RateLimit(0.1, 300, lambda: now[0], sleep)
    assert limit.ahead() == 0 and limit.ahead() == pytest.approx(0.1)
    limit.told({"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "130"})
    assert limit.ahead() == pytest.approx(29.9)
    limit.told({"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "9999"})
    with pytest.raises(TimeoutError):
        limit.ahead()
    limit.told({"X-RateLimit-Remaining": "5"})
    replies = iter([(403, {}, "rate limit"), (200, {"x-ratelimit-remaining": "4"}, "ok")])
    assert limit.call(lambda: next(replies))[2] == "ok" and limit.remaining == 4


def test_hosted_metadata(spark, tmp_path):
    home = tmp_path / "o" / "r"
    home.mkdir(parents=True)
    (home / "languages.json").write_text(json.dumps({"Python": 100, "Go": 5}))
    (home / "branches.json").write_text(json.dumps([{"name": "main", "protected": True, "commit": {"sha": "a"}}, {"name": "dev", "protected": False, "commit": {"sha": "b"}}]))
    (home / "pulls.json").write_text(json.dumps([{"number": i, "title": f"t{i}", "state": "open", "user": {"login": "u"}, "created_at": "2024-01-01T00:00:00Z", "merged_at": None} for i in (1, 2, 3)]))
    (home / "repository.json").write_text(json.dumps({"full_name": "o/r", "default_branch": "main", "stargazers_count": 3}))
    assert {tuple(r) for r in hosting.languages(spark, str(tmp_path)).collect()} == {("o/r", "Python", 100), ("o/r", "Go", 5)}
    assert {(r.repo, r.name, r.commit.sha) for r in hosting.about(spark, str(tmp_path), "branches").collect()} == {("o/r", "main", "a"), ("o/r", "dev", "b")}
    assert [r.number for r in hosting.about(spark, str(tmp_path), "pulls", 2).orderBy("number").collect()] == [2, 3]
    assert hosting.about(spark, str(tmp_path), "repository").first().default_branch == "main"


def test_models(spark):
    assert models.as_embedder(lambda texts: [[1.0]] * len(texts))(["a", "b"]) == [[1.0], [1.0]]
    assert models.as_embedder(lambda text: [float(len(text.strip()))])(["a", "bb"]) == [[1.0], [2.0]]
    assert list(models.tokens_of(iter(['{"response": "a"}', "broken", '{"response": "b", "done": true}', '{"response": "c"}']))) == ["a", "b"]
    calls = spark.createDataFrame([("q",)], "p string")
    began = time.time()

    def fails(p):
        raise OSError

    got = models.generate(calls, "p", [fails, lambda p: p + "!"], retries=3, wait=0.05).first()
    assert got.response == "q!" and got.provider == 1 and time.time() - began >= 0.15
    assert one(spark, models.conversation(F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))))) == "User: hi"


def test_learning_and_store(spark, tmp_path):
    rated = spark.createDataFrame([("q", "a", 0.9), ("q", "b", -0.5), ("q", "c", 0.1), ("p", "a", 1.0), ("r", "a", None)], "question string, answer string, rating double")
    assert [tuple(r) for r in learning.preferences(rated, "question", "answer", "rating").collect()] == [("q", "a", "b", 1.4)]
    facts = spark.createDataFrame([("1", "t", 0.5, 1, 0.5, 1)], "id string, topic string, confidence double, usage_count int, success_rate double, updated_at int")
    after = store.upsert_facts(facts, spark.createDataFrame([("1", "other", 0.9, 4, 0.7, 2), ("2", "new", 0.1, 0, 0.0, 1)], facts.schema))
    assert {tuple(r) for r in after.collect()} == {("1", "t", 0.9, 4, 0.7, 2), ("2", "new", 0.1, 0, 0.0, 1)}
    entries = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("l", "x", 1)], "cache_key string, value string, at int")
    store.cache_write(entries, str(tmp_path / "cache"), 4)
    read = spark.read.parquet(str(tmp_path / "cache")).drop("bucket")
    assert {(r.cache_key, r.value) for r in store.latest_by_key(read, "cache_key", "at").collect()} == {("k", "new"), ("l", "x")}
    report = store.health({"a": entries, "b": entries.limit(0)})
    assert {tuple(r) for r in report.collect()} == {("a", 3, "up"), ("b", 0, "up")}
    store.export_json(report, str(tmp_path / "health"))
    assert spark.read.json(str(tmp_path / "health")).count() == 2
    scored = spark.createDataFrame([(3, 1.0)], "questions_evaluated int, overall_score double")
    evaluate.store_score(scored, str(tmp_path / "scores"))
    evaluate.store_score(spark.createDataFrame([(0, 0.0)], scored.schema), str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 1
    latest = store.with_latest(scored.select("questions_evaluated"), spark.createDataFrame([], "ts int, v double"), "ts", "v").first()
    assert latest.latest_v is None
    replied = spark.createDataFrame([(10.0, '{"score": 70}'), (20.0, "none"), (30.0, None)], "accuracy double, reply string")
    assert [r.accuracy for r in evaluate.with_model_scores(replied, "reply").collect()] == [70.0, 20.0, 30.0]


def test_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("x = 1\n")
    got = files.single(spark, str(tmp_path / "a.py")).first()
    assert got.content == "x = 1\n" and got.metadata["extension"] == "py"
    (tmp_path / "c.json").write_text('{"a": 1, "b": 2}')
    monkeypatch.setenv("CORVANE_B", "3")
    assert files.config(str(tmp_path / "c.json"), {"c": 4}) == {"a": 1, "b": "3", "c": 4} | {k: v for k, v in files.config().items() if k not in ("a", "b", "c")}
    listed = spark.createDataFrame([("b.py",), ("a.go",), ("dist/x.py",), ("n.md",)], "path string")
    assert [r.path for r in files.code_files(listed).collect()] == ["a.go", "b.py"]


def test_expressions(spark):
    assert one(spark, P.file_url(F.lit("o"), F.lit("r"), F.lit("/a\\b.py"), "dev", F.lit(3))) == "https://github.com/o/r/blob/dev/a/b.py#L3"
    assert one(spark, P.file_url(F.lit("o"), F.lit("r"), F.lit("a"), "dev", F.lit(3), F.lit(9))).endswith("a#L3-L9") and one(spark, P.is_repository(F.lit("o/r"))) and not one(spark, P.is_repository(F.lit(None).cast("string")))
    assert one(spark, T.percent(F.lit(0), F.lit(0))) == 100.0 and one(spark, T.percent(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, T.seconds_between(F.lit("2024-01-01 00:00:00"), F.lit("2024-01-01 00:00:01.5"))) == 1.5 and one(spark, T.seconds_between(F.lit("2024-01-01"), F.lit(None).cast("string"))) is None
    assert one(spark, T.seconds_until(F.lit(0), F.lit("2024-01-01"))) == 0
    assert [one(spark, T.finished(F.lit(x))) for x in ("STOP", "max_tokens", None)] == ["complete", "truncated", "other"]
    assert one(spark, T.json_array(F.lit("a [1, [2]] b"))) == "[1, [2]]" and one(spark, T.json_greedy(F.lit('{"a": {"b": 1}} x'))) == '{"a": {"b": 1}}'


def test_control_tables_and_shared_folders(spark):
    assert len(session.small_rows(spark.range(5), "five", 5)) == 5
    with pytest.raises(ValueError, match="five may have 4"):
        session.small_rows(spark.range(5), "five", 4)

    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)
