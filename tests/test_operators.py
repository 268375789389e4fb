import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.operators import chunking, code, learning, models, retrieval, store
from corvane.plans import catalogue
from corvane.sources import files, hosting


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, F.round(T.trigram_similarity(F.lit("word"), F.lit("two words")), 6)) == 0.363636
    assert one(spark, T.trigram_similarity(F.lit(""), F.lit("!"))) == 0.0
    assert one(spark, T.topic(F.lit("How does kafka work?"))) == "Kafka"
    assert one(spark, T.topic(F.lit("how does Velra work?"))) == "Velra" and one(spark, T.topic(F.lit("how?"))) == "General"
    assert one(spark, T.accuracy(F.lit("executor memory and driver memory"), F.lit("Executor memory only"))) == pytest.approx(75.0)
    assert one(spark, T.accuracy(F.lit("8 0"), F.lit("port 8"))) == 50.0 and one(spark, T.accuracy(F.lit("x"), F.lit(" "))) == 0.0
    assert one(spark, T.facts(F.lit("The executor.memory is set to four gigabytes. Use cache for repeated scans.")))[0].startswith("executor.memory → ")
    assert len(one(spark, T.steps(F.lit("Step 1: read the whole table\nThen join it with the other\n")))) == 2
    asked = one(spark, T.questions(F.lit("# Head\ntext\n## Two\ndef move(x):\n  pass\nclass A:\n")))
    assert [q.question for q in asked] == ["What does the section 'Head' cover?", "What does the section 'Two' cover?", "What does the function 'move' do?"]
    assert one(spark, T.first_json(F.lit('so {"a": 1} it is'))) == '{"a": 1}' and one(spark, T.first_json(F.lit("none"))) is None


def test_paths(spark):
    rows = {"o/digit": ("o", "digit"), "git@github.com:a/b.git": ("a", "b"), "https://github.com/microsoft/vscode": ("microsoft", "vscode"), "github.com/a/b/pull/3": ("a", "b"), "https://example.org/a/b": None, "": None}
    for url, want in rows.items():
        got = one(spark, P.repository(F.lit(url)))
        assert (tuple(got) if got else None) == want, url
    assert one(spark, P.number_in(F.lit("https://github.com/a/b/pull/12"), "pull")) == 12
    assert one(spark, P.language(F.lit("a/b.tsx"))) == "TypeScript" and one(spark, P.language(F.lit("a/.env"))) == "Unknown"
    assert one(spark, P.excluded(F.lit("node_modules/a.js"))) and one(spark, P.excluded(F.lit("x/a.min.js"))) and not one(spark, P.excluded(F.lit("src/dist.go")))
    assert one(spark, P.common_prefix(F.lit("a/b/c.py"), F.lit("a/b/d.py"))) == "a/b" and one(spark, P.common_prefix(F.lit("a/b.py"), F.lit("a/b.py"))) == "a"


def test_fusion(spark):
    v = spark.createDataFrame([("c1", 1), ("c2", 2)], "id string, rank int")
    b = spark.createDataFrame([("c2", 1), ("c3", 2)], "id string, rank int")
    got = [(r.id, r.combined_score) for r in retrieval.fuse(v, b, "id").orderBy("rank").collect()]
    assert [x for x, _ in got] == ["c2", "c1", "c3"] and got[0][1] == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-9)
    assert [r.id for r in retrieval.fuse(v, b, "id", alpha=1.0).orderBy("rank").collect()] == ["c1", "c2", "c3"]
    assert retrieval.fuse(v.limit(0), b.limit(0), "id").count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [-1.0, 0.0]), (7, [1.0])]
    items = spark.createDataFrame(rows, "k bigint, v array<float>")
    best = [(r.k, r.similarity) for r in retrieval.vector_topk(items, "k", "v", items.where("k = 1"), 3).orderBy("rank").collect()]
    assert best == [(1, 1.0), (3, 1.0), (2, 0.0)]
    batch = {(r.query_id, r.k, r.rank) for r in retrieval.vector_topk_batch(items, "k", "v", items.where("k in (1, 2)"), "k", 2).collect()}
    assert batch == {(1, 1, 1), (1, 3, 2), (2, 2, 1), (2, 1, 2)}


MARKDOWN = "# Title\n\nFirst para.\n\n```python\n# not a title\nx = 1\n```\n\n## Two\nText here.\n"
PYTHON = "import os\n\nclass A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n\nasync def h(a,\n            b):\n    return a\n\nX = 1\n"
SCRIPT = "const a = 1;\nfunction f(x) {\n  return `}` + \"}\";\n}\nconst g = (x) => {\n  return 2;\n};\nclass C {\n}\n"


def test_chunking(spark):
    assert [k for k, _, _ in chunking.sections("a\n\nb")] == ["paragraph", "paragraph"]
    kinds = [(k, MARKDOWN[a:b]) for k, a, b in chunking.sections(MARKDOWN)]
    assert kinds[0] == ("heading_1", "# Title") and ("paragraph", "First para.") in kinds and kinds[-1] == ("paragraph", "Text here.")
    assert [(k, n) for k, n, _, _ in chunking.code_blocks(PYTHON, "python")] == [("class", "A"), ("function", "h")]
    assert [(k, n) for k, n, _, _ in chunking.code_blocks(SCRIPT, "javascript")] == [("function", "f"), ("function", "g"), ("class", "C")]
    for text in ("", "x" * 2048, "x" * 2049, "word " * 900, MARKDOWN * 60, PYTHON * 60):
        for how, split in chunking.STRATEGIES.items():
            spans = split(text, "")
            assert all(0 <= a < b <= len(text) for a, b in spans), how
            assert bool(spans) == bool(text.strip()) or not text
            if how in ("fixed", "lines") and text:
                assert spans[0][0] == 0 and spans[-1][1] == len(text)
    docs = spark.createDataFrame([(1, "a.md", MARKDOWN), (2, "a.py", PYTHON), (3, "a.log", "x" * 3000), (4, None, None), (5, "b.md", "")], "id bigint, source string, content string")
    got = {(r.id, r.strategy) for r in chunking.auto(docs, "id", "content", "source").collect()}
    assert got == {(1, "semantic"), (2, "ast"), (3, "fixed")}
    with pytest.raises(ValueError, match="unknown strategy"):
        chunking.chunk(docs, "id", "content", "nothing")
    chunking.register("halves", lambda t: [(0, len(t) // 2), (len(t) // 2, len(t))])
    assert chunking.chunk(docs.where("id = 3"), "id", "content", "halves").count() == 2
    assert one(spark, chunking.greedy_pack(F.array(*[F.lit(x).cast("bigint") for x in (5, 4, 9, 1, 1)]), 9)) == [0, 0, 1, 2, 2]


def test_store(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], base.schema)
    assert {tuple(r) for r in store.upsert(base, new, "id", "seq").collect()} == {(1, "a", 1), (2, "d", 3), (3, "e", 1)}
    assert {tuple(r) for r in store.upsert(base, new, "id", "seq", keep=("v",)).collect()} == {(1, "a", 1), (2, "b", 3), (3, "e", 1)}
    assert store.insert_ignore(base, new, "id").count() == 3
    left = store.delete_cascade(base, "id", base.where("id = 2"), {"c": (new, "id")})
    assert left[""].count() == 1 and left["c"].count() == 1
    assert [r.id for r in store.lru_trim(base, "seq", "id", 1).collect()] == [1]
    assert store.upsert(base.limit(0), new.limit(0), "id", "seq").count() == 0


def test_learning(spark):
    rows = [("1", "The port is set to eight thousand.", 0.9, None), ("2", "x", -0.5, "fix"), ("3", "x", -0.5, None), ("4", "x", 0.59, None), ("5", None, None, None)]
    kinds = [(r.id, r.kind) for r in learning.route(spark.createDataFrame(rows, "id string, answer string, rating double, correction string")).collect()]
    assert ("1", "fact") in kinds and ("2", "correction") in kinds and [k for i, k in kinds if i in "345"] == ["feedback"] * 3
    import datetime
    import random

    rng, at = random.Random(1), datetime.datetime(2024, 1, 1)
    uses = [(k, at + datetime.timedelta(seconds=i), rng.random() < p) for k, p in (("a", 0.9), ("b", 0.1), ("c", 0.5)) for i in range(400)]
    df = spark.createDataFrame(uses, "k string, at timestamp, ok boolean")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in ("1", "23"):  # a key in one range, and in many
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.k: (r.usage_count, r.confidence) for r in learning.usage_fold(df, "k", "at", F.col("ok")).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        for k in "abc":
            c = 0.5
            for _, _, ok in (u for u in uses if u[0] == k):
                c = max(0.0, min(1.0, c + (0.05 if ok else -0.02)))
            assert got[k] == (400, pytest.approx(c, abs=1e-6))
    facts = spark.createDataFrame([(0, "T", "f", 0.9), (1, "T", "g", 0.2)], "pos int, topic string, fact string, confidence double")
    fixed = spark.createDataFrame([(0, "old", "new")], "pos int, answer string, correction string")
    chains = spark.createDataFrame([(0, "q", ["s1", "s2"], "end")], "pos int, question string, steps array<string>, final_answer string")
    text = learning.context(facts, fixed, chains).first()["context"]
    assert "• **T**: f" in text and "**T**: g" not in text and "✅ **Correct**: new" in text and "  2. s2" in text
    none = learning.context(facts.limit(0), fixed.limit(0), chains.limit(0))
    assert none.first()["context"] == ""
    refined = spark.createDataFrame([("better",)], "refined_query string")
    assert tuple(learning.prompt(none, "q", "sys", refined).first()) == ("sys", "better", "better")
    assert tuple(learning.prompt(none, "q", "sys", refined.limit(0)).first()) == ("sys", "q", "q")


def test_code(spark):
    assert code.complexity("def f(a):\n    if a and a > 1:\n        return 1\n    return 0\n", "Python")[0] == 3.0
    assert code.complexity("", "Python") == (0.0, 0, 0, 0) and code.complexity("def (", "Python")[3] == 0
    df = spark.createDataFrame([(i, "g", i, 1) for i in range(9)] + [(100, "h", 1, 1)], "id int, g string, size int, n int")
    assert {r.id for r in code.representatives(df, "g", "size", "id", 3).collect()} == {3, 4, 5, 100}
    assert code.cluster(spark.createDataFrame([(1, "a b")], "k int, c string"), "k", "c").first()["cluster"] == 0


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "b a")], "id int, t string")
    v = {r.id: r.embedding for r in models.embed(rows, "t", models.hashing_embedder(8), batch=1).collect()}
    assert v[2] is None and v[3] is None and v[1] == v[4]

    def fails(_):
        raise RuntimeError

    out = {r.id: (r.response, r.provider) for r in models.generate(rows, "t", [fails, lambda t: t.upper() or None]).collect()}
    assert out[1] == ("A B", 1) and out[2] == (None, None)


def test_sources(spark, tmp_path):
    for path, text in {"a.py": "x = 1", "node_modules/b.js": "1", ".git/c.py": "1", "d/e.md": "# T", "d/big.txt": "y" * 30_000}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.path: (r.language, r.content) for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "d/e.md", "d/big.txt"} and got["a.py"] == ("Python", "x = 1") and got["d/big.txt"][1] is None
    assert files.ingest(spark, str(tmp_path)).count() == 3 and files.ingest_text(spark, "t", "s").count() == 1
    root = tmp_path / "host/o/r"
    (root / "src").mkdir(parents=True)
    (root / "listing.json").write_text(json.dumps([{"path": "a.py", "type": "file", "size": 5, "content": hosting.encode("x = 1"), "encoding": "base64"}, {"path": "src", "type": "dir"}]))
    (root / "src/listing.json").write_text(json.dumps({"path": "src/b.js", "type": "file", "size": 200_000}))
    listed = hosting.hosted(spark, str(tmp_path / "host"))
    assert {r.path for r in listed.collect()} == {"a.py", "src", "src/b.js"}
    assert [(r.path, r.content, r.language) for r in hosting.scan(hosting.decoded(listed)).collect()] == [("a.py", "x = 1", "Python")]


def test_simple_questions_read_every_line_end(spark, tmp_path):
    rows = [("a", "# One\r\ndef go(x):\r\n"), ("b", "# Two\rclass Old:\r"), ("c", "# Three\n"), ("d", None)]
    spark.createDataFrame(rows, "id string, content string").write.parquet(f"{tmp_path}/rag_documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["simple_questions"](spark, str(tmp_path)).collect()}
    assert got == {("a", "What does the section 'One' cover?"), ("a", "What does the function 'go' do?"), ("b", "What does the section 'Two' cover?"), ("b", "What is the purpose of the class 'Old'?"), ("c", "What does the section 'Three' cover?")}
