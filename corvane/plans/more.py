"""More named queries: code and text chunking on stated texts, retrieval in batches, learning, agents, sources.

Queries on stated texts (``code_blocks``, ``semantic_sections``, ``semantic_pack``, ``sentence_pack``, ``model_replies``) read
literal documents, as the structures they look for are absent from the tables; their SQL lists the rows expected, which
were worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.operators import agents, chunking, evaluate, learning, models, retrieval, store
from corvane.plans.catalogue import _COS, QUERIES, _query_vector, query
from corvane.plans.sql import KEYWORDS, language_case
from corvane.sources import files, hosting
from corvane.sources.tables import table

MARKDOWN = "# Title\n\nFirst para. It has two sentences.\n\n```python\nx = 1\n\ny = 2\n```\n\n## Two\nText here.\n"
PYTHON = "import os\n\n@cached\ndef one(a):\n    return a\n\n\nclass Two:\n    def inner(self):\n        return 2\n\n\nasync def three(\n    b,\n):\n    return b\nX = 1\n"
SCRIPT = "import x from 'x';\n\nexport function one(a) {\n  return `}` + \"}\"; // }\n}\nconst n = 1\nconst two = (b) => {\n  return { b };\n};\nexport default class Three extends Four {\n  inner() { return 1; }\n}\nconst short = c => c + 1\ninterface Five { six: string }\n"


def _rows(*rows: tuple) -> str:
    def literal(v: object) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def _spans(text: str, *parts: tuple) -> list[tuple]:
    """Rows of expected parts (..., first words, last words) with their places in the text."""
    out, at = [], 0
    for *head, begins, ends in parts:
        start = text.index(begins, at)
        stop = text.index(ends, start) + len(ends)
        out.append((*head, start, stop))
        at = start + 1
    return out


_BLOCKS = [
    *[("python", *r) for r in _spans(PYTHON, ("function", "one", "@cached", "return a\n"), ("class", "Two", "class Two", "return 2\n"), ("function", "three", "async def", "return b\n"))],
    *[
        ("typescript", *r)
        for r in _spans(
            SCRIPT, ("function", "one", "export function", "// }\n}"), ("function", "two", "const two", "{ b };\n}"), ("class", "Three", "export default class", "return 1; }\n}"), ("function", "short", "const short", "c + 1"), ("type", "Five", "interface", "string }")
        )
    ],
]


@query(f"SELECT * FROM (VALUES {_rows(*_BLOCKS)}) v(language, kind, name, start_char, end_char)")
def code_blocks(spark, d):
    """Definitions at the top level of a Python and a TypeScript text."""
    docs = spark.createDataFrame([("python", PYTHON), ("typescript", SCRIPT)], "language string, content string")

    def run(batches):
        import pandas as pd

        for f in batches:
            yield pd.DataFrame([(lang, *b) for lang, body in zip(f["language"], f["content"], strict=True) for b in chunking.code_blocks(body, lang)], columns=["language", "kind", "name", "start_char", "end_char"])

    chunking.ship_package(spark)
    return docs.mapInPandas(run, "language string, kind string, name string, start_char int, end_char int")


_SECTIONS = _spans(MARKDOWN, ("heading_1", "# Title", "# Title"), ("paragraph", "First", "sentences."), ("code_block", "```python", "y = 2\n```"), ("heading_2", "## Two", "## Two"), ("paragraph", "Text", "here."))


def _over_texts(spark, texts: list[str], split, columns: str) -> DataFrame:
    """(doc, *columns) of the tuples that a function gives for each of a few stated texts."""
    chunking.ship_package(spark)
    names = ["doc", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches):
        import pandas as pd

        for f in batches:
            yield pd.DataFrame([(doc, *row) for doc, body in zip(f["doc"], f["body"], strict=True) for row in split(body)], columns=names)

    return spark.createDataFrame(list(enumerate(texts)), "doc int, body string").mapInPandas(run, f"doc int, {columns}")


@query(f"SELECT * FROM (VALUES {_rows(*[(0, *r) for r in _SECTIONS])}) v(doc, kind, start_char, end_char)")
def semantic_sections(spark, d):
    """Headings, paragraphs and fenced code of a Markdown text, with true offsets."""
    return _over_texts(spark, [MARKDOWN], chunking.sections, "kind string, start_char int, end_char int")


_PACKS = _spans(MARKDOWN, ("# Title", "sentences."), ("```python", "here."))  # of 1 + 8 and 6 + 1 + 2 tokens


@query(f"SELECT * FROM (VALUES {_rows(*[(0, *r) for r in _PACKS])}) v(doc, start_char, end_char)")
def semantic_pack(spark, d):
    """Sections packed up to ten estimated tokens; a section that doesn't fit begins the next pack."""
    return _over_texts(spark, [MARKDOWN], lambda t: chunking.semantic_spans(t, 10, 0.1), "start_char int, end_char int")


SENTENCES = "One two three. Four five six! Seven eight? Nine ten eleven twelve."
_SENTENCE_PACKS = _spans(SENTENCES, ("One", "six! "), ("ix! ", "eight? "), ("ht? ", "twelve."))


@query(f"SELECT * FROM (VALUES {_rows(*[(0, *r) for r in _SENTENCE_PACKS])}) v(doc, start_char, end_char)")
def sentence_pack(spark, d):
    """A long paragraph's sentences packed up to 32 characters, with the characters before a pack as overlap."""
    return _over_texts(spark, [SENTENCES], lambda t: chunking.sentence_spans(t, 0, len(t), 8, 0.2), "start_char int, end_char int")


@query("SELECT doc_id, 0 AS first, length(text)::INT AS last, 0::BIGINT AS lost FROM documents WHERE length(text) > 0")
def token_windows(spark, d):
    """Windows of 512 tokens over all texts: each begins at 0, ends at its end and leaves no gap."""
    w = chunking.token_windows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    before = F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    whole = F.length("content") == F.col("end_char") - F.col("start_char")
    return w.withColumn("bad", (F.coalesce(F.col("start_char") > before, F.lit(False)) | ~whole).cast("int")).groupBy("doc_id").agg(F.min("start_char").alias("first"), F.max("end_char").alias("last"), F.sum("bad").alias("lost"))


# --- retrieval ------------------------------------------------------------------------------------------------------


@query(f"""SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM
 (SELECT e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE (e.vec_id % 10) / 10 >= 0.3 ORDER BY 2 DESC, 1 LIMIT 5)""")
def facts_nearest(spark, d):
    """Vectors stand for facts, of confidence vec_id % 10 / 10."""
    facts = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("confidence", (F.col("vec_id") % 10) / 10)
    return learning.nearest_facts(facts, "vec_id", "embedding", _query_vector(spark, d))


@query(f"""SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM
 (SELECT e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 1 ORDER BY 2 DESC, 1 LIMIT 3)""")
def chains_nearest(spark, d):
    """Vectors stand for reasoning chains; those of label 1 were right."""
    chains = table(spark, d, "embeddings", "vec_id", "embedding", (F.col("label") == 1).alias("was_correct"))
    return learning.nearest_chains(chains, "vec_id", "embedding", _query_vector(spark, d))


_ASKED = "list_distinct(regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+')[1:5])"
_BATCH = f"""asked AS (SELECT doc_id AS query_id, text, unnest({_ASKED}) AS term FROM documents WHERE doc_id % 100 = 0),
 post AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+') AS w FROM documents)) GROUP BY ALL),
 freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1), stat AS (SELECT count(*) AS docs, avg(len(regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+'))) AS mean FROM documents),
 scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM asked JOIN post USING (term) JOIN freq USING (term), stat GROUP BY ALL),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20)"""


def _asked(spark, d) -> DataFrame:
    terms = F.array_distinct(F.slice(T.words(F.col("text")), 1, 5))
    return table(spark, d, "documents", "doc_id", "text").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(terms).alias("term"))


@query(f"WITH {_BATCH} SELECT query_id, doc_id, score, rank FROM b")
def bm25_batch(spark, d):
    """The first five words of each document whose id is divisible by 100 are a query against all documents."""
    return retrieval.bm25_batch(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _asked(spark, d), 20)


def _retrieved(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings", F.col("vec_id").alias("doc_id"), "embedding")
    v = retrieval.vector_topk_batch(e, "doc_id", "embedding", e.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), "query_id", 20)
    asked = table(spark, d, "documents", F.col("doc_id").alias("query_id"), F.left("text", F.lit(200)).alias("expected_answer")).where("query_id % 100 = 0 AND length(expected_answer) > 0")
    best = retrieval.fuse_batch(v, bm25_batch(spark, d), "doc_id", top=5)
    texts = table(spark, d, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return best.join(asked, "query_id").join(texts, "doc_id").select(F.col("query_id").alias("question_id"), "expected_answer", F.col("doc_id").alias("chunk_id"), "content", "combined_score", "rank")


@query(f"""WITH {_BATCH},
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {_COS} AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 20),
 f AS (SELECT query_id, doc_id, v.rank AS rv, b.rank AS rb, round(coalesce(0.5::DOUBLE / (60 + v.rank), 0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0), 9) AS s FROM v FULL JOIN b USING (query_id, doc_id)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rv NULLS LAST, rb NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 5),
 s0 AS (SELECT query_id, avg(CASE WHEN s >= 0.01 THEN 1.0 ELSE 0.0 END) AS p, first(left(q.text, 200)) AS expected_answer, left(string_agg(coalesce(t.text, ''), chr(10) || chr(10) ORDER BY rank), 2000) AS context FROM best JOIN documents q ON q.doc_id = query_id JOIN documents t ON t.doc_id = best.doc_id WHERE length(q.text) > 0 GROUP BY 1)
 SELECT query_id AS question_id, round(p, 6) AS precision, round(CASE WHEN trim(context) = '' THEN 0.0 WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(lower(context), w))) * 100.0 / len(k) WHEN len(list_filter(list_filter(regexp_split_to_array(lower(expected_answer), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: contains(lower(context), w))) > 0 THEN 50.0 ELSE 0.0 END, 6) AS accuracy FROM (SELECT *, {KEYWORDS} AS k FROM s0)""")
def hybrid_eval(spark, d):
    """Each question against what hybrid retrieval in a batch gives it: precision of the fused scores, accuracy of the texts."""
    return evaluate.question_scores(_retrieved(spark, d), threshold=0.01)


# --- knowledge and reports ------------------------------------------------------------------------------------------


@query("""SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE length(trim(coalesce(content, ''), ' ')) > 0))::BIGINT AS succeeded, (count(*) FILTER (WHERE NOT length(trim(coalesce(content, ''), ' ')) > 0))::BIGINT AS failed, (SELECT count(*) FROM rag_chunks)::BIGINT AS chunks, (SELECT count(*) FROM rag_knowledge_questions)::BIGINT AS questions FROM rag_documents""")
def ingest_summary(spark, d):
    return store.ingest_summary(table(spark, d, "rag_documents", "content"), table(spark, d, "rag_chunks", "id"), table(spark, d, "rag_knowledge_questions", "id"))


@query("""SELECT count(*)::BIGINT AS entries, coalesce(sum(size), 0)::BIGINT AS bytes, round(coalesce(sum(size), 0) / 1048576.0, 2) AS megabytes, round(count(file_hash) / count(*), 6) AS hit_rate FROM file_analysis""")
def cache_stats(spark, d):
    """Analysed files stand for cache entries; those with a hash were hits."""
    return store.cache_stats(table(spark, d, "file_analysis", "size", "file_hash"), "size", F.col("file_hash").isNotNull())


@query("""SELECT n.*, l.ts AS latest_ts, l.value AS latest_value FROM (SELECT (SELECT count(*) FROM rag_documents)::BIGINT AS documents, (SELECT count(*) FROM rag_chunks)::BIGINT AS chunks) n, (SELECT ts, value FROM events WHERE ts = (SELECT max(ts) FROM events) LIMIT 1) l""")
def stats_with_latest(spark, d):
    """Counts with the newest score; events stand for scores."""
    counts = table(spark, d, "rag_documents", "id").agg(F.count("*").alias("documents")).crossJoin(table(spark, d, "rag_chunks", "id").agg(F.count("*").alias("chunks")))  # single rows
    return store.with_latest(counts, table(spark, d, "events", "ts", "value"), "ts", "value")


@query("""SELECT topic, facts, first, row_number() OVER (ORDER BY first, topic) AS place FROM (SELECT coalesce(topic, 'General') AS topic, count(*)::BIGINT AS facts, min(created_at) AS first FROM (SELECT DISTINCT id, topic, created_at FROM rag_knowledge_questions) GROUP BY 1)""")
def facts_by_topic(spark, d):
    """Stored questions stand for facts."""
    q = table(spark, d, "rag_knowledge_questions", "id", F.coalesce("topic", F.lit("General")).alias("topic"), "created_at").distinct()
    return learning.by_topic(q, "topic", "created_at")


@query("""SELECT id, rating AS success_rate, coalesce(len(context_chunks), 0)::INT AS times_applied FROM (SELECT DISTINCT id, rating, context_chunks FROM rag_user_feedback WHERE rating IS NOT NULL) ORDER BY success_rate DESC, times_applied DESC, id LIMIT 20""")
def refinements_leaderboard(spark, d):
    """Feedback stands for refinements: its rating for success, its context chunks for uses."""
    f = table(spark, d, "rag_user_feedback", "id", F.col("rating").alias("success_rate"), F.coalesce(F.array_size("context_chunks"), F.lit(0)).alias("times_applied")).where("success_rate IS NOT NULL").distinct()
    return learning.refinements_leaderboard(f, "id")


@query("""SELECT question, max(c).a AS chosen, min(c).a AS rejected, round(max(c).r - min(c).r, 6) AS margin FROM (SELECT question, {'r': rating, 'a': answer} AS c FROM rag_user_feedback WHERE rating IS NOT NULL AND answer IS NOT NULL) GROUP BY 1 HAVING max(c).r > min(c).r AND max(c).a <> min(c).a""")
def preference_pairs(spark, d):
    return learning.preferences(table(spark, d, "rag_user_feedback", "question", "answer", "rating"), "question", "answer", "rating")


@query("SELECT event_id, value FROM events WHERE value > 1 ORDER BY value DESC, event_id LIMIT 5")
def bottlenecks(spark, d):
    return evaluate.slowest(table(spark, d, "events", "event_id", "value"), "event_id", "value")


@query("SELECT event_type AS name FROM events UNION SELECT difficulty FROM rag_knowledge_questions")
def name_union(spark, d):
    """Names of two sets, each once."""
    return table(spark, d, "events", F.col("event_type").alias("name")).unionByName(table(spark, d, "rag_knowledge_questions", F.col("difficulty").alias("name"))).distinct()


@query("SELECT event_id, ts, event_type AS status FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 10")
def analyses_by_status(spark, d):
    """Events stand for analyses, their type for the status; the first status by name."""
    e = table(spark, d, "events", "event_id", "ts", F.col("event_type").alias("status"))
    return agents.with_status(e, e.agg(F.min("status")).first()[0], "ts", "event_id")


_STATES = "CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END"


@query(f"SELECT (count(*) FILTER (WHERE s = 'completed'))::BIGINT AS completed, (count(*) FILTER (WHERE s = 'running'))::BIGINT AS running, (count(*) FILTER (WHERE s = 'failed'))::BIGINT AS failed, count(*)::BIGINT AS total, round((count(*) FILTER (WHERE s IN ('completed', 'failed'))) * 100.0 / count(*), 6) AS percent FROM (SELECT {_STATES} AS s FROM events)")
def task_progress(spark, d):
    """Events stand for tasks, in states by their number."""
    return agents.progress(table(spark, d, "events", F.expr(_STATES).alias("status")), "status")


def _long(path: str, text: str) -> list[tuple]:
    return [("high", "long file", None)] if len(text) > 2000 else []


def _empty(path: str, text: str) -> list[tuple]:
    if path.endswith(".md"):
        raise ValueError("not code")
    return [] if text else [("low", "no content", None)]


@query("""SELECT agent, status, count(*)::BIGINT AS files, sum(issues)::BIGINT AS issues FROM (SELECT 'long' AS agent, 'completed' AS status, (length(coalesce(content, '')) > 2000)::INT AS issues FROM file_analysis
 UNION ALL SELECT 'empty', CASE WHEN ends_with(path, '.md') THEN 'failed' ELSE 'completed' END, CASE WHEN ends_with(path, '.md') OR coalesce(content, '') <> '' THEN 0 ELSE 1 END FROM file_analysis) GROUP BY ALL""")
def agent_results(spark, d):
    """Two agents over all files, one of which fails on some: results and findings by agent."""
    held = agents.Registry()
    held.register("long", _long, "size")
    held.register("empty", _empty, "size", 1)
    found = agents.run(table(spark, d, "file_analysis", "file_id", "path", "content"), "file_id", "path", "content", held.agents())
    return found.groupBy("agent", "status").agg(F.count("*").alias("files"), F.sum(F.size("issues")).cast("bigint").alias("issues"))


@query("SELECT path, CASE WHEN length(content) < 2000 THEN content END AS text FROM (SELECT DISTINCT file_id, path, content FROM file_analysis) ORDER BY path, file_id LIMIT 10")
def prompt_files(spark, d):
    f = table(spark, d, "file_analysis", "file_id", "path", "content").distinct()
    return agents.prompt_files(f.orderBy("path", "file_id").limit(10), "path", "content")


# --- sources, paths and replies -------------------------------------------------------------------------------------


@query("SELECT id, start_char, end_char FROM (SELECT DISTINCT id, document_id, start_char, end_char FROM rag_chunks) WHERE document_id = (SELECT min(document_id) FROM rag_chunks) ORDER BY start_char, id")
def pieces_of_document(spark, d):
    c = table(spark, d, "rag_chunks", "id", "document_id", "start_char", "end_char")
    return store.pieces_of(c, c.agg(F.min("document_id")).first()[0]).select("id", "start_char", "end_char").distinct()


@query(f"SELECT DISTINCT path, size, {language_case('path')} AS language, sha256(content) AS file_hash FROM github_files WHERE type = 'file' AND content IS NOT NULL")
def scan_to_analysis(spark, d):
    f = table(spark, d, "github_files", "path", "size", "type", "content").where("type = 'file' AND content IS NOT NULL")
    return files.analyses(f).select("path", "size", "language", "file_hash").distinct()


@query("""SELECT file_id, 'https://github.com/' || repo || '/blob/main/' || path || '#L1-L9' AS web, 'https://raw.githubusercontent.com/' || repo || '/main/' || path AS raw, 'https://api.github.com/repos/' || repo || '/contents' AS api FROM (SELECT DISTINCT file_id, repo, path FROM github_files)""")
def built_urls(spark, d):
    f = table(spark, d, "github_files", "file_id", "repo", "path").distinct()
    owner, repo = F.split_part("repo", F.lit("/"), F.lit(1)), F.split_part("repo", F.lit("/"), F.lit(2))
    return f.select("file_id", P.file_url(owner, repo, F.col("path"), "main", F.lit(1), F.lit(9)).alias("web"), P.raw_url(owner, repo, F.col("path")).alias("raw"), P.api_url(owner, repo, "contents").alias("api"))


@query(r"SELECT DISTINCT file_id, regexp_replace(translate('\' || path || '//', '\', '/'), '^/+|/+$', '', 'g') AS plain, round(size / 1073741824.0, 2) AS gb, round(size / 1048576.0, 1) AS mb FROM github_files")
def path_forms(spark, d):
    f = table(spark, d, "github_files", "file_id", "path", "size")
    return f.select("file_id", P.normalised(F.concat(F.lit("\\"), "path", F.lit("//"))).alias("plain"), T.gigabytes(F.col("size")).alias("gb"), T.megabytes(F.col("size")).alias("mb")).distinct()


@query("SELECT DISTINCT file_id, md5(CASE WHEN encoding = 'base64' THEN decode(from_base64(regexp_replace(content, '\\s', '', 'g'))) ELSE content END) AS digest FROM github_files WHERE content IS NOT NULL")
def hosted_digests(spark, d):
    """The decoded content of every file, told by its digest."""
    f = hosting.decoded(table(spark, d, "github_files", "file_id", "content", "encoding").where("content IS NOT NULL"))
    return f.select("file_id", F.md5("content").alias("digest")).distinct()


REPLIES = ['Sure: [{"question": "What is a shard?", "answer": "A part.", "difficulty": "easy"}, {"question": null, "answer": "x"}] done', "Q: Who\nwrites it?\nA: The writer.\nQ: When?\nA: At night, in two\nlines.", "I can't.", '{"score": 140} and {"score": 3}', "score unknown", '["First fact", " ", "Second fact"]']
_MADE = [(0, "What is a shard?", "A part.", "general", "easy"), (1, "Who\nwrites it?", "The writer.", "general", "medium"), (1, "When?", "At night, in two\nlines.", "general", "medium")]


@query(f"SELECT * FROM (VALUES {_rows(*_MADE)}) v(reply, question, expected_answer, topic, difficulty)")
def model_replies(spark, d):
    """Questions from stated replies of a model: a JSON array, lines of Q and A, neither."""
    r = spark.createDataFrame(list(enumerate(REPLIES)), "reply int, body string")
    return r.select("reply", F.explode(T.model_questions(F.col("body"))).alias("q")).select("reply", "q.*")


@query("SELECT * FROM (VALUES (0, 50.0, 0), (1, 50.0, 0), (2, 50.0, 0), (3, 100.0, 0), (4, 50.0, 0), (5, 50.0, 2)) v(reply, score, facts)")
def model_scores(spark, d):
    """Scores and facts of the same replies; a reply without a score keeps the heuristic 50."""
    r = spark.createDataFrame(list(enumerate(REPLIES)), "reply int, body string")
    return r.select("reply", T.model_score(F.col("body"), F.lit(50.0)).alias("score"), F.size(T.model_facts(F.col("body"))).alias("facts"))


MODELS = [("nomic-embed-text", "embedding", 0.3), ("bge-small", "embedding", 0.1), ("small-chat", "chat", 2.0), ("large-chat", "chat", 40.0)]


@query("SELECT * FROM (VALUES ('bge-small', 'embeds'), ('nomic-embed-text', 'embeds'), ('small-chat', 'fits')) v(name, why)")
def model_choice(spark, d):
    """Of stated models, those that embed by name, and those for chat that fit 8 GB."""
    m = spark.createDataFrame(MODELS, "name string, category string, size_gb double")
    return models.named(m, "name").select("name", F.lit("embeds").alias("why")).unionByName(models.recommended(m, "chat", 8.0).select("name", F.lit("fits").alias("why")))


@query("SELECT event_type, CASE lower(event_type) WHEN 'stop' THEN 'complete' WHEN 'length' THEN 'truncated' ELSE 'other' END AS finish, count(*)::BIGINT AS n, round(min(2 ** (event_id % 5)), 6) AS least_wait FROM events GROUP BY 1, 2")
def finish_reasons(spark, d):
    """Events stand for calls: how they finished by type, and the least wait of a retry."""
    e = table(spark, d, "events", "event_id", "event_type")
    return e.groupBy("event_type", T.finished(F.col("event_type")).alias("finish")).agg(F.count("*").alias("n"), F.round(F.min(T.backoff(F.col("event_id") % 5)), 6).alias("least_wait"))


assert QUERIES
