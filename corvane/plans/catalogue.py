"""Named queries over the operators, each with the SQL that checks it where SQL can express it.

Where a test table stands in for a stored one the docstring says so: ``rag_documents``, ``rag_chunks``,
``rag_knowledge_questions`` and ``rag_user_feedback`` are the stored tables themselves; ``documents`` and ``embeddings``
are a text corpus with vectors by ``vec_id = doc_id``; ``events`` stand for timed scores, durations and calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.operators import chunking, code, evaluate, learning, models, retrieval, store
from corvane.plans.sql import BM25, KEYWORDS, LATEST, RRF, STRATEGY, TRIGRAMS, language_case, values
from corvane.sources import hosting
from corvane.sources.tables import table
from corvane.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TERMS = ["cache", "index", "partition"]
#: Prices of made-up models for 1000 tokens, in and out.
PRICES = [("small", 0.0005, 0.0015), ("large", 0.01, 0.03)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- retrieval -----------------------------------------------------------------------------------------------------


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").where("vec_id = 0").select("embedding")


_COS = "round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 6)"


@query(f"""SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM
 (SELECT e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 20)""")
def vector_topk(spark, d):
    return retrieval.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20)


@query(f"""SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM
 (SELECT e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 3) ORDER BY 2 DESC, 1 LIMIT 20)""")
def vector_topk_filtered(spark, d):
    """The filter reaches the scan."""
    return retrieval.vector_topk(table(spark, d, "embeddings").where(F.col("label").isin(1, 3)), "vec_id", "embedding", _query_vector(spark, d), 20)


@query(f"""SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 10""")
def vector_topk_batch(spark, d):
    """Queries are the rows whose id is divisible by 100, against all rows."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.vector_topk_batch(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), "vec_id", 10)


@query(f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, score FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 20)")
def bm25_topk(spark, d):
    return retrieval.bm25_topk(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", TERMS, 20)


@query("""SELECT doc_id, hits, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM (SELECT doc_id, sum(tf)::BIGINT AS hits FROM
 (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+')) AS term FROM documents) WHERE term IN ('cache','index','partition') GROUP BY ALL)
 GROUP BY doc_id HAVING count(*) = 3 ORDER BY hits DESC, doc_id LIMIT 20)""")
def fulltext_and(spark, d):
    return retrieval.fulltext_and(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", TERMS, 20)


def _hybrid(alpha: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        items = table(spark, d, "embeddings", F.col("vec_id").alias("doc_id"), "embedding")
        return retrieval.hybrid_search(items, table(spark, d, "documents", "doc_id", "text"), "doc_id", "embedding", "text", _query_vector(spark, d), TERMS, top=10, alpha=alpha)

    return run


for _name, _alpha in (("hybrid_rrf", 0.5), ("hybrid_rrf_alpha0", 0.0), ("hybrid_rrf_alpha1", 1.0)):
    QUERIES[_name] = _hybrid(_alpha)
    ORACLES[_name] = RRF.replace("ALPHA", str(_alpha)).replace("COSINE", _COS)


@query(f"SELECT id, round(similarity, 6) AS similarity FROM (SELECT id, {TRIGRAMS} AS similarity FROM rag_knowledge_questions) WHERE similarity > 0.3")
def trigram_similarity(spark, d):
    """Stored questions alike to a given one by trigrams."""
    q = table(spark, d, "rag_knowledge_questions", "id", F.round(T.trigram_similarity(F.col("question"), F.lit("Which port does the cache use?")), 6).alias("similarity"))
    return q.where("similarity > 0.3")


@query("""SELECT id, question, correction FROM (SELECT DISTINCT * EXCLUDE (metadata, context_chunks) FROM rag_user_feedback WHERE feedback_type = 'correction' AND correction IS NOT NULL ORDER BY created_at DESC, id LIMIT 100)
 WHERE contains(lower(question), 'cache') OR contains(lower(question), 'limit') ORDER BY created_at DESC, id LIMIT 3""")
def corrections_match(spark, d):
    f = table(spark, d, "rag_user_feedback", "id", "question", "answer", "feedback_type", "correction", "created_at").distinct()
    return learning.corrections(f, "cache limit").select("id", "question", "correction")


@query("SELECT DISTINCT id, question, topic FROM rag_knowledge_questions WHERE document_id IS NOT NULL AND topic IS NOT NULL AND contains(lower(topic), 'cache')")
def questions_filter(spark, d):
    q = table(spark, d, "rag_knowledge_questions", "id", "document_id", "question", "topic")
    return q.where(F.col("document_id").isNotNull() & F.contains(F.lower("topic"), F.lit("cache"))).select("id", "question", "topic").distinct()


# --- chunking ------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, chunk_index::INT AS chunk_index, start_char::INT AS start_char, length(content)::INT AS chars, md5(content) AS digest FROM (SELECT doc_id, unnest(range(n)) AS chunk_index, unnest(range(n)) * 1844 AS start_char,
 substring(text, (unnest(range(n)) * 1844 + 1)::BIGINT, 2048) AS content FROM (SELECT doc_id, text, CASE WHEN length(text) <= 2048 THEN 1 ELSE ceil(length(text) / 1844.0)::INT END AS n FROM documents WHERE length(text) > 0))""")
def chunk_fixed_window(spark, d):
    c = chunking.fixed_windows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "start_char", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query("""WITH RECURSIVE c(doc_id, text, i, s, e) AS (
 SELECT doc_id, text, 0, 0, CASE WHEN length(text) <= 2048 THEN length(text) ELSE coalesce(2048 - nullif(strpos(reverse(substring(text, 2048 - 204 + 1, 204)), ' '), 0) + 1, 2048) END FROM documents WHERE length(text) > 0
 UNION ALL SELECT doc_id, text, i + 1, e - 204, CASE WHEN e - 204 + 2048 >= length(text) THEN length(text) ELSE coalesce(e - 204 + 2048 - nullif(strpos(reverse(substring(text, e - 204 + 2048 - 204 + 1, 204)), ' '), 0) + 1, e - 204 + 2048) END FROM c WHERE e < length(text))
 SELECT doc_id, i::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char FROM c""")
def chunk_fixed_chars(spark, d):
    return chunking.chunk(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", "fixed").select("doc_id", "chunk_index", "start_char", "end_char")


@query("""SELECT doc_id, k::INT AS chunk_index, len(part)::INT AS lines, md5(array_to_string(part, chr(10))) AS digest FROM (SELECT doc_id, k, l[(k * 46 + 1):(k * 46 + 51)] AS part FROM
 (SELECT doc_id, l, unnest(range(CASE WHEN len(l) < 51 THEN 1 ELSE floor((len(l) - 51) / 46.0)::INT + 2 END)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0)))""")
def chunk_lines(spark, d):
    c = chunking.native_lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "lines", F.md5("content").alias("digest"))


@query("SELECT doc_type, count(*)::BIGINT AS documents, sum(length(text) // 4)::BIGINT AS tokens, max(length(text) // 4)::BIGINT AS longest FROM documents GROUP BY 1")
def token_stats(spark, d):
    t = table(spark, d, "documents", "doc_type", T.token_count(F.col("text")).alias("t"))
    return t.groupBy("doc_type").agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"), F.max("t").alias("longest"))


@query(f"SELECT {STRATEGY} AS strategy, count(DISTINCT id)::BIGINT AS documents FROM rag_documents GROUP BY 1")
def chunk_strategy_route(spark, d):
    r = table(spark, d, "rag_documents", "id", P.strategy(F.coalesce("source", F.lit(""))).alias("strategy"))
    return r.groupBy("strategy").agg(F.count_distinct("id").alias("documents"))


@query()
def chunk_auto(spark, d):
    """Every document in chunks of the strategy of its extension: semantic, code or fixed."""
    docs = table(spark, d, "rag_documents", "id", "source", "content").dropDuplicates(["id"])
    return chunking.auto(docs, "id", "content", "source").select("id", "strategy", "chunk_index", "total_chunks", "start_char", "end_char")


@query("""SELECT document_id, id, (row_number() OVER (PARTITION BY document_id ORDER BY id) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY document_id)::BIGINT AS total_chunks FROM (SELECT DISTINCT document_id, id FROM rag_chunks)""")
def chunk_index_window(spark, d):
    return chunking.index_within(table(spark, d, "rag_chunks", "document_id", "id").distinct(), "document_id", "id")


@query("""SELECT id, count(*)::BIGINT AS paragraphs, sum(length(p))::BIGINT AS chars FROM (SELECT DISTINCT id, content FROM rag_documents) r, unnest(list_filter(list_transform(regexp_split_to_array(content, '\\n[ \\t\\r\\n\\f\\v]*\\n'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda x: x <> '')) AS u(p) GROUP BY id""")
def paragraphs(spark, d):
    r = table(spark, d, "rag_documents", "id", "content").distinct()
    parts = r.select("id", F.explode(chunking.paragraphs(F.col("content"))).alias("p"))
    return parts.groupBy("id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"))


@query("""WITH RECURSIVE s AS (SELECT id, list_transform(list_filter(regexp_split_to_array(content, '\\n'), lambda x: x <> ''), lambda x: length(x)::BIGINT) AS l FROM (SELECT DISTINCT id, content FROM rag_documents)),
 f(id, l, i, pack, filled) AS (SELECT id, l, 1, 0, l[1] FROM s WHERE len(l) > 0 UNION ALL SELECT id, l, i + 1, CASE WHEN filled > 0 AND filled + l[i + 1] > 900 THEN pack + 1 ELSE pack END, CASE WHEN filled > 0 AND filled + l[i + 1] > 900 THEN l[i + 1] ELSE filled + l[i + 1] END FROM f WHERE i < len(l))
 SELECT id, pack::INT AS pack, count(*)::BIGINT AS pieces FROM f GROUP BY id, pack""")
def line_pack(spark, d):
    """Lines packed greedily in order, an ordered fold."""
    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    r = table(spark, d, "rag_documents", "id", "content").distinct().select("id", F.explode(chunking.greedy_pack(F.transform(lines, lambda x: F.length(x).cast("bigint")), 900)).alias("pack"))
    return r.groupBy("id", "pack").agg(F.count("*").alias("pieces"))


# --- store ---------------------------------------------------------------------------------------------------------


@query("SELECT id, created_at FROM (SELECT DISTINCT id, created_at FROM rag_documents) ORDER BY created_at DESC, id LIMIT 10 OFFSET 5")
def doc_page(spark, d):
    return store.page(table(spark, d, "rag_documents", "id", "created_at").distinct(), "created_at", "id", 10, 5)


@query("""WITH f AS (SELECT id, arg_min(source, updated_at) AS source, min(updated_at) AS first, max(updated_at) AS last, any_value(length(content))::INT AS chars FROM rag_documents GROUP BY 1)
 SELECT id, CASE WHEN hash % 3 = 0 THEN 'new' ELSE source END AS source, chars, last AS updated_at FROM (SELECT *, length(id || coalesce(source, '')) AS hash FROM f)""")
def doc_upsert(spark, d):
    """First deliveries are stored, but for those that come new; then all rows are written over them: the newest row counts,
    the stored source stays (a new document is marked by its change's source)."""
    t = table(spark, d, "rag_documents", "id", "source", F.length("content").alias("chars"), "updated_at")
    first = t.groupBy("id").agg(F.min_by(F.struct("source", "chars", "updated_at"), "updated_at").alias("r")).select("id", "r.*")
    unseen = F.length(F.concat("id", F.coalesce("source", F.lit("")))) % 3 == 0
    changes = t.join(first.where(unseen).select("id", F.lit(True).alias("unseen")), "id", "left").select("id", F.when(F.col("unseen"), "new").otherwise(F.lit("not taken over")).alias("source"), "chars", "updated_at")
    return store.upsert(first.where(~unseen), changes, "id", "updated_at", keep=("source",))


@query("SELECT id, CASE WHEN bool_or(topic IS NOT NULL) THEN 'stored' ELSE 'added' END AS origin FROM rag_knowledge_questions GROUP BY 1")
def question_insert_ignore(spark, d):
    """Questions with a topic stored first, then all: only new ids are added, stored rows stay as they are."""
    q = table(spark, d, "rag_knowledge_questions", "id", "topic")
    stored = q.where(F.col("topic").isNotNull()).select("id", F.lit("stored").alias("origin")).distinct()
    return store.insert_ignore(stored, q.select("id", F.lit("added").alias("origin")), "id")


@query("""WITH gone AS (SELECT id FROM rag_documents WHERE source LIKE '%README.md') SELECT 'chunks' AS tbl, id, document_id FROM rag_chunks c WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = c.document_id)
 UNION ALL SELECT 'questions', id, document_id FROM rag_knowledge_questions c WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = c.document_id) UNION ALL SELECT 'documents', id, NULL FROM rag_documents d WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = d.id)""")
def doc_delete_cascade(spark, d):
    """What is left of documents, chunks and questions when the documents of one kind are deleted."""
    docs = table(spark, d, "rag_documents", "id", "source")
    left = store.delete_cascade(docs, "id", docs.where("source LIKE '%README.md'"), {"chunks": (table(spark, d, "rag_chunks", "id", "document_id"), "document_id"), "questions": (table(spark, d, "rag_knowledge_questions", "id", "document_id"), "document_id")})
    rows = lambda df, name, ref: df.select(F.lit(name).alias("tbl"), "id", ref.alias("document_id"))
    parent = F.lit(None).cast("string")
    return rows(left["chunks"], "chunks", F.col("document_id")).unionByName(rows(left["questions"], "questions", F.col("document_id"))).unionByName(rows(left[""], "documents", parent))


@query("""SELECT (SELECT count(*) FROM rag_documents)::BIGINT AS documents, (SELECT count(*) FROM rag_chunks)::BIGINT AS chunks, (SELECT count(embedding) FROM rag_chunks)::BIGINT AS embedded, (SELECT count(*) FROM rag_knowledge_questions)::BIGINT AS questions,
 round((SELECT count(embedding) / count(*) FROM rag_chunks), 6) AS embedding_coverage""")
def kb_stats(spark, d):
    return store.counts(table(spark, d, "rag_documents"), table(spark, d, "rag_chunks"), table(spark, d, "rag_knowledge_questions"))


@query("SELECT doc_id, label FROM documents JOIN embeddings ON vec_id = doc_id WHERE length(text) > 0")
def chunk_embed_join(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(F.length("text") > 0).join(table(spark, d, "embeddings", "vec_id", "label"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "label")


@query("SELECT doc_id, sha256('m:' || text) AS cache_key, sha256('m:' || text) IN (SELECT sha256('m:' || text) FROM documents WHERE doc_type = 'note' AND text IS NOT NULL) AS hit FROM documents WHERE text IS NOT NULL")
def embed_cache_probe(spark, d):
    """Texts of notes are cached; all texts are looked up."""
    docs = table(spark, d, "documents", "doc_id", "doc_type", "text").where(F.col("text").isNotNull())
    cache = docs.where("doc_type = 'note'").select(store.cache_key("m", F.col("text")).alias("cache_key"))
    return store.cache_probe(docs, cache, "m", "text").select("doc_id", "cache_key", "hit")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def lru_trim(spark, d):
    """A cache of 100 entries, as the report's limit has it; events stand for uses."""
    return store.lru_trim(table(spark, d, "events", "event_id", "ts"), "ts", "event_id", 100)


@query("SELECT doc_id, sha256('m:' || text) AS digest FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", store.cache_key("m", F.col("text")).alias("digest"))


@query("SELECT event_type, count(*)::BIGINT AS live FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 86400 GROUP BY 1")
def cache_ttl(spark, d):
    """Entries of the last day."""
    e = table(spark, d, "events", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    return store.live(e.crossJoin(F.broadcast(now)), "ts", F.col("now"), 86400).groupBy("event_type").agg(F.count("*").alias("live"))  # one row is broadcast


# --- evaluation ----------------------------------------------------------------------------------------------------

_PAIRED = "(SELECT DISTINCT q.id AS qid, q.expected_answer, c.id AS cid, c.content FROM rag_knowledge_questions q JOIN rag_chunks c ON q.document_id = c.document_id WHERE q.expected_answer IS NOT NULL AND c.content IS NOT NULL)"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "rag_knowledge_questions", F.col("id").alias("qid"), "document_id", "expected_answer").where(F.col("expected_answer").isNotNull()).distinct()
    c = table(spark, d, "rag_chunks", F.col("id").alias("cid"), "document_id", "content").where(F.col("content").isNotNull()).distinct()
    return q.join(c, "document_id").select("qid", "expected_answer", "cid", "content")


@query(f"""SELECT qid, cid, round(CASE WHEN trim(content) = '' THEN 0.0 WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(low, w))) * 100.0 / len(k) WHEN len(list_filter(list_filter(regexp_split_to_array(lower(expected_answer), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: contains(low, w))) > 0 THEN 50.0 ELSE 0.0 END, 6) AS accuracy
 FROM (SELECT *, lower(content) AS low, {KEYWORDS} AS k FROM {_PAIRED})""")
def answer_accuracy(spark, d):
    """Each question's expected answer against each chunk of its document."""
    return _paired(spark, d).select("qid", "cid", F.round(T.accuracy(F.col("expected_answer"), F.col("content")), 6).alias("accuracy"))


@query(f"""SELECT qid, cid, round(CASE WHEN contains(lower(content), lower(expected_answer)) THEN 100.0 WHEN len(k) = 0 THEN 50.0 ELSE len(list_filter(k, lambda w: contains(lower(content), w))) * 100.0 / len(k) END, 6) AS accuracy FROM
 (SELECT *, list_filter(regexp_split_to_array(lower(expected_answer), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 2 AND w NOT IN ({values(T.STRICT_STOPS)})) AS k FROM {_PAIRED})""")
def answer_accuracy_strict(spark, d):
    return _paired(spark, d).select("qid", "cid", F.round(T.accuracy_strict(F.col("expected_answer"), F.col("content")), 6).alias("accuracy"))


@query(f"""SELECT qid, round(avg(CASE WHEN len(list_filter(k, lambda w: contains(lower(content), w))) >= len(k) * 0.5 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM
 (SELECT *, list_filter(regexp_split_to_array(lower(expected_answer), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 2) AS k FROM {_PAIRED}) GROUP BY qid""")
def retrieval_precision(spark, d):
    r = _paired(spark, d).select("qid", T.relevant(F.col("expected_answer"), F.col("content")).cast("double").alias("r"))
    return r.groupBy("qid").agg(F.round(F.avg("r"), 6).alias("precision"))


_FIRST5 = """(SELECT qid AS question_id, expected_answer, cid AS chunk_id, content, r AS rank, 1.0 / r AS combined_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cid) AS r FROM """ + _PAIRED + ") WHERE r <= 5)"


@query(f"""WITH s AS (SELECT question_id, avg(CASE WHEN combined_score >= 0.3 THEN 1.0 ELSE 0.0 END) AS p, first(expected_answer) AS expected_answer, left(string_agg(content, chr(10) || chr(10) ORDER BY rank), 2000) AS context FROM {_FIRST5} GROUP BY 1),
 a AS (SELECT round(p, 6) AS p, round(CASE WHEN trim(context) = '' THEN 0.0 WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(lower(context), w))) * 100.0 / len(k) WHEN len(list_filter(list_filter(regexp_split_to_array(lower(expected_answer), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: contains(lower(context), w))) > 0 THEN 50.0 ELSE 0.0 END, 6) AS acc FROM (SELECT *, {KEYWORDS} AS k FROM s)),
 m AS (SELECT count(*)::BIGINT AS n, avg(p) AS p, avg(acc) AS acc FROM a), c AS (SELECT (SELECT count(DISTINCT chunk_id) FROM {_FIRST5}) / (SELECT count(embedding) FROM rag_chunks) AS c)
 SELECT n AS questions_evaluated, round(p, 6) AS retrieval_precision, round(acc, 6) AS answer_accuracy, round(c, 6) AS coverage_ratio, round(0.4 * acc + 35 * p + 25 * c, 6) AS overall_score FROM m, c""")
def knowledge_eval(spark, d):
    """Each question with the first five chunks of its document as its result; the scores are 1 over the rank."""
    from pyspark.sql import Window

    r = _paired(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("cid"))).where("rank <= 5")
    r = r.select(F.col("qid").alias("question_id"), "expected_answer", F.col("cid").alias("chunk_id"), "content", "rank", (1.0 / F.col("rank")).alias("combined_score"))
    return evaluate.evaluation(evaluate.question_scores(r), r, table(spark, d, "rag_chunks", "embedding"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS evaluations, round(avg(value), 6) AS mean_value FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 90) GROUP BY 1""")
def score_trend(spark, d):
    """The newest 90 scores by day; events stand for scores."""
    e = table(spark, d, "events", "event_id", "ts", "value")
    return evaluate.trend(e, "ts", 30, mean_value=F.col("value"))


@query("""SELECT day, mean, round(mean - lag(mean) OVER (ORDER BY day), 6) AS delta FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS mean FROM events GROUP BY 1)""")
def score_delta(spark, d):
    return evaluate.deltas(table(spark, d, "events", "ts", "value"), "ts", "value")


@query("""SELECT first, last, round((last - first) / first * 100, 6) AS percent FROM (SELECT arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events)""")
def improvement_pct(spark, d):
    return evaluate.improvement(table(spark, d, "events", "event_id", "value"), "value", "event_id")


@query("""SELECT event_type, count(*)::BIGINT AS runs, (count(*) FILTER (WHERE value < 50))::BIGINT AS passed, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1""")
def duration_stats(spark, d):
    return evaluate.durations(table(spark, d, "events", "event_type", "value"), "event_type", "value", F.col("value") < 50)


@query("SELECT event_type AS status, count(*)::BIGINT AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return code.rollup(table(spark, d, "events", F.col("event_type").alias("status")), "status")


@query("SELECT event_id, round(0.4 * value + 35 * (event_id % 11) / 10 + 25 * (user_id % 5) / 4, 6) AS overall FROM events")
def overall_score(spark, d):
    """Events stand for evaluations of different precision, accuracy and coverage."""
    return table(spark, d, "events", "event_id", F.round(T.overall_score(F.col("event_id") % 11 / 10, F.col("value"), F.col("user_id") % 5 / 4), 6).alias("overall"))


# --- learning ------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT id, 'feedback' AS kind, answer AS content, rating AS confidence FROM rag_user_feedback UNION ALL SELECT DISTINCT id, 'correction', correction, 0.8 FROM rag_user_feedback WHERE rating < 0 AND correction IS NOT NULL""")
def feedback_router(spark, d):
    """What feedback gives to store: each row, and corrections; the kinds extracted from texts are held by unit tests."""
    f = table(spark, d, "rag_user_feedback", "id", "answer", "rating", "correction").dropDuplicates(["id"])
    return learning.route(f).where(F.col("kind").isin("feedback", "correction"))


@query()
def feedback_learned(spark, d):
    """Every fact, chain and correction that feedback gives."""
    return learning.route(table(spark, d, "rag_user_feedback", "id", "answer", "rating", "correction").dropDuplicates(["id"]))


@query("SELECT question AS original_query, correction AS refined_query, rating AS improvement_score, 1.0::DOUBLE AS success_rate FROM rag_user_feedback WHERE correction IS NOT NULL AND question IS NOT NULL AND question <> correction")
def refinements(spark, d):
    """Corrections stand for refined queries."""
    return learning.refinements(table(spark, d, "rag_user_feedback", F.col("question").alias("original_query"), F.col("correction").alias("refined_query"), "rating"))


@query("""WITH RECURSIVE u AS (SELECT user_id, ts, event_id, value > 50 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN value > 50 THEN 0.05 ELSE -0.02 END) AS i FROM events), f(user_id, i, c) AS (
 SELECT user_id, 1, greatest(0.0, least(1.0, 0.5 + CASE WHEN h THEN 0.05 ELSE -0.02 END)) FROM u WHERE i = 1 UNION ALL SELECT f.user_id, u.i, greatest(0.0, least(1.0, c + CASE WHEN h THEN 0.05 ELSE -0.02 END)) FROM f JOIN u ON u.user_id = f.user_id AND u.i = f.i + 1)
 SELECT n.user_id, n.usage_count, n.success_rate, round(f.c, 6)::DOUBLE AS confidence FROM f JOIN (SELECT user_id, count(*)::BIGINT AS usage_count, round(avg(h::INT), 6) AS success_rate FROM u GROUP BY 1) n ON n.user_id = f.user_id AND n.usage_count = f.i""")
def fact_usage_fold(spark, d):
    """Users' events stand for the uses of a fact, values above 50 for helpful ones."""
    e = table(spark, d, "events", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return learning.usage_fold(e, "user_id", "ts", F.col("value") > 50)


@query("""SELECT (SELECT count(*) FROM rag_knowledge_questions)::BIGINT AS facts, (SELECT round(coalesce(avg(0.1 * length(question)), 0), 6) FROM rag_knowledge_questions) AS avg_confidence, (SELECT round(coalesce(avg(CASE WHEN difficulty = 'easy' THEN 1.0 WHEN difficulty IS NOT NULL THEN 0.0 END), 0), 6) FROM rag_knowledge_questions) AS avg_success_rate, (SELECT count(*) FROM rag_user_feedback)::BIGINT AS chains, (SELECT count(*) FROM rag_user_feedback WHERE rating > 0)::BIGINT AS correct_chains, (SELECT count(*) FROM rag_user_feedback)::BIGINT AS feedback""")
def memory_stats(spark, d):
    """Questions stand for facts, their length for confidence and ease for success; feedback for chains."""
    f = table(spark, d, "rag_user_feedback", (F.col("rating") > 0).alias("was_correct"))
    return learning.memory_stats(table(spark, d, "rag_knowledge_questions", (F.length("question") * 0.1).alias("confidence"), F.when(F.col("difficulty") == "easy", 1.0).when(F.col("difficulty").isNotNull(), 0.0).alias("success_rate")), f, f)


@query("""SELECT count(*)::BIGINT AS processed, (count(*) FILTER (WHERE rating >= 0.6))::BIGINT AS positive, (count(*) FILTER (WHERE rating < 0 AND correction IS NOT NULL))::BIGINT AS corrected FROM rag_user_feedback""")
def batch_learn_counts(spark, d):
    f = table(spark, d, "rag_user_feedback", "rating", "correction")
    return f.agg(F.count("*").alias("processed"), F.count_if(F.col("rating") >= learning.POSITIVE).alias("positive"), F.count_if((F.col("rating") < 0) & F.col("correction").isNotNull()).alias("corrected"))


@query("SELECT DISTINCT id, list_filter(" + str(list(T.TOPICS)) + ", lambda t: contains(lower(question), lower(t)))[1] AS known, coalesce(list_filter(" + str(list(T.TOPICS)) + ", lambda t: contains(lower(question), lower(t)))[1], nullif(regexp_extract(question, '\\b([A-Z][a-z]+)\\b', 1), ''), 'General') AS topic FROM rag_knowledge_questions")
def topic_extract(spark, d):
    known = F.array(*[F.lit(t) for t in T.TOPICS])
    q = table(spark, d, "rag_knowledge_questions", "id", "question")
    return q.select("id", F.get(F.filter(known, lambda t: F.contains(F.lower("question"), F.lower(t))), 0).alias("known"), T.topic(F.col("question")).alias("topic")).distinct()


@query()
def fact_extract(spark, d):
    """Statements found in answers by rule."""
    return table(spark, d, "rag_user_feedback", "id", "answer").distinct().select("id", F.explode(T.facts(F.col("answer"))).alias("fact"))


@query()
def reasoning_detect(spark, d):
    """Answers with two steps of reasoning or more."""
    a = table(spark, d, "rag_user_feedback", "id", "answer").distinct().select("id", T.steps(F.col("answer")).alias("steps"), T.conclusion(F.col("answer")).alias("final_answer"))
    return a.where(F.size("steps") >= 2).select("id", F.slice("steps", 1, 5).alias("steps"), "final_answer")


@query("""SELECT id, question FROM (SELECT id, unnest(list_concat(list_concat(list_transform(regexp_extract_all(content, '(?m)^#+[ \\t\\n\\f\\r\\v]+([^\\n]+)$', 1)[1:2], lambda h: 'What does the section ''' || h || ''' cover?'), list_transform(regexp_extract_all(content, 'def\\s+(\\w+)\\s*\\(', 1)[1:2], lambda h: 'What does the function ''' || h || ''' do?')), list_transform(regexp_extract_all(content, 'class\\s+(\\w+)', 1)[1:2], lambda h: 'What is the purpose of the class ''' || h || '''?'))[1:3]) AS question FROM (SELECT DISTINCT id, regexp_replace(content, chr(13) || chr(10) || '?', chr(10), 'g') AS content FROM rag_documents))""")
def simple_questions(spark, d):
    """Questions by rule from headings, functions and classes, of all texts, their line ends made plain first."""
    r = table(spark, d, "rag_documents", "id", "content").distinct()
    return r.select("id", F.explode(T.questions(F.regexp_replace("content", r"\r\n?", "\n"))).alias("q")).select("id", "q.question")


@query()
def knowledge_bundle(spark, d):
    """Facts, chains, corrections and the refinement for one query, by kind: stored questions and feedback stand for them."""
    f = table(spark, d, "rag_user_feedback", "id", "question", "answer", "feedback_type", "correction", "created_at", "rating").dropDuplicates(["id"])
    facts = table(spark, d, "rag_knowledge_questions", "id", "question", "expected_answer").dropDuplicates(["id"]).where(F.contains(F.lower("question"), F.lit("cache"))).orderBy("id").limit(5).select(F.lit("fact").alias("kind"), "id", F.col("expected_answer").alias("content"))
    fixed = learning.corrections(f, "cache limit").select(F.lit("correction").alias("kind"), "id", F.col("correction").alias("content"))
    good = f.where((F.col("rating") >= learning.POSITIVE) & (F.size(T.steps(F.col("answer"))) >= 2)).orderBy(F.desc("rating"), "id").limit(2).select(F.lit("chain").alias("kind"), "id", T.conclusion(F.col("answer")).alias("content"))
    stored = learning.refinements(f.select("id", F.col("question").alias("original_query"), F.col("correction").alias("refined_query"), "rating"))
    best = learning.find_refinement(stored, "How do I reset the cache?").select(F.lit("refinement").alias("kind"), F.lit("").alias("id"), F.col("refined_query").alias("content"))
    return facts.unionByName(fixed).unionByName(good).unionByName(best)


@query("SELECT DISTINCT id, question FROM rag_user_feedback WHERE 0.5 + 0.3 * rating >= 0.6 AND contains(lower(question), 'which')")
def facts_filter(spark, d):
    """Feedback stands for facts, of confidence 0.5 + 0.3 x rating and with the question as topic."""
    f = table(spark, d, "rag_user_feedback", "id", "question", F.col("question").alias("topic"), (0.5 + 0.3 * F.col("rating")).alias("confidence")).where(F.col("confidence").isNotNull())
    return learning.relevant_facts(f, "which", 0.6).select("id", "question").distinct()


@query("SELECT id, round(0.5 + 0.3 * rating, 6) AS confidence, uses FROM (SELECT DISTINCT id, rating, coalesce(len(context_chunks), 0)::BIGINT AS uses FROM rag_user_feedback WHERE rating IS NOT NULL) ORDER BY round(0.5 + 0.3 * rating, 6) DESC, uses DESC, id LIMIT 50")
def facts_leaderboard(spark, d):
    """The report's first 50; the number of context chunks stands for uses."""
    f = table(spark, d, "rag_user_feedback", "id", F.round(0.5 + 0.3 * F.col("rating"), 6).alias("confidence"), F.coalesce(F.array_size("context_chunks"), F.lit(0)).cast("bigint").alias("usage_count")).where(F.col("confidence").isNotNull()).distinct()
    return learning.leaderboard(f, "id").withColumnRenamed("usage_count", "uses")


@query("SELECT DISTINCT json_object('prompt', question, 'completion', answer)::VARCHAR AS value FROM rag_user_feedback WHERE rating >= 0.6 AND question IS NOT NULL AND answer IS NOT NULL")
def training_pairs(spark, d):
    """Well rated pairs as lines of JSON."""
    f = table(spark, d, "rag_user_feedback", "question", "answer", "rating").where(F.col("rating") >= learning.POSITIVE)
    return learning.training_lines(f.select(F.col("question").alias("prompt"), F.col("answer").alias("completion"))).distinct()


@query("SELECT 'chunks' AS tbl, count(*)::BIGINT AS deleted, 0::BIGINT AS left FROM rag_chunks UNION ALL SELECT 'questions', count(*), 0 FROM rag_knowledge_questions UNION ALL SELECT 'documents', count(*), 0 FROM rag_documents")
def clear_all(spark, d):
    """The rows that clearing removes, and those left in the new snapshots."""
    held = {"chunks": table(spark, d, "rag_chunks", "id"), "questions": table(spark, d, "rag_knowledge_questions", "id"), "documents": table(spark, d, "rag_documents", "id")}
    return store.clear(held).join(store.clear({n: t.limit(0) for n, t in held.items()}).withColumnRenamed("deleted", "left"), "tbl")


@query(f"""WITH x AS (SELECT *, string_split(path, '/') AS parts FROM (SELECT DISTINCT file_id, repo, path, type, size FROM github_files))
 SELECT sha256(repo) AS id, repo, language, count(*)::BIGINT AS files FROM (SELECT repo, {language_case('path')} AS language FROM x WHERE type = 'file' AND coalesce(size, 0) <= 100000
 AND len(list_intersect(parts[1:-2], [{values(P.EXCLUDED)}])) = 0 AND NOT regexp_matches(parts[-1], '^(?:{'|'.join(g.replace('.', '[.]').replace('*', '.*') for g in P.EXCLUDED_FILES)})$')) GROUP BY ALL""")
def scan_summary(spark, d):
    """Files of each repository and language that a scan takes in, keyed by a stable id."""
    g = hosting.scan(table(spark, d, "github_files", "file_id", "repo", "path", "type", "size").distinct())
    return g.groupBy(F.sha2("repo", 256).alias("id"), "repo", "language").agg(F.count("*").alias("files"))


# --- text and scalars ----------------------------------------------------------------------------------------------


@query("SELECT document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id)) AS digest FROM (SELECT DISTINCT document_id, id, chunk_index, content FROM rag_chunks WHERE content IS NOT NULL) GROUP BY 1")
def context_string(spark, d):
    """The chunks of each document joined in order."""
    c = table(spark, d, "rag_chunks", "document_id", "id", "chunk_index", "content").where(F.col("content").isNotNull()).distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content"))), lambda x: x["content"]), "\n\n")
    return c.groupBy("document_id").agg(F.md5(joined).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 3000 THEN md5(left(text, 3000) || chr(10) || '... [truncated]') ELSE md5(text) END AS digest FROM documents WHERE text IS NOT NULL")
def truncate_marker(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", F.md5(T.truncated(F.col("text"))).alias("digest"))


@query("SELECT event_id, least(100, greatest(0, json_extract(props, '$.k')::DOUBLE)) AS k FROM events")
def json_extract(spark, d):
    """The number in the first JSON object of a text, held within 0 and 100."""
    j = F.get_json_object(T.first_json(F.col("props")), "$.k").cast("double")
    return table(spark, d, "events", "event_id", "props").select("event_id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), j)).alias("k"))


@query("SELECT id, 'User: ' || question || chr(10) || chr(10) || 'Assistant: ' || answer AS prompt FROM (SELECT DISTINCT id, question, answer FROM rag_user_feedback WHERE question IS NOT NULL AND answer IS NOT NULL)")
def conversation_prompt(spark, d):
    """Feedback as conversations of two turns, as one prompt each."""
    f = table(spark, d, "rag_user_feedback", "id", "question", "answer").where("question IS NOT NULL AND answer IS NOT NULL").distinct()
    turn = lambda role, body: F.struct(F.lit(role).alias("role"), F.col(body).alias("content"))
    return f.select("id", models.conversation(F.array(turn("user", "question"), turn("assistant", "answer"))).alias("prompt"))


@query("""SELECT file_id, split_part(repo, '/', 1) AS owner, split_part(repo, '/', 2) AS name FROM (SELECT DISTINCT file_id, repo FROM github_files)""")
def url_parse(spark, d):
    """Addresses in four spellings, made from each file's repository, read back."""
    g = table(spark, d, "github_files", "file_id", "repo").distinct()
    spelling = F.pmod("file_id", F.lit(4))
    url = F.when(spelling == 0, F.col("repo")).when(spelling == 1, F.concat(F.lit("git@github.com:"), "repo", F.lit(".git"))).when(spelling == 2, F.concat(F.lit("https://github.com/"), "repo", F.lit(".git"))).otherwise(F.concat(F.lit("github.com/"), "repo", F.lit("/tree/main")))
    r = g.select("file_id", P.repository(url).alias("r"))
    return r.select("file_id", "r.owner", F.col("r.repo").alias("name"))


_DIRS = values(P.EXCLUDED)


@query(f"""SELECT excluded, count(*)::BIGINT AS files FROM (SELECT len(list_intersect(string_split(path, '/')[1:-2], [{_DIRS}])) > 0 OR regexp_matches(string_split(path, '/')[-1], '^(.*\\.min\\.js|.*\\.min\\.css|package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml|poetry\\.lock|.*\\.pyc|.*\\.pyo|.*\\.so|.*\\.dll|.*\\.exe|.*\\.bin|.*\\.generated\\..*)$') AS excluded FROM github_files) GROUP BY 1""")
def path_filter(spark, d):
    return table(spark, d, "github_files", P.excluded(F.col("path")).alias("excluded")).groupBy("excluded").agg(F.count("*").alias("files"))


@query(f"SELECT DISTINCT file_id, {language_case('path')} AS language FROM github_files WHERE type = 'file'")
def detect_language(spark, d):
    return table(spark, d, "github_files", "file_id", "path", "type").where("type = 'file'").select("file_id", P.language(F.col("path")).alias("language")).distinct()


@query(f"SELECT {language_case('path')} AS language, count(*)::BIGINT AS files, sum(coalesce(size, 0))::BIGINT AS total_size FROM ({LATEST.format(table='github_files', key='file_id', order='scanned_at')}) WHERE type = 'file' GROUP BY 1")
def language_stats(spark, d):
    """Files and bytes by language, redelivered rows once."""
    g = table(spark, d, "github_files", "file_id", "path", "type", "size").where("type = 'file'").dropDuplicates(["file_id"])
    return g.groupBy(P.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("total_size"))


@query("""SELECT directory, CASE WHEN directory = '' THEN 0 ELSE len(string_split(directory, '/')) END::INT AS depth, count(*)::BIGINT AS files, sum(s)::BIGINT AS bytes FROM (SELECT unnest(list_transform(range(len(p)), lambda i: array_to_string(p[1:i], '/'))) AS directory, s FROM (SELECT string_split(path, '/') AS p, coalesce(size, 0) AS s FROM github_files WHERE type = 'file')) GROUP BY 1""")
def path_tree(spark, d):
    g = table(spark, d, "github_files", "path", "type", F.coalesce("size", F.lit(0)).alias("size")).where("type = 'file'")
    return code.path_tree(g, "path", "size")


@query("""SELECT repo, array_to_string(a[1:(CASE WHEN low = high THEN len(a) - 1 ELSE coalesce(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])[1] - 1, least(len(a), len(b))) END)], '/') AS prefix FROM (SELECT repo, low, high, string_split(low, '/') AS a, string_split(high, '/') AS b FROM (SELECT repo, min(path) AS low, max(path) AS high FROM github_files GROUP BY 1))""")
def common_prefix(spark, d):
    g = table(spark, d, "github_files", "repo", "path").groupBy("repo").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    return g.select("repo", P.common_prefix(F.col("low"), F.col("high")).alias("prefix"))


# --- analytics -----------------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT repo, {language_case('path')} AS language, coalesce(size, 0) AS size FROM github_files WHERE type = 'file'), l AS (SELECT repo, language, count(*) AS n, sum(size) AS s FROM f GROUP BY 1, 2)
 SELECT repo, sum(n)::BIGINT AS file_count, sum(s)::BIGINT AS total_size, first(language ORDER BY n DESC, language) AS dominant_language, string_agg(language || '=' || n, ',' ORDER BY language) AS languages FROM l GROUP BY 1""")
def group_summary(spark, d):
    """Files by repository, as a cluster's summary."""
    g = table(spark, d, "github_files", "repo", "path", "type", F.coalesce("size", F.lit(0)).alias("size")).where("type = 'file'").withColumn("language", P.language(F.col("path")))
    return code.group_summary(g, "repo", "path", "size", "language").drop("prefix")


@query("""SELECT repo, file_id FROM (SELECT repo, file_id, row_number() OVER (PARTITION BY repo ORDER BY size, file_id) - 1 AS r, count(*) OVER (PARTITION BY repo) AS n FROM (SELECT DISTINCT repo, file_id, coalesce(size, 0) AS size FROM github_files WHERE type = 'file'))
 WHERE n <= 3 OR (r >= greatest((n - 3) // 2, 0) AND r < greatest((n - 3) // 2, 0) + 3)""")
def representative_files(spark, d):
    g = table(spark, d, "github_files", "repo", "file_id", F.coalesce("size", F.lit(0)).alias("size"), "type").where("type = 'file'").drop("type").distinct()
    return code.representatives(g, "repo", "size", "file_id", 3).select("repo", "file_id")


@query("""SELECT severity, issue, count(*)::BIGINT AS n FROM (SELECT unnest(issues) AS issue, CASE WHEN complexity_score >= 40 THEN 'high' WHEN complexity_score >= 20 THEN 'medium' ELSE 'low' END AS severity FROM file_analysis) GROUP BY ALL""")
def severity_rollup(spark, d):
    """Issues of analysed files, flattened, by severity of the file's score."""
    s = F.when(F.col("complexity_score") >= 40, "high").when(F.col("complexity_score") >= 20, "medium").otherwise("low")
    f = table(spark, d, "file_analysis", "file_id", "issues", s.alias("severity"))
    return code.rollup(code.findings(f, "file_id", "issues", "severity"), "severity", "issue")


@query("SELECT DISTINCT file_id, complexity_score FROM file_analysis WHERE complexity_score IS NOT NULL ORDER BY complexity_score DESC, file_id LIMIT 20")
def top_complex(spark, d):
    f = table(spark, d, "file_analysis", "file_id", "complexity_score").where(F.col("complexity_score").isNotNull()).distinct()
    return code.top(f, "complexity_score", "file_id", 20)


@query()
def complexity_scores(spark, d):
    """Cyclomatic complexity, lines, tokens and the weighted score of every analysed file."""
    f = table(spark, d, "file_analysis", "file_id", "path", "content", "size").dropDuplicates(["file_id"])
    return code.analyse(f, "file_id", "content", P.language(F.col("path")), F.col("size"))


@query("""SELECT term, count(*)::BIGINT AS df, sum(n)::BIGINT AS tf FROM (SELECT file_id, term, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*')) AS term FROM (SELECT DISTINCT file_id, content FROM file_analysis)) GROUP BY ALL) GROUP BY 1 ORDER BY df DESC, tf DESC, term LIMIT 50""")
def tfidf_top_terms(spark, d):
    return code.term_statistics(table(spark, d, "file_analysis", "file_id", "content").distinct(), "file_id", "content", 50)


@query()
def tfidf_kmeans(spark, d):
    return code.cluster(table(spark, d, "file_analysis", "file_id", "content").dropDuplicates(["file_id"]), "file_id", "content")


@query("""SELECT event_id, model, tokens_in, tokens_out, round(CASE model WHEN 'small' THEN tokens_in / 1000::DOUBLE * 0.0005::DOUBLE + tokens_out / 1000::DOUBLE * 0.0015::DOUBLE WHEN 'large' THEN tokens_in / 1000::DOUBLE * 0.01::DOUBLE + tokens_out / 1000::DOUBLE * 0.03::DOUBLE ELSE 0 END, 9) AS cost FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, (event_id % 1000)::BIGINT AS tokens_in, (user_id % 500)::BIGINT AS tokens_out FROM events)""")
def token_cost(spark, d):
    """Events stand for calls of models."""
    m = F.when(F.col("event_id") % 3 == 0, "small").when(F.col("event_id") % 3 == 1, "large").otherwise("other")
    calls = table(spark, d, "events", "event_id", m.alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("user_id") % 500).alias("tokens_out"))
    return models.cost(calls, spark.createDataFrame(PRICES, "model string, price_in double, price_out double")).select("event_id", "model", "tokens_in", "tokens_out", "cost")


@query("SELECT DISTINCT id, CASE WHEN contains(lower(question), 'cache') THEN 'first: ' || length(question) ELSE 'second: ' || lower(question) END AS response, CASE WHEN contains(lower(question), 'cache') THEN 0 ELSE 1 END AS provider FROM rag_user_feedback WHERE question IS NOT NULL")
def fallback_coalesce(spark, d):
    """Two stated providers in turn: the first fails on questions without a word, the second answers those."""
    def first(prompt: str) -> str:
        if "cache" not in prompt.lower():
            raise TimeoutError
        return f"first: {len(prompt)}"

    asked = table(spark, d, "rag_user_feedback", "id", "question").where("question IS NOT NULL").distinct()
    return models.generate(asked, "question", [first, lambda prompt: f"second: {prompt.lower()}"]).select("id", "response", "provider")


@query()
def hashed_embeddings(spark, d):
    """Every document's vector by the offline embedder."""
    return models.embed(table(spark, d, "documents", "doc_id", "text"), "text", models.hashing_embedder()).select("doc_id", "embedding")


@query("SELECT encoding, count(*)::BIGINT AS files FROM (SELECT DISTINCT file_id, encoding FROM github_files WHERE type = 'file' AND coalesce(size, 0) <= 100000) GROUP BY 1")
def hosted_decoded(spark, d):
    """Files within the scan's size, decoded, by their encoding."""
    g = table(spark, d, "github_files", "file_id", "type", "size", "content", "encoding").where((F.col("type") == "file") & (F.coalesce("size", F.lit(0)) <= 100_000)).dropDuplicates(["file_id"])
    return hosting.decoded(g).groupBy("encoding").agg(F.count("*").alias("files"))


# --- streams -------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return streams.tumbling(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT w::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n FROM (SELECT unnest([0, 1, 2, 3]) AS k, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * unnest([0, 1, 2, 3])) AS w, event_type FROM events) GROUP BY 1, 2")
def events_sliding(spark, d):
    return streams.sliding(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_session(spark, d):
    s = streams.sessions(table(spark, d, "events"))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", "total")


@query("SELECT DISTINCT user_id, event_type, ts FROM events")
def events_dedup(spark, d):
    return streams.distinct(table(spark, d, "events", "user_id", "event_type", "ts"), "user_id", "event_type", "ts").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))