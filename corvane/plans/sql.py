"""Parts of the checking SQL that several queries share."""

from __future__ import annotations

from collections.abc import Iterable

from corvane.functions.paths import LANGUAGES, STRATEGIES
from corvane.functions.text import STOP_WORDS


def values(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


BM25 = """SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM
 (SELECT doc_id, n, term, count(*) AS tf, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+') AS w FROM documents)) WHERE term IN ('cache','index','partition') GROUP BY doc_id, n, term),
 (SELECT count(*) AS docs, avg(len(regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+'))) AS mean FROM documents) GROUP BY doc_id"""

RRF = f"""WITH v AS (SELECT doc_id, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank_v FROM (SELECT e.vec_id AS doc_id, COSINE AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 20)),
 b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank_b FROM (SELECT doc_id, score FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 20)),
 f AS (SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, rank_v, rank_b, round(coalesce(ALPHA::DOUBLE / (60 + rank_v), 0) + coalesce((1 - ALPHA)::DOUBLE / (60 + rank_b), 0), 9) AS combined_score FROM v FULL JOIN b ON v.doc_id = b.doc_id)
 SELECT *, row_number() OVER (ORDER BY combined_score DESC, rank_v NULLS LAST, rank_b NULLS LAST, doc_id) AS rank FROM f ORDER BY rank LIMIT 10"""

_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[\\pL\\pM\\pN]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_A, _B = _GRAMS.format("question"), _GRAMS.format("'Which port does the cache use?'")
TRIGRAMS = f"len(list_intersect({_A}, {_B}))::DOUBLE / len(list_distinct(list_concat({_A}, {_B})))"

KEYWORDS = f"list_filter(regexp_extract_all(lower(expected_answer), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{3,}}'), lambda w: w NOT IN ({values(STOP_WORDS)}))"

LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) AS __r FROM {table}) WHERE __r = 1"

_EXT = "lower(regexp_extract(string_split({}, '/')[-1], '^.+\\.([^.]+)$', 1))"


def language_case(path: str) -> str:
    whens = " ".join(f"WHEN {_EXT.format(path)} IN ({values(exts.split())}) THEN '{lang}'" for lang, exts in LANGUAGES.items())
    return f"CASE {whens} ELSE 'Unknown' END"


STRATEGY = "CASE " + " ".join(f"WHEN {_EXT.format('''coalesce(source, '')''')} IN ({values(e.split())}) THEN '{s}'" for s, e in STRATEGIES.items()) + " ELSE 'fixed' END"
