"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

P1_FOUND = r"""WITH d AS (SELECT id, any_value(content) AS content FROM rag_documents GROUP BY id),
 c AS (SELECT DISTINCT ON (id) id, document_id, content, start_char, end_char, chunk_index, strategy FROM rag_chunks),
 j AS (SELECT c.*, d.content AS doc, l.max_chars, l.overlap_chars, coalesce(NOT (start_char IS NULL OR end_char IS NULL OR d.content IS NULL OR c.content IS NULL OR substring(d.content, start_char + 1, end_char - start_char) <> c.content), FALSE) AS ok FROM c LEFT JOIN d ON d.id = c.document_id LEFT JOIN chunk_limits l ON l.strategy = c.strategy),
 w AS (SELECT *, lag(end_char) OVER o AS pe, lag(ok) OVER o AS pok, row_number() OVER o AS i, lead(id) OVER o AS nxt FROM j WINDOW o AS (PARTITION BY document_id ORDER BY chunk_index, id)),
 x AS (SELECT *, CASE WHEN i = 1 THEN substring(doc, 1, start_char) WHEN pok AND start_char > pe THEN substring(doc, pe + 1, start_char - pe) ELSE '' END AS ahead, CASE WHEN nxt IS NULL THEN substring(doc, end_char + 1) ELSE '' END AS behind FROM w WHERE ok)
 SELECT id AS chunk_id, 'oversize' AS fault FROM j WHERE length(content) > max_chars
 UNION ALL SELECT id, 'offset' FROM j WHERE NOT ok
 UNION ALL SELECT id, 'gap' FROM x WHERE regexp_matches(ahead, '[^\s\x{A0}]') OR regexp_matches(behind, '[^\s\x{A0}]')
 UNION ALL SELECT id, 'overlap' FROM x WHERE i > 1 AND pok AND NOT regexp_matches(ahead, '[^\s\x{A0}]') AND (2 * (pe - start_char) < overlap_chars OR pe - start_char > overlap_chars)
 UNION ALL SELECT id, 'midword' FROM x WHERE end_char > 0 AND end_char < length(doc) AND regexp_matches(substring(doc, end_char, 1), '[\p{L}\p{N}]') AND regexp_matches(substring(doc, end_char + 1, 1), '[\p{L}\p{N}]') AND regexp_matches(substring(doc, (start_char + (end_char - start_char) // 2 + 1)::BIGINT, (end_char - start_char - (end_char - start_char) // 2)::BIGINT), '[\s\x{A0}]')"""

P2_FOUND = r"""WITH r AS (SELECT DISTINCT 'rag_documents' AS tbl, id, content FROM rag_documents WHERE content IS NOT NULL UNION SELECT DISTINCT 'rag_chunks', id, content FROM rag_chunks WHERE content IS NOT NULL),
 w AS (SELECT tbl, id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM r),
 g AS (SELECT DISTINCT tbl, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 30),
 n AS (SELECT tbl, id, count(*) AS n FROM g GROUP BY ALL),
 p AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS shared FROM g a JOIN g b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY ALL)
 SELECT p.tbl, id_a, id_b FROM p JOIN n x ON x.tbl = p.tbl AND x.id = id_a JOIN n y ON y.tbl = p.tbl AND y.id = id_b WHERE shared / (x.n + y.n - shared) >= 0.6"""

_P2_GRAMS = r"""r AS (SELECT DISTINCT 'rag_documents' AS tbl, id, coalesce(content, '') AS content FROM rag_documents UNION SELECT DISTINCT 'rag_chunks', id, coalesce(content, '') FROM rag_chunks),
 w AS (SELECT tbl, id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM r),
 g AS (SELECT DISTINCT tbl, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 30),
 c AS (SELECT tbl, id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS class FROM g GROUP BY ALL)"""

P2_LINKS = f"""WITH {_P2_GRAMS}, h AS (SELECT tbl, min(id) AS id, any_value(n) AS n FROM c GROUP BY tbl, class), k AS (SELECT g.* FROM g JOIN h USING (tbl, id)),
 p AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS shared FROM k a JOIN k b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY ALL)
 SELECT p.tbl, id_a, id_b, round(shared / (x.n + y.n - shared), 6) AS similarity FROM p JOIN h x ON x.tbl = p.tbl AND x.id = id_a JOIN h y ON y.tbl = p.tbl AND y.id = id_b WHERE shared / (x.n + y.n - shared) >= 0.6"""

P2_MEMBERS = f"""WITH {_P2_GRAMS}, m AS (SELECT tbl, id, class FROM c UNION ALL SELECT tbl, id, 'words ' || array_to_string(w, ' ') FROM w WHERE len(w) < 30)
 SELECT tbl, id, min(id) OVER (PARTITION BY tbl, class) AS representative FROM m"""

P1_COVER = r"SELECT id AS document_id, TRUE AS whole FROM (SELECT id, any_value(content) AS content FROM rag_documents GROUP BY 1) WHERE regexp_matches(content, '[^\s\pZ]')"

P7_COVER = "SELECT pack_name, doc_id, TRUE AS whole FROM pack_capacities, documents WHERE length(text) > 0"

P8_CAPS = "SELECT lower(replace(source, '_', '-')) AS source, round(target_share, 6) AS target_share, max_repeats::BIGINT AS max_repeats, TRUE AS kept FROM mix_targets"

P9_COVER = r"SELECT doc_id, length(regexp_replace(text, '[\s\pZ]', '', 'g'))::BIGINT AS chars FROM documents WHERE regexp_matches(text, '[^\s\pZ]')"
