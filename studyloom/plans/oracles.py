"""DuckDB SQL with the result of each registered query."""

from __future__ import annotations

from studyloom.functions.text import WHITE_SPACE
from studyloom.operators.qa import TEMPLATES
from studyloom.plans.flows import DONE, NO_PAIRS, NO_TEXT

#: Lines of a document on a page of its PDF file.
PAGE_LINES = 30

_WS = "[" + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in WHITE_SPACE) + "]+"
_LIGHT = rf"trim(regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), '[^\x00-\x7F]+', ' ', 'g'))"
_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

_FULL = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), '--- PAGE \p{{Nd}}+ ---', '', 'g'), 'http[^ ]+|www[^ ]+', '', 'g'), '[^ ]+@[^ ]+', '', 'g'), '[^a-zA-Z0-9 .,!?''"\-:]', '', 'g'), ' +', ' ', 'g'))"""


def _chunks(clean: str) -> str:
    return f"""
cleaned AS (SELECT doc_id, source, {clean} AS t FROM documents),
split AS (SELECT doc_id, source, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM cleaned),
starts AS (SELECT doc_id, source, w, unnest(range(0, len(w), 400)) AS st FROM split WHERE len(w) > 0),
chunks AS (SELECT doc_id, source, (st // 400 + 1)::INT AS chunk_id, array_to_string(w[st+1:st+500], ' ') AS text,
  array_to_string(w[st+1:least(st+8, st+500)], ' ') AS title, len(w[st+1:st+500])::INT AS word_count FROM starts)"""


_CHUNKS = _chunks(_LIGHT)

_PAIR_STEPS = (
    r""",
topics AS (SELECT *, regexp_extract_all(text, '[A-Za-z0-9]+') AS tw FROM chunks),
topics2 AS (SELECT *, CASE WHEN len(tw) > 0 THEN array_to_string(tw[1:6], ' ') ELSE 'this topic' END AS topic FROM topics),
sents AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 40) AS s0 FROM topics2),
lowered AS (SELECT *, list_transform(s0, lambda x: lower(x)) AS lk FROM sents),
uniq AS (SELECT *, list_filter(s0, lambda x, i: list_position(lk, lower(x)) = i)[1:3] AS s1 FROM lowered),
answered AS (SELECT *, CASE WHEN len(s1) > 0 THEN s1 ELSE [trim(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240))] END AS s FROM uniq),
templates(k, difficulty, pre, post) AS (VALUES """
    + ", ".join(f"({k}, '{d}', '{a}', '{b}')" for k, (d, a, b) in enumerate(TEMPLATES))
    + """),
pairs AS (SELECT doc_id, source, chunk_id, substring(text, 1, 1000) AS source_chunk, pre || topic || post AS question, s[least(k + 1, len(s))] AS answer, difficulty, topic FROM answered, templates)"""
)

_PAIRS, _FULL_PAIRS = _CHUNKS + _PAIR_STEPS, _chunks(_FULL) + _PAIR_STEPS
_NUMBERED = f"{_PAIRS}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id, CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS number FROM pairs)"
_NEW = f"""{_NUMBERED}, have AS (SELECT DISTINCT source, question FROM numbered WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
first AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY source, question ORDER BY number) = 1),
fresh AS (SELECT * FROM first f WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.source = f.source AND h.question = f.question))"""
_UNASKED = "d AS (SELECT doc_id AS id, source || '/' || lang AS instance_id, md5(text) AS file_path FROM documents), need AS (SELECT instance_id, file_path, min(id) AS id FROM d WHERE instance_id NOT IN (SELECT instance_id FROM d WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY ALL)"
_ASKED = f"{_CHUNKS}, asked AS (SELECT doc_id, chunk_id, text, substring(text, 1, n) || '?' AS question, substring(text, n + 1, 30) AS answer, 'easy' AS difficulty, 'model' AS topic, n FROM chunks, (VALUES (20), (10)) v(n) WHERE length(text) >= 400 AND length(text) % 5 <> 0)"
_DONE = "'" + DONE.replace("%d", "' || coalesce(q, 0) || '", 1).replace("%d", "' || coalesce(c.n, 0) || '", 1) + "'"

_STATE = """
RECURSIVE steps(k, i, e) AS (SELECT 0, 1::BIGINT, 2.5::DOUBLE UNION ALL SELECT k + 1, trunc(i * e)::BIGINT, e + 0.1::DOUBLE FROM steps WHERE k < 13),
ev AS (SELECT user_id AS card_id, ts, event_id, event_type IN ('purchase', 'click') AS ok FROM events),
isl AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY card_id ORDER BY ts, event_id) AS g FROM ev),
lastg AS (SELECT card_id, max(g) AS g, max(ts) AS seen FROM isl GROUP BY card_id),
streak AS (SELECT l.card_id, l.seen, count(*) FILTER (WHERE i.ok) AS k FROM lastg l JOIN isl i ON i.card_id = l.card_id AND i.g = l.g GROUP BY ALL),
state AS (SELECT card_id, s.k::INT AS repetitions, st.i AS interval, st.e AS ease_factor, seen AS last_reviewed, seen + to_days(st.i::INT) AS next_review FROM streak s JOIN steps st ON st.k = s.k)"""

_ANSWERS = "answers AS (SELECT l.doc_id, d.source AS topic, d.lang, l.quality = 1 AS correct, l.quality AS chosen, l.toxic FROM labels l JOIN documents d USING (doc_id))"
_TOPICS = _ANSWERS + ", topics AS (SELECT topic, count(*) AS total_questions, 100 * avg(correct::INT::DOUBLE) AS accuracy FROM answers GROUP BY topic)"
_STATE_COLUMNS = "SELECT card_id, repetitions, interval, ease_factor, last_reviewed, next_review FROM state"

_NEAREST = """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS x FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(x, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id)::INT AS rank FROM d QUALIFY rank <= 5"""

SQL: dict[str, str] = {
    "clean_light": f"SELECT doc_id, {_LIGHT} AS text FROM documents",
    "clean_full": f"SELECT doc_id, {_FULL} AS text FROM documents",
    "chunk_documents": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, text, title, word_count FROM chunks",
    "chunk_stats": f"WITH {_CHUNKS}, n AS (SELECT doc_id, count(*) AS n_chunks, sum(word_count)::BIGINT AS chunk_words FROM chunks GROUP BY doc_id) SELECT d.doc_id, length(d.text)::INT AS raw_chars, length({_LIGHT.replace('text', 'd.text')})::INT AS cleaned_chars, n_chunks, chunk_words FROM documents d JOIN n USING (doc_id)",
    "fallback_qa": f"WITH {_PAIRS} SELECT doc_id, chunk_id, source_chunk, question, answer, difficulty, topic FROM pairs",
    "qa_by_difficulty": f"WITH {_PAIRS} SELECT difficulty, count(*) AS n FROM pairs GROUP BY difficulty",
    "qa_by_topic": f"WITH {_PAIRS} SELECT topic, count(*) AS n FROM pairs GROUP BY topic",
    "topic_questions": f"WITH {_PAIRS} SELECT topic, question, count(*) AS n FROM pairs GROUP BY ALL",
    "hard_questions": f"WITH {_PAIRS} SELECT doc_id, chunk_id, question FROM pairs WHERE difficulty = 'hard'",
    "preview_pairs": f"WITH {_PAIRS} SELECT doc_id, chunk_id, upper(difficulty) AS label, question FROM pairs ORDER BY doc_id, chunk_id, difficulty LIMIT 5",
    "batch_metadata": f"""WITH {_chunks(_FULL)}, n AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id)
SELECT d.doc_id AS path, CASE WHEN n_chars < 50 THEN 'too short' END AS error, CASE WHEN n_chars >= 50 THEN length(text)::INT END AS file_size_chars, CASE WHEN n_chars >= 50 THEN length({_FULL})::INT END AS cleaned_size_chars,
  CASE WHEN n_chars >= 50 THEN coalesce(c, 0) ELSE 0 END AS chunk_count, CASE WHEN n_chars >= 50 THEN 3 * coalesce(c, 0) ELSE 0 END AS qa_count, 'llama3:8b' AS model, '2024-01-15T00:00:00' AS generated_at FROM documents d LEFT JOIN n USING (doc_id)""",
    "upload_stats": f"WITH {_PAIRS} SELECT doc_id, count(*) AS qa_pairs, count(DISTINCT chunk_id) AS chunks FROM pairs GROUP BY doc_id",
    "weak_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, substring(text, 1, 1500) AS text, md5(text) AS text_md5 FROM chunks WHERE length(trim(text)) >= 200",
    "embedding_inputs": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, substring(text, 1, 2000) AS input FROM chunks WHERE chunk_id <= 5",
    "embed_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, least(length(text), 2000)::DOUBLE AS x1, (length(substring(text, 1, 2000)) - length(replace(substring(text, 1, 2000), ' ', '')))::DOUBLE AS x2 FROM chunks",
    "flashcards_new": f"WITH {_NEW} SELECT source AS instance_id, number AS id, question, answer, 2.5::DOUBLE AS ease_factor, 1::BIGINT AS interval, 0::INT AS repetitions FROM fresh",
    "upload_flow": f"""WITH {_NEW}, c AS (SELECT doc_id, count(*) AS n FROM fresh GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS q, count(DISTINCT chunk_id) AS k FROM pairs GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(trim(regexp_replace(text, '{_WS}', ' ', 'g')), '') = '' AS blank FROM documents)
SELECT doc_id AS id, coalesce(q, 0) AS qa_pairs, coalesce(c.n, 0) AS flashcards, coalesce(k, 0) AS chunks, CASE WHEN blank THEN '{NO_TEXT}' ELSE {_DONE} END AS message, CASE WHEN NOT blank AND q IS NULL THEN '{NO_PAIRS}' END AS warning
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "distinct_documents": "SELECT source AS instance_id, md5(text) AS file_path, min(doc_id) AS id FROM documents GROUP BY ALL",
    "bootstrap_documents": f"WITH {_UNASKED} SELECT instance_id, file_path, id FROM need",
    "bootstrap_questions": f"WITH {_PAIRS}, {_UNASKED} SELECT instance_id, id, chunk_id, question, answer, difficulty, topic FROM need JOIN pairs ON doc_id = id",
    "unique_questions": f"WITH {_PAIRS} SELECT source AS instance_id, count(*) AS questions, count(DISTINCT md5(question)) AS unique_questions FROM pairs GROUP BY source",
    "review_state": f"WITH {_STATE} {_STATE_COLUMNS}",
    "review_stream": f"WITH {_STATE} {_STATE_COLUMNS}",
    "late_review_stream": f"WITH {_STATE} {_STATE_COLUMNS}",
    "due_stream": f"""WITH {_STATE},
each AS (SELECT card_id, ts, lead(ts) OVER (PARTITION BY card_id ORDER BY ts, event_id) AS after, count(*) FILTER (WHERE ok) OVER (PARTITION BY card_id, g ORDER BY ts, event_id) AS k FROM isl WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM ev)),
due AS (SELECT card_id, ts AS last_reviewed, ts + to_days(st.i::INT) AS next_review, after FROM each JOIN steps st ON st.k = each.k)
SELECT card_id, last_reviewed, next_review FROM due WHERE next_review <= coalesce(after, (SELECT date_trunc('millisecond', max(ts)) FROM ev))""",
    "card_stream": f"WITH {_NEW} SELECT source AS instance_id, number AS id, question, answer, 2.5::DOUBLE AS ease_factor, 1::BIGINT AS interval, 0::INT AS repetitions FROM fresh",
    "due_cards": f"WITH {_STATE} SELECT card_id, next_review FROM state WHERE next_review <= {_AS_OF}",
    "instance_summary": f"""WITH {_STATE}, names AS (SELECT DISTINCT source AS id FROM documents), n AS (SELECT source AS id, count(*) AS c FROM documents GROUP BY source),
due AS (SELECT 'src' || (card_id % 20) AS id, count(*) AS c FROM state WHERE next_review <= {_AS_OF} GROUP BY 1)
SELECT names.id, coalesce(n.c, 0) AS document_count, coalesce(due.c, 0) AS flashcards_due FROM names LEFT JOIN n USING (id) LEFT JOIN due USING (id)""",
    "instance_page": "SELECT * FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 100",
    "instance_lookup": "SELECT * FROM customer WHERE c_custkey = 7",
    "instance_documents": "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src0'",
    "instance_patch": "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey AS id, CASE WHEN n > 10 THEN 'customer ' || c_custkey ELSE c_name END AS c_name, c_nationkey, c_acctbal, CASE WHEN n > 15 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN n ON o_custkey = c_custkey",
    "instance_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "instance_cascade": """WITH gone AS (SELECT c_custkey AS g FROM customer WHERE c_acctbal < 0),
a AS (SELECT 'instances' AS kept_in, c_custkey AS id, c_custkey AS instance_id FROM customer UNION ALL SELECT 'documents', o_orderkey, o_custkey FROM orders
  UNION ALL SELECT 'qa_pairs', 10 * l_orderkey + l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'flashcards', event_id, user_id FROM events)
SELECT * FROM a WHERE instance_id NOT IN (SELECT g FROM gone)""",
    "numbered_documents": "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS id FROM documents",
    "validated_inputs": "SELECT p_partkey, p_name AS name, '#' || substring(md5(p_brand), 1, 6 + (p_size % 2)::INT) AS color, p_size % 2 = 0 AS valid FROM part",
    "vector_topk": _NEAREST,
    "vector_topk_pivots": _NEAREST,
    "topic_accuracy": f"WITH {_TOPICS} SELECT topic, total_questions, round(accuracy, 6) AS accuracy FROM topics",
    "avg_accuracy": f"WITH {_TOPICS}, weak AS (SELECT topic FROM answers WHERE toxic = 1 GROUP BY topic HAVING count(*) >= 2) SELECT floor(avg(accuracy) + 0.5)::BIGINT AS mean_accuracy, sum(total_questions)::BIGINT AS total_questions, count(*) AS topics, (SELECT count(*) FROM weak) AS weak_areas FROM topics",
    "best_topic": f"WITH {_TOPICS} SELECT topic AS best_topic, round(accuracy, 6) AS accuracy FROM topics ORDER BY round(accuracy, 6) DESC, topic LIMIT 1",
    "weak_topics": f"WITH {_TOPICS} SELECT topic, total_questions, round(accuracy, 6) AS accuracy FROM topics WHERE topic IN (SELECT topic FROM answers WHERE toxic = 1 GROUP BY topic HAVING count(*) >= 2)",
    "test_score": f"WITH {_ANSWERS} SELECT topic, count(*) FILTER (WHERE chosen = 1) AS score, count(*) AS total, count(*) FILTER (WHERE chosen IS NULL) AS skipped, floor(100.0 * count(*) FILTER (WHERE chosen = 1) / count(*) + 0.5)::BIGINT AS percent FROM answers GROUP BY topic",
    "accuracy_series": "SELECT strftime(ts, '%Y-%m-%d') AS date, round(100 * avg((event_type IN ('purchase', 'click'))::INT::DOUBLE), 6) AS accuracy FROM events GROUP BY 1",
    "progress": "SELECT conv_id, turn, row_number() OVER w::INT AS position, count(*) OVER (PARTITION BY conv_id) AS of, floor(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY conv_id) + 0.5)::BIGINT AS percent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"),
    "batch_summary": f"WITH {_FULL_PAIRS}, c AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id), q AS (SELECT doc_id, count(*) AS q FROM pairs GROUP BY doc_id), r AS (SELECT n_chars < 100 AS bad, c, q FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)) SELECT count(*) AS total_files, count(*) FILTER (WHERE NOT bad) AS successful, count(*) FILTER (WHERE bad) AS failed, coalesce(sum(q) FILTER (WHERE NOT bad), 0)::BIGINT AS total_qa, coalesce(sum(c) FILTER (WHERE NOT bad), 0)::BIGINT AS total_chunks FROM r",
    "batch_totals": f"WITH {_FULL_PAIRS}, c AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id), q AS (SELECT doc_id, count(*) AS q FROM pairs GROUP BY doc_id), r AS (SELECT n_chars < 100 AS bad, c, q FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)) SELECT count(*) AS total_files, count(*) FILTER (WHERE NOT bad) AS successful, count(*) FILTER (WHERE bad) AS failed, coalesce(sum(q) FILTER (WHERE NOT bad), 0)::BIGINT AS total_qa, coalesce(sum(c) FILTER (WHERE NOT bad), 0)::BIGINT AS total_chunks FROM r",
    "output_shapes": "SELECT event_id, CASE event_type WHEN 'view' THEN 'items' WHEN 'click' THEN 'wrong shape' WHEN 'signup' THEN 'wrong shape' WHEN 'purchase' THEN 'malformed' ELSE 'absent' END AS shape, CASE WHEN event_type = 'view' THEN 2 ELSE 0 END::INT AS n_items FROM events",
    "question_totals": f"WITH {_PAIRS} SELECT source AS instance_id, topic, difficulty, grouping(source, topic, difficulty)::BIGINT AS level, count(*) AS n FROM pairs GROUP BY GROUPING SETS ((source, topic, difficulty), (source, difficulty), (source), (difficulty), ())",
    "upload_with_client": f"""WITH {_PAIRS}, mixed AS (SELECT doc_id, source, chunk_id, place, substring(text, 1, n) || '?' AS question, CASE WHEN place = 2 THEN 'again' ELSE substring(text, n + 1, 30) END AS answer FROM chunks, (VALUES (0, 20), (1, 10), (2, 20), (3, 5)) v(place, n) WHERE length(text) >= 400
UNION ALL SELECT doc_id, source, chunk_id, CASE difficulty WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, p.question, p.answer FROM pairs p JOIN (SELECT doc_id, chunk_id FROM chunks WHERE length(text) < 400) c USING (doc_id, chunk_id)),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id, place) AS id FROM mixed)
SELECT source AS instance_id, id, question, answer FROM numbered QUALIFY row_number() OVER (PARTITION BY source, question ORDER BY id) = 1""",
    "extract_json": "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS question, CASE WHEN event_type <> 'error' THEN props END AS answer, CASE WHEN event_type <> 'error' THEN CASE WHEN value > 50 THEN 'hard' ELSE 'easy' END END AS difficulty, CASE WHEN event_type <> 'error' THEN user_id::VARCHAR END AS topic FROM events",
    "generate_with_fallback": f"""WITH {_PAIRS} SELECT doc_id, chunk_id, 'What is it?' AS question, substring(text, 1, 20) AS answer, 'easy' AS difficulty, 'model' AS topic, false AS rejected FROM chunks WHERE word_count >= 100
UNION ALL SELECT doc_id, chunk_id, p.question, p.answer, p.difficulty, p.topic, false FROM pairs p JOIN chunks c USING (doc_id, chunk_id) WHERE c.word_count < 100""",
    "ask_model": f"WITH {_ASKED} SELECT doc_id, chunk_id, question, answer, difficulty, topic FROM asked",
    "compare_models": f"WITH {_ASKED} " + " UNION ALL ".join(f"SELECT '{name}' AS model, count(*) AS n_questions, (SELECT question FROM asked WHERE length(text) >= {least} ORDER BY doc_id, chunk_id, n DESC LIMIT 1) AS sample FROM asked WHERE length(text) >= {least}" for name, least in (("all", 0), ("long", 2000))),
    "export_markdown": f"WITH {_NUMBERED} SELECT number, '## ' || number || '. ' || question || chr(10) || chr(10) || '**Answer:** ' || answer || chr(10) || chr(10) || '**Difficulty:** ' || difficulty || ' | **Topic:** ' || topic || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS section FROM numbered",
    "export_markdown_file": f"WITH {_NUMBERED}, t AS (SELECT unnest(string_split(x, chr(10))) AS line FROM (SELECT regexp_replace('## ' || number || '. ' || question || chr(10) || chr(10) || '**Answer:** ' || answer || chr(10) || chr(10) || '**Difficulty:** ' || difficulty || ' | **Topic:** ' || topic || chr(10) || chr(10) || '---' || chr(10) || chr(10), chr(10) || '$', '') AS x FROM numbered UNION ALL SELECT '# Generated Q&A Pairs' || chr(10))) SELECT line, count(*) AS n FROM t GROUP BY line",
    "export_csv_rows": f"WITH {_PAIRS} SELECT question, answer, difficulty, topic FROM pairs",
    "export_json": f"""WITH {_FULL_PAIRS}, c AS (SELECT doc_id, count(*) AS c, sum(word_count)::BIGINT AS w FROM chunks GROUP BY doc_id), q AS (SELECT doc_id, count(*) AS q FROM pairs GROUP BY doc_id)
SELECT doc_id AS path, coalesce(c, 0) AS chunk_count, 'llama3:8b' AS model, coalesce(c, 0)::INT AS chunks, coalesce(w, 0) AS words, coalesce(q, 0)::INT AS pairs FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "display_formats": "SELECT doc_id, printf('%.1f KB', round(strlen(text) / 1024.0, 1)) AS size, ((n_chars % 6000) // 60)::VARCHAR || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') AS timer, upper(lang) AS label, source || '__1.txt' AS file_name FROM documents",
    "extract_text": "SELECT doc_id, md5(text) AS text_md5, NULL::VARCHAR AS error FROM documents",
    "join_pages": "SELECT conv_id, string_agg(chr(10) || chr(10) || '--- PAGE ' || (turn + 1) || ' ---' || chr(10) || chr(10) || coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "parse_files": """SELECT doc_id, 'by kind' AS how, md5(CASE WHEN doc_id % 4 < 2 THEN text ELSE '' END) AS text_md5, doc_id % 4 >= 2 AS failed FROM documents
UNION ALL SELECT doc_id, 'strict', md5(CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 1 THEN '' WHEN doc_id % 4 = 2 THEN 'PK' ELSE text END), doc_id % 3 = 0 OR doc_id % 4 = 1 FROM documents""",
    "read_pdfs": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(0, len(w), {PAGE_LINES}), lambda k: chr(10) || chr(10) || '--- PAGE ' || (k // {PAGE_LINES} + 1) || ' ---' || chr(10) || chr(10) || array_to_string(w[k + 1:k + {PAGE_LINES}], chr(10)) || chr(10))) AS page, unnest(range(0, len(w), {PAGE_LINES})) AS k FROM l)
SELECT doc_id, md5(string_agg(page, '' ORDER BY k)) AS text_md5, NULL::VARCHAR AS error FROM p GROUP BY doc_id""",
    "read_files": "SELECT regexp_replace(n_name, '[^A-Za-z0-9._-]', '_', 'g') || '.txt' AS file, strlen(n_name || chr(10) || n_regionkey)::BIGINT AS n_bytes, n_name || chr(10) || n_regionkey AS text, NULL::VARCHAR AS error FROM nation",
    "followed_files": "SELECT regexp_replace(n_name, '[^A-Za-z0-9._-]', '_', 'g') || CASE WHEN n_nationkey % 5 = 0 THEN '.bin' ELSE '.txt' END AS file, strlen(n_name || chr(10) || n_regionkey)::BIGINT AS n_bytes, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name || chr(10) || n_regionkey END AS text, CASE WHEN n_nationkey % 5 = 0 THEN 'unsupported format: bin' END AS error FROM nation",
    "stored_uploads": "SELECT source AS instance_id, lang || '_' || (doc_id % 7) || '.txt' AS file_name, arg_max(md5(text), doc_id) AS content_md5 FROM documents GROUP BY ALL",
    "stored_changes": """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), gone AS (SELECT c_custkey AS g FROM customer WHERE c_acctbal < 0),
a AS (SELECT 'instances' AS kept_in, c_custkey AS id, c_custkey AS instance_id, concat_ws('/', CASE WHEN n > 10 THEN 'customer ' || c_custkey ELSE c_name END, CASE WHEN n > 15 THEN NULL ELSE c_mktsegment END) AS label FROM customer LEFT JOIN n ON o_custkey = c_custkey
  UNION ALL SELECT 'documents', o_orderkey, o_custkey, 'o_orderkey ' || o_orderkey FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT 'qa_pairs', 10 * l_orderkey + l_linenumber, o_custkey, 'l_partkey ' || l_partkey || '/l_suppkey ' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'flashcards', event_id, user_id, event_type FROM events)
SELECT * FROM a WHERE instance_id NOT IN (SELECT g FROM gone)""",
    "order_pages": "SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page, (row_number() OVER (ORDER BY o_orderkey) - 1) % 100 AS place FROM orders",
    "stored_cards": "SELECT 'instances' AS kept_in, c_custkey AS id, c_name AS name, c_custkey AS instance_id FROM customer UNION ALL SELECT 'documents', o_orderkey, 'u/' || (o_custkey % 20), o_custkey % 20 FROM orders",
}
