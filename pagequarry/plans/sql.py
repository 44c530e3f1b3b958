"""SQL that gives the same rows as the registered queries, for engines that read the same tables."""

from __future__ import annotations

from pagequarry.functions.text import ACCENTED, PLAIN, query_tokens

SINGLE, BOTH, MARKED, NEEDLE = "bearing", "corrosion resistant", "après", "corrosion-resistant"

# a page whose OCR was unavailable has an empty layout, every other stored layout has the words of the text
_READ = "coalesce(warning NOT ILIKE 'OCR unavailable:%', true)"
_PG = f"pg AS (SELECT page_id, any_value(document_id) AS document_id, any_value(page_number) AS page_number, any_value(text) AS text, any_value(normalized_text) AS normalized_text, any_value(warning) AS warning, any_value(extraction_method) AS extraction_method, bool_or(layout_json IS NOT NULL AND {_READ}) AS laid FROM pages GROUP BY page_id)"
_FOLD = f"translate(regexp_replace(lower({{x}}), '[\\x{{{{0300}}}}-\\x{{{{036f}}}}]', '', 'g'), '{ACCENTED}', '{PLAIN}')"
_WORDS = "list_filter(regexp_split_to_array({x}, '[ \\n]+'), lambda w: w <> '')"


def _terms(x: str) -> str:
    return f"regexp_extract_all({_FOLD.format(x=x)}, '[\\p{{L}}\\p{{N}}]+')"


def _words(x: str) -> str:
    return _WORDS.format(x=x)


_IX = f"{_PG}, ix AS (SELECT page_id, document_id, coalesce({_terms('text')}, []) AS terms FROM pg)"
_IDF = "CASE WHEN ln((n - {df} + 0.5) / ({df} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - {df} + 0.5) / ({df} + 0.5)) END"


def _lex(query: str) -> str:
    """CTEs up to lex(page_id, score): the best 200 pages."""
    tokens = [p[0] for p in query_tokens(query)]
    tf = ", ".join(f"len(list_filter(terms, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(tokens))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(tokens)))
    score = " + ".join(f"({_IDF.format(df=f'df{i}')}) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / (total / n)))" for i in range(len(tokens)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(tokens)))
    return f"""{_IX}, c AS (SELECT page_id, document_id, len(terms) AS dl, {tf} FROM ix), st AS (SELECT count(*) AS n, sum(dl)::DOUBLE AS total, {df} FROM c),
    sc AS (SELECT page_id, {score} AS score FROM c, st WHERE {hit} AND document_id IN (SELECT doc_id FROM documents WHERE active)),
    lex AS (SELECT page_id, score FROM sc ORDER BY round(score, 9) DESC, page_id LIMIT 200)"""


_VEC = """us AS (SELECT embedding_id, embedding::DOUBLE[] AS e FROM passage_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
q AS (SELECT e AS qe FROM us WHERE len(list_filter(e, lambda x: x <> 0)) > 0 ORDER BY embedding_id LIMIT 1),
tk AS (SELECT embedding_id, list_inner_product(e, qe) AS score FROM us, q ORDER BY round(list_inner_product(e, qe), 9) DESC, embedding_id LIMIT 400)"""
_SEM = (
    _VEC
    + """, pa AS (SELECT passage_id, any_value(page_id) AS page_id, any_value(embedding_id) AS embedding_id, any_value(text) AS passage, any_value(word_start) AS word_start, any_value(word_end) AS word_end FROM passages WHERE active AND embedding_id IS NOT NULL GROUP BY passage_id),
po AS (SELECT DISTINCT page_id, document_id FROM pages),
hs AS (SELECT pa.page_id, score, passage, word_start, word_end, row_number() OVER (PARTITION BY pa.page_id ORDER BY round(score, 9) DESC, tk.embedding_id) AS k FROM tk JOIN pa USING (embedding_id) JOIN po ON po.page_id = pa.page_id WHERE document_id IN (SELECT doc_id FROM documents WHERE active)),
sem AS (SELECT page_id, score, passage, word_start, word_end FROM hs WHERE k = 1 ORDER BY round(score, 9) DESC, page_id LIMIT 200)"""
)
_RRF = """lr AS (SELECT page_id, row_number() OVER (ORDER BY round(score, 9) DESC, page_id)::INTEGER AS lex_rank FROM lex),
sr AS (SELECT page_id, passage, word_start, word_end, row_number() OVER (ORDER BY round(score, 9) DESC, page_id)::INTEGER AS sem_rank FROM sem),
fu AS (SELECT coalesce(lr.page_id, sr.page_id) AS page_id, lex_rank, sem_rank, coalesce(1.0::DOUBLE / (60 + lex_rank), 0) + coalesce(1.0::DOUBLE / (60 + sem_rank), 0) AS rrf, passage, coalesce(word_start, 0) AS word_start, coalesce(word_end, 0) AS word_end FROM lr FULL JOIN sr ON lr.page_id = sr.page_id),
f AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, lex_rank NULLS LAST, sem_rank NULLS LAST)::INTEGER AS fused_rank FROM fu ORDER BY fused_rank LIMIT 40)"""


def _blend(logit: str) -> str:
    return f"""tx AS (SELECT page_id, max(text) AS text FROM pages GROUP BY page_id),
    b0 AS (SELECT f.*, coalesce(nullif(passage, ''), tx.text, '') AS rt FROM f LEFT JOIN tx ON tx.page_id = f.page_id),
    b1 AS (SELECT *, {logit} AS logit FROM b0),
    b AS (SELECT *, 0.75::DOUBLE / (1 + exp(-greatest(-30, least(30, logit)))) + 0.25::DOUBLE * rrf / max(rrf) OVER () AS score FROM b1)"""


#: highlighted words of a page with a layout: the hits of w, else the words from s to e
_BOXES = "CASE WHEN NOT laid THEN 0 WHEN len(list_filter(list_transform(w, lambda y: lower(y)), lambda x: {hit})) > 0 THEN len(list_filter(list_transform(w, lambda y: lower(y)), lambda x: {hit})) ELSE greatest(0, least(len(w), e) - s) END::INTEGER"
_LAID = f"lw AS (SELECT page_id, {_words('text')} AS v, CASE WHEN {_READ} THEN {_words('text')} ELSE [] END AS w FROM pages WHERE layout_json IS NOT NULL)"
_OVERLAP = f"(CASE WHEN list_contains({_terms('rt')}, '{SINGLE}') THEN 1.0 ELSE 0.0 END - 1.0)::DOUBLE"
_HYBRID = f"WITH {_lex(SINGLE)}, {_SEM}, {_RRF}"
_ONLY_SEM = f"WITH lex AS (SELECT 0::BIGINT AS page_id, 0.0::DOUBLE AS score WHERE false), {_SEM}, {_RRF}"
_EXACT = f"WITH {_PG}, x AS (SELECT page_id, document_id, title, page_number, 1.0::DOUBLE AS score FROM pg JOIN documents ON doc_id = document_id AND active WHERE contains(normalized_text, '{NEEDLE}'))"
_CHANGES = """s AS (SELECT path, doc_id, size, CASE WHEN epoch_ms(indexed_at) * 1000000 >= mtime_ns THEN mtime_ns END AS mtime_ns, state FROM documents WHERE indexed_at IS NOT NULL),
fd AS (SELECT DISTINCT ON (path) path, size, mtime_ns FROM documents WHERE active),
ch AS (SELECT coalesce(fd.path, s.path) AS path, s.doc_id, CASE WHEN fd.path IS NULL THEN 'gone' WHEN s.doc_id IS NULL THEN 'new'
  WHEN s.size IS NOT DISTINCT FROM fd.size AND s.mtime_ns IS NOT DISTINCT FROM fd.mtime_ns AND s.state = 'indexed' THEN 'unchanged' ELSE 'changed' END AS change FROM fd FULL JOIN s ON fd.path = s.path)"""
_CHUNKS = f"""w AS (SELECT page_id, {_words('text')} AS w FROM pg WHERE text IS NOT NULL),
n AS (SELECT page_id, w, len(w) AS n, greatest(0, ceil((len(w) - 260) / 220.0))::INTEGER AS more FROM w WHERE len(w) > 0),
k AS (SELECT page_id, w, n, unnest(range(0, more + 1))::INTEGER AS ordinal FROM n)"""
_MISSING = """ms AS (SELECT DISTINCT passage_id, page_id FROM passages WHERE active AND (embedding_id IS NULL OR embedding_id NOT IN (SELECT embedding_id FROM passage_vectors WHERE embedding IS NOT NULL AND embedding_id IS NOT NULL)))"""


def oracle_sql() -> dict[str, str]:
    bm = "SELECT page_id, round(score, 6) AS score FROM lex"
    return {
        "tokenize_terms": f"SELECT page_id, array_to_string(coalesce({_terms('text')}, []), ' ') AS terms FROM pages",
        "content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "page_words": f"""WITH w AS (SELECT page_id, coalesce({_words('text')}, []) AS w FROM pages)
            SELECT page_id, len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x)))::BIGINT + len(w) - 1 END AS n_chars,
            coalesce(list_sum(list_transform(w, lambda x, i: (length(x) + 1) * (len(w) - i))), 0)::BIGINT AS sum_starts FROM w""",
        "chunk_passages": f"WITH {_CHUNKS.replace('FROM pg', 'FROM pages')} SELECT page_id, ordinal, ordinal * 220 AS word_start, least(ordinal * 220 + 260, n)::INTEGER AS word_end, array_to_string(w[ordinal * 220 + 1 : least(ordinal * 220 + 260, n)], ' ') AS text FROM k",
        "corpus_counts": "SELECT count(*) AS documents, coalesce(sum(page_count), 0)::BIGINT AS pages FROM documents WHERE active",
        "document_list": "SELECT doc_id, title, path, page_count, state, error, indexed_at FROM documents ORDER BY title NULLS FIRST, doc_id LIMIT 100",
        "document_titles": "SELECT doc_id, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM documents",
        "latest_job": "SELECT DISTINCT job_id, state, total_files, processed_files, indexed_files, failed_files FROM index_jobs ORDER BY job_id DESC LIMIT 1",
        "job_counters": "SELECT state, sum(total_files)::BIGINT AS total_files, sum(processed_files)::BIGINT AS processed_files, sum(indexed_files)::BIGINT AS indexed_files, sum(failed_files)::BIGINT AS failed_files, count(*) AS jobs, count(*) FILTER (finished_at IS NULL) AS open FROM (SELECT DISTINCT ON (job_id) * FROM index_jobs) GROUP BY state",
        "document_states": "SELECT source, count(*) AS processed, count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'failed') AS failed FROM documents GROUP BY source",
        "source_list": "SELECT root_id, path, coalesce(documents, 0) AS documents, last_scanned_at IS NOT NULL AS scanned FROM source_roots LEFT JOIN (SELECT source, count(*) AS documents FROM documents GROUP BY source) USING (source)",
        "semantic_coverage": "SELECT count(*) AS total, count(e) AS embedded, count(*) > 0 AND count(*) = count(e) AS ready FROM (SELECT passage_id, max(embedding_id) AS e FROM passages WHERE active GROUP BY 1)",
        "ocr_gate": "SELECT page_id, length(coalesce(normalized_text, '')) < 50 AS needs_ocr, length(coalesce(normalized_text, '')) < 10 AS full_ocr FROM pages",
        "ocr_failed_docs": "SELECT count(DISTINCT document_id) AS documents FROM pages WHERE warning ILIKE 'OCR unavailable:%'",
        "ocr_requeue": "SELECT doc_id, CASE WHEN doc_id IN (SELECT document_id FROM pages WHERE warning ILIKE 'OCR unavailable:%') THEN 'pending' ELSE state END AS state FROM documents",
        "postings_stats": f"WITH {_IX}, t AS (SELECT page_id, unnest(terms) AS term FROM ix) SELECT term, count(DISTINCT page_id) AS df, count(*) AS cf FROM t GROUP BY term",
        "corpus_stats": f"WITH {_IX} SELECT count(*) AS n, sum(len(terms))::BIGINT AS total, round(sum(len(terms))::DOUBLE / count(*), 6) AS avgdl FROM ix",
        "lexical_bm25_single": f"WITH {_lex(SINGLE)} {bm}",
        "lexical_bm25_and": f"WITH {_lex(BOTH)} {bm}",
        "lexical_diacritics": f"WITH {_lex(MARKED)} {bm}",
        "lexical_all_terms": f"""WITH {_IX}, q0 AS (SELECT term_id, unnest({_terms('term')}) AS term FROM search_terms), qt AS (SELECT term_id, term, count(*) AS times FROM q0 GROUP BY ALL),
            nd AS (SELECT term_id, count(*) AS need FROM qt GROUP BY 1), dl AS (SELECT page_id, document_id, len(terms) AS dl FROM ix), st AS (SELECT count(*) AS n, sum(dl)::DOUBLE AS total FROM dl),
            po AS (SELECT page_id, unnest(terms) AS term FROM ix), tf AS (SELECT page_id, term, count(*) AS tf FROM po WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
            h AS (SELECT term_id, page_id, document_id, sum(times * ({_IDF.format(df='df')}) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) AS score, count(*) AS have FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (page_id), st GROUP BY ALL),
            r AS (SELECT term_id, page_id, score, row_number() OVER (PARTITION BY term_id ORDER BY round(score, 9) DESC, page_id)::INTEGER AS rank FROM h JOIN nd USING (term_id) WHERE have = need AND document_id IN (SELECT doc_id FROM documents WHERE active))
            SELECT term_id, page_id, round(score, 6) AS score, rank FROM r WHERE rank <= 200""",
        "exact_match": f"{_EXACT} SELECT * FROM x ORDER BY title, page_number, page_id LIMIT 10",
        "exact_match_page2": f"{_EXACT} SELECT * FROM x ORDER BY title, page_number, page_id LIMIT 10 OFFSET 10",
        "exact_total": f"{_EXACT} SELECT count(*) AS total FROM x",
        "exact_short_needles": f"WITH {_PG}, w AS (SELECT page_id, unnest(string_split(normalized_text, ' ')) AS needle FROM pg) SELECT needle, count(DISTINCT page_id) AS pages FROM w WHERE length(needle) BETWEEN 1 AND 2 GROUP BY 1",
        "exact_all_terms": f"WITH {_PG} SELECT term_id, count(*) AS total FROM pg JOIN search_terms ON contains(normalized_text, replace(lower(term), 'ß', 'ss')) WHERE document_id IN (SELECT doc_id FROM documents WHERE active) GROUP BY 1",
        "vector_topk": f"WITH {_VEC} SELECT embedding_id, round(score, 6) AS score FROM tk",
        "vector_norms": f"WITH {_VEC} SELECT embedding_id, CASE WHEN list_inner_product(e, e) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM us",
        "semantic_pages": f"WITH {_SEM} SELECT page_id, round(score, 6) AS score, word_start, word_end FROM sem",
        "rrf_fusion": f"{_HYBRID} SELECT page_id, lex_rank, sem_rank, round(rrf, 8) AS rrf, word_start, word_end, fused_rank FROM f",
        "rerank_blend": f"{_HYBRID}, {_blend(_OVERLAP)} SELECT page_id, logit, round(score, 6) AS score FROM b",
        "hybrid_rerank_offline": f"{_HYBRID}, {_blend('0.0::DOUBLE')} SELECT page_id, round(score, 6) AS score FROM b",
        "hybrid_search": f"""{_HYBRID}, {_blend(_OVERLAP)}, t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, fused_rank)::INTEGER AS pos FROM b),
            o AS (SELECT t.pos, t.page_id, t.score, t.word_start AS s, t.word_end AS e, pg.document_id, pg.page_number, pg.extraction_method, pg.warning, laid, {_words('pg.text')} AS w FROM t JOIN pg ON pg.page_id = t.page_id WHERE pos <= 10)
            SELECT pos, page_id, document_id, title, path, page_number, round(score, 6) AS score, array_to_string(w[greatest(0, s - 12) + 1 : least(len(w), greatest(e, s + 50) + 12)], ' ') AS snippet, {_BOXES.format(hit=f"x = '{SINGLE}'")} AS boxes, extraction_method, coalesce(nullif(warning, ''), error) AS warning,
            '/api/documents/' || document_id || '/pdf#page=' || page_number AS pdf_url FROM o JOIN documents ON doc_id = document_id""",
        "semantic_search": f"{_ONLY_SEM}, {_blend(_OVERLAP)} SELECT page_id, round(score, 6) AS score FROM b ORDER BY round(b.score, 9) DESC, fused_rank LIMIT 10",
        "snippets": f"WITH w AS (SELECT page_id, coalesce({_words('text')}, []) AS w FROM pages) SELECT page_id, array_to_string(w[1 : least(len(w), greatest(least(len(w), 60), 50) + 12)], ' ') AS snippet FROM w",
        "highlights": f"WITH {_PG}, q AS (SELECT DISTINCT unnest(string_split(replace(lower(term), 'ß', 'ss'), ' ')) AS word FROM search_terms), n AS (SELECT page_id, string_split(normalized_text, ' ') AS a FROM pg WHERE normalized_text IS NOT NULL), x AS (SELECT page_id, unnest(a) AS word, unnest(range(0, len(a)))::INTEGER AS word_no FROM n) SELECT page_id, word_no, word FROM x WHERE word IN (SELECT word FROM q)",
        "highlight_boxes": f"WITH {_LAID}, x AS (SELECT page_id, w, 0 AS s, 60 AS e, true AS laid FROM lw) SELECT page_id, {_BOXES.format(hit=' OR '.join(f"x = '{t}'" for t in BOTH.split()))} AS boxes FROM x",
        "layout_words": f"WITH {_LAID} SELECT page_id, len(w)::INTEGER AS n_words, CASE WHEN len(w) > 0 THEN length(array_to_string(w, ' '))::INTEGER END AS n_chars, array_to_string(w, ' ') = array_to_string(v, ' ') AS agrees FROM lw",
        "document_lookup": "SELECT doc_id, path, title, state, page_count FROM documents WHERE doc_id = 42",
        "embed_udf": "SELECT DISTINCT passage_id, 64::INTEGER AS dim, NULL::VARCHAR AS error FROM passages WHERE active",
        "backfill_batch": f"WITH {_MISSING} SELECT passage_id AS embedding_id, 64::INTEGER AS dim, NULL::VARCHAR AS error FROM ms",
        "result_hydrate": f"WITH {_PG} SELECT page_id, title, coalesce(nullif(warning, ''), error) AS warning, '/api/documents/' || document_id || '/pdf#page=' || page_number AS pdf_url FROM pg JOIN documents ON doc_id = document_id",
        "change_classify": f"WITH {_CHANGES} SELECT path, doc_id, change FROM ch",
        "deleted_docs": f"WITH {_CHANGES} SELECT doc_id FROM ch WHERE change = 'gone'",
        "tombstone_passages": f"WITH {_CHANGES}, o AS (SELECT DISTINCT page_id, document_id FROM pages), a AS (SELECT page_id, change IN ('unchanged', 'changed') AS alive FROM o JOIN ch ON ch.doc_id = document_id) SELECT DISTINCT passage_id, coalesce(alive, active) AS active FROM passages LEFT JOIN a USING (page_id)",
        "replace_merge": f"""WITH {_PG}, {_CHUNKS.replace("FROM pg WHERE", "FROM pg WHERE extraction_method = 'native' AND")}, fresh AS (SELECT page_id, ordinal, least(ordinal * 220 + 260, n)::INTEGER AS word_end FROM k),
            st AS (SELECT DISTINCT page_id, ordinal, word_start, word_end FROM passages WHERE page_id NOT IN (SELECT page_id FROM fresh)),
            u AS (SELECT page_id, word_end FROM fresh UNION ALL SELECT page_id, word_end FROM st) SELECT page_id, count(*) AS passages, max(word_end) AS words FROM u GROUP BY 1""",
        "missing_embeddings": f"WITH {_MISSING} SELECT passage_id FROM ms",
        "missing_docs": f"WITH {_MISSING}, o AS (SELECT DISTINCT page_id, document_id FROM pages) SELECT document_id AS doc_id, count(*) AS missing FROM ms JOIN o USING (page_id) WHERE document_id IN (SELECT doc_id FROM documents WHERE active) GROUP BY 1",
        "latest_pages": "SELECT page_id, any_value(document_id) AS document_id, any_value(page_number) AS page_number, epoch_us(max(loaded_at)) AS loaded_at FROM pages GROUP BY 1",
    }
