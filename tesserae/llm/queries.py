"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import functools

from tesserae.llm import html, jaccard, langid, mixing, packing, pii, quality, syncmers, tokenfiles, topk
from tesserae.llm.common import read, ship
from tesserae.llm.tokens import tokenizer_path


def op1_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"))


def op2_html(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


def op3_pii(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents"))


def op4_language(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"), host_col="source").drop("mark")


def op4_page_language(spark, sf_dir):
    return langid.identify_pages(read(spark, sf_dir, "pages"))


def op5_topk(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_closed_syncmers(spark, sf_dir):
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return tokenfiles.token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.link(read(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op10_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {f.__name__: _shipped(f) for f in (op1_quality, op2_html, op3_pii, op4_language, op4_page_language, op5_topk, op6_mixing, op7_closed_syncmers, op8_token_counts, op9_ngram_jaccard, op10_packing, pipeline)}


#: Same keys and the same order of arithmetic as the operator's.
OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(1 / 16::DOUBLE, 1 - (length(text) - length(regexp_replace(text, '[!-/0-9:-@\[-`{-~]', '', 'g')))::DOUBLE / length(text)) ELSE 1::DOUBLE END AS weight,
    md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS digest
  FROM documents
), keyed AS (
  SELECT *, -ln((('0x' || substr(digest, 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE) / weight AS k FROM docs
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM keyed GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes
), targets AS (
  SELECT source, source_size, least(coalesce((SELECT max(level) FROM levels WHERE level * w <= (3 * source_size)::DOUBLE) * w, 0::DOUBLE), (3 * source_size)::DOUBLE) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
), run AS (
  SELECT k.doc_id, k.source, k.size, b.source_size, b.target, b.epochs, floor(b.target - (b.epochs * b.source_size)::DOUBLE)::BIGINT AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target, epochs, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM run
"""


OP5_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Every pair that shares a shingle is counted, so this is for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 90 * (na.n + nb.n - c)
), sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r.y) FROM reach r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql():
    return {"op5_topk": OP5_SQL, "op6_mixing": OP6_SQL, "op9_ngram_jaccard": OP9_SQL}
