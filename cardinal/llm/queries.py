"""Registered queries of the pipeline operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinal.llm import (
    bpe_counts,
    grid_join,
    hard_negatives,
    impact_search,
    language,
    main_text,
    mixing,
    near_dup,
    ngram_lm,
    packing,
    quality,
    runs,
    sharding,
)
from cardinal.llm.common import fold, table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(remainder: int):
    return F.coalesce(fold() == remainder, F.lit(False)).alias("held_out")


def op1_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    """Fitted on labelled documents outside the held-out fold."""
    return quality.fit(docs, labels, fold() != 0)


def op2_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_texts(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(0), "score", "predicted")


def op3_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, fold() != 0))
    return found.select("doc_id", held_out(0), "lang_pred", "score", "rejected")


def op4_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its block's window and slot, for weights rows ** 0.7 in 1000 units, blocks of 8 rows."""
    return mixing.schedule(table(spark, sf_dir, "documents")).drop("_g", "_key", "_rank")


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"), shards=8)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op8_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.train_and_score(table(spark, sf_dir, "documents"), fold() != 1)
    return scored.select("doc_id", held_out(1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.token_counts(table(spark, sf_dir, "documents"), word_bpe())


def op11_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minmax_hash": op1_minmax_hash,
    "op2_byte_convolution": op2_byte_convolution,
    "op3_subword_softmax": op3_subword_softmax,
    "op4_impact_search": op4_impact_search,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_stratified_shards": op6_stratified_shards,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_grid_order_join": op8_grid_order_join,
    "op9_elias_fano_lm": op9_elias_fano_lm,
    "op10_token_counts": op10_token_counts,
    "op11_tree_scoring": op11_tree_scoring,
    "op12_residue_negatives": op12_residue_negatives,
    "op13_repair_runs": op13_repair_runs,
}

NEAR_DUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.sh = q.sh AND p.doc_id <> q.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r(node, comp) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node
), m AS (
  SELECT node, min(comp) AS component_id FROM r GROUP BY node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON node = doc_id LEFT JOIN n USING (doc_id)
"""

SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

VECTOR_LINK_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), e AS (
  SELECT p.vec_id AS a, q.vec_id AS b
  FROM v p JOIN v q ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.e, q.e) >= 0.93
), r(node, comp) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node
), m AS (
  SELECT node, min(comp) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id
"""

MIXING_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS g,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY g ORDER BY k, doc_id) - 1) // 8 + 1 AS block FROM d
), n AS (
  SELECT g, count(*) AS rows, pow(count(*)::DOUBLE, 0.7) AS w FROM d GROUP BY g
), s AS (
  SELECT g, rows, greatest(1000, 2 * count(*) OVER ()) AS span, count(*) OVER () AS live,
         (greatest(1000, 2 * count(*) OVER ()) - count(*) OVER ()) * w / sum(w) OVER () AS share FROM n
), f AS (
  SELECT *, floor(share + 1e-9)::BIGINT AS whole FROM s
), u AS (
  SELECT g, rows, span, 1 + whole + (row_number() OVER (ORDER BY share - whole DESC, g) <= span - live - sum(whole) OVER ())::BIGINT AS u FROM f
), c AS (
  SELECT any_value(span)::BIGINT AS span, list(g ORDER BY g) AS gs, list(u::BIGINT ORDER BY g) AS us FROM u
), sim(tick, done, pick) AS (
  SELECT -1::BIGINT, list_transform(us, lambda x: 0::BIGINT), 0::BIGINT FROM c
  UNION ALL
  SELECT tick, list_transform(done, lambda x, i: x + (i = pick)::BIGINT), pick
  FROM (SELECT sim.tick + 1 AS tick, done, list_min(list_transform(
          list_filter(range(1, len(us) + 1), lambda i: done[i] * span // us[i] <= sim.tick + 1),
          lambda i: {'due': ((done[i] + 1) * span + us[i] - 1) // us[i], 'i': i})).i AS pick
        FROM sim, c WHERE sim.tick + 1 < span)
), p AS (
  SELECT gs[pick] AS g, tick, row_number() OVER (PARTITION BY pick ORDER BY tick) AS j FROM sim, c WHERE tick >= 0
), t AS (
  SELECT r.*, u.u, u.span, ((block - 1) // u) * u.span + p.tick AS slot
  FROM r JOIN u USING (g) JOIN p ON p.g = r.g AND p.j = (block - 1) % u + 1
), e AS (
  SELECT min(((rows + 7) // 8 // u) * span + p.tick) AS stop FROM u JOIN p ON p.g = u.g AND p.j = (rows + 7) // 8 % u + 1
)
SELECT doc_id, source, block::BIGINT AS block, ((block - 1) * span // u)::BIGINT AS release,
       ((block * span + u - 1) // u)::BIGINT AS deadline, slot::BIGINT AS slot, slot < stop AS in_mixture
FROM t, e
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {
    "op12_residue_negatives": NEGATIVES_SQL,
    "op5_pfair_mixing": MIXING_SQL,
    "op1_minmax_hash": NEAR_DUP_SQL,
    "op4_impact_search": SEARCH_SQL,
    "op8_grid_order_join": VECTOR_LINK_SQL,
}
