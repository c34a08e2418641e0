"""The queries opN_<name> and pipeline, and the DuckDB statements for those that SQL can state."""

from __future__ import annotations

from . import bpe, chat, minhash, packing, recipes, rules, shards, spotsigs, toxicity, urlgraph
from .common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_byte_bpe": lambda spark, d: bpe.round_trip_digests(documents(spark, d), _vocabulary("byte_bpe_multi_50k.tiktoken")),
    "op2_spot_signatures": lambda spark, d: spotsigs.compare_with_next(documents(spark, d)),
    "op3_link_propagation": lambda spark, d: urlgraph.judge_pages(spark.read.parquet(f"{d}/pages.parquet")),
    "op4_tensored_minhash": lambda spark, d: minhash.near_duplicates(documents(spark, d), width=2),
    "op5_rule_quality": lambda spark, d: rules.score_documents(documents(spark, d), _labels(spark, d)),
    "op6_subword_toxicity": lambda spark, d: toxicity.score_documents(documents(spark, d), _labels(spark, d)),
    "op7_exact_recipes": lambda spark, d: recipes.exact_groups(documents(spark, d)),
    "op8_hypergeometric_shards": lambda spark, d: shards.shard_documents(documents(spark, d)),
    "op9_preference_format": lambda spark, d: chat.preference_examples(spark.read.parquet(f"{d}/conversations.parquet")),
    "op10_best_fit_packing": lambda spark, d: packing.pack_documents(documents(spark, d), _vocabulary("byte_bpe_50k.json")),
    "pipeline": _pipeline,
}

ORACLES = {
    "op4_tensored_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON s.doc_id = m.id
""",
    "op7_exact_recipes": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""",
    "op9_preference_format": """
WITH t AS (
  SELECT conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), l AS (
  SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS places FROM t
), c AS (
  SELECT conv_id, CASE WHEN len(places) > 0 THEN turns[1:places[len(places)]] ELSE turns END AS chosen,
    CASE WHEN len(places) > 0 THEN places[(conv_id >> 1) % len(places) + 1] END AS branch
  FROM l
), p AS (
  SELECT a.conv_id AS pair_id, a.chosen,
    CASE WHEN a.branch IS NULL THEN a.chosen ELSE a.chosen[1:a.branch - 1] || coalesce(b.chosen[b.branch:], [{'turn': a.chosen[a.branch].turn, 'role': 'assistant', 'text': ''}]) END AS rejected
  FROM c a LEFT JOIN c b ON xor(a.conv_id, 1) = b.conv_id AND b.branch IS NOT NULL
), k AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i].role <> rejected[i].role OR chosen[i].text <> rejected[i].text)) - 1, least(len(chosen), len(rejected))) AS k FROM p
), r AS (
  SELECT pair_id, k, chosen[1:k] AS prompt, chosen[k + 1:] AS c, rejected[k + 1:] AS r FROM k
), s AS (
  SELECT pair_id, k, list_transform(prompt, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS prompt, c, r,
    list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS sc,
    list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS sr
  FROM r
)
SELECT pair_id, k::INT AS prompt_turns, coalesce(array_to_string(prompt, ''), '') AS prompt, coalesce(array_to_string(sc, ''), '') AS chosen, coalesce(array_to_string(sr, ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: (length(array_to_string(sc[1:i - 1], '')) + 14) || '-' || (length(array_to_string(sc[1:i - 1], '')) + 14 + length(c[i].text) + 7)), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (length(array_to_string(sr[1:i - 1], '')) + 14) || '-' || (length(array_to_string(sr[1:i - 1], '')) + 14 + length(r[i].text) + 7)), ','), '') AS rejected_spans
FROM s
""",
}
