"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from paxcast.llm import op1_lm, op2_embeddings, op3_bpe, op4_toxicity, op5_html, op6_warc, op7_minhash, op8_packing, op9_suffix, op10_quality, op11_spelling, op12_secrets, op13_repair
from paxcast.llm.common import table


def op1_lm_elias_fano(spark, sf_dir):
    return op1_lm.score(table(spark, sf_dir, "documents"))


def op2_embedding_range_join(spark, sf_dir):
    return op2_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_bpe_roundtrip(spark, sf_dir):
    return op3_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_toxicity_compression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return op4_toxicity.score(docs, op4_toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_html_main_text(spark, sf_dir):
    return op5_html.extract(table(spark, sf_dir, "pages"))


def op6_warc_chain(spark, sf_dir):
    return op6_warc.archive_and_read(table(spark, sf_dir, "pages"))


def op7_minhash_hamming(spark, sf_dir):
    return op7_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing_ffd(spark, sf_dir):
    return op8_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(*op8_packing.DIGESTS)


def op9_suffix_dedup(spark, sf_dir):
    return op9_suffix.dedup_digests(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return op10_quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return op11_spelling.spelling_variants(table(spark, sf_dir, "documents"), drop_every=97)


def op12_secret_scan(spark, sf_dir):
    return op12_secrets.secret_digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return op13_repair.repair_digests(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_lm_elias_fano, op2_embedding_range_join, op3_bpe_roundtrip, op4_toxicity_compression, op5_html_main_text, op6_warc_chain, op7_minhash_hamming, op8_packing_ffd, op9_suffix_dedup, op10_quality_rules, op11_spelling_variants, op12_secret_scan, op13_conversation_repair)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op2_embedding_range_join": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id
""",
}
