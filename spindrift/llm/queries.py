"""The queries of this folder, by the names under which the driver runs them."""

from __future__ import annotations

from . import embedding_dedup, fingerprint, line_dedup, mixing, packing, pieces, quality, ranked, sharding, simhash, toxicity, urls
from .common import table


def op2_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_document_fingerprints": fingerprint.query,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_source_mixing": mixing.query,
    "op4_line_dedup": line_dedup.query,
    "op5_sharding": sharding.query,
    "op6_sentencepiece": pieces.query,
    "op7_url_filters": urls.query,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_toxicity": toxicity.query,
    "op10_token_packing": packing.query,
    "op11_line_quality": quality.query,
    "op12_ranked_search": ranked.query,
}

ORACLES = {
    "op1_document_fingerprints": fingerprint.QUERY_SQL,
    "op2_embedding_near_dedup": embedding_dedup.QUERY_SQL,
    "op3_source_mixing": mixing.QUERY_SQL,
    "op4_line_dedup": line_dedup.QUERY_SQL,
    "op7_url_filters": urls.QUERY_SQL,
    "op12_ranked_search": ranked.QUERY_SQL,
}
