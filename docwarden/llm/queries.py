"""The queries op1 to op13: each operator over its whole table."""

from __future__ import annotations

from docwarden.llm import (
    archives, clustering, decontaminate, html_extract, jaccard_join, language_id, packing, quality, secret_scan, sharding, substring_dedup,
    token_alignment, url_filter,
)
from docwarden.llm.registry import query, table


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeats(docs).drop("kept_text")


@query("op9_jaccard_join")
def op9(spark, sf_dir):
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


@query("op8_decontamination")
def op8(spark, sf_dir):
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents")).drop("row_key")


@query("op3_html_extraction")
def op3(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op4_secret_scan", secret_scan.oracle_sql())
def op4(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op6_url_filter", url_filter.oracle_sql())
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.selectExpr("page_id", "url", "cast((page_id * 7919) % 365 as int) as day")
    return url_filter.judged(captures, url_filter.log_of(pages))


@query("op11_token_alignment")
def op11(spark, sf_dir):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(spark, sf_dir, "documents"), *paths)


@query("op12_warc", archives.oracle_sql())
def op12(spark, sf_dir):
    return archives.read_back(spark, archives.archived(table(spark, sf_dir, "pages")))


@query("op13_centroid_clustering", clustering.oracle_sql())
def op13(spark, sf_dir):
    return clustering.cluster(table(spark, sf_dir, "embeddings"))
