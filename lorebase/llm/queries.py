"""One query per operator, each over its whole table with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from lorebase.llm import bpe, collocations, filter_audit, jaccard, language, packing, pivots, quality_classifier, quality_rules, secret_scan, sql, suffix_dedup, toxicity, url_filter
from lorebase.llm.common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_exact_top_k(spark, sf_dir):
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_classifier.grades(table(spark, sf_dir, "labels")))
    return quality_classifier.scored(docs, model)


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_url_filter(spark, sf_dir):
    rules = url_filter.listed(spark, url_filter.RULES)
    hosts = url_filter.listed(spark, [("block", h, "") for h in url_filter.LISTED_HOSTS])
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, hosts)


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identified(docs, language.fit(docs))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark, sf_dir):
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_exact_top_k, op3_suffix_dedup, op4_quality_classifier, op5_toxicity,
        op6_url_filter, op7_ngram_jaccard_join, op8_quality_rules, op9_byte_bpe, op10_language_id,
        op11_filter_audit, op12_secret_scan, op13_collocations,
    )
}

SQL = {
    "op2_exact_top_k": sql.TOP_K, "op6_url_filter": sql.URL_FILTER, "op8_quality_rules": sql.QUALITY_RULES,
    "op11_filter_audit": sql.FILTER_AUDIT, "op12_secret_scan": sql.SECRET_SCAN, "op13_collocations": sql.COLLOCATIONS,
}
