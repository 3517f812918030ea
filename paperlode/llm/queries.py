"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import ann, collocations, decontaminate, license_scan, main_text, merkle, packing, simhash, substring_dedup, token_counts, token_store, toxicity, url_templates
from .common import shared_dir, table
from .oracles import ORACLE_SQL  # noqa: F401
from .token_ids import vocabulary


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op4_decontamination(spark, sf_dir):
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


def op5_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_url_templates(spark, sf_dir):
    # a page's label is that of the document with its id: of low quality, or toxic
    labels = table(spark, sf_dir, "labels")
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) > 0)).cast("int")
    return url_templates.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_token_store(spark, sf_dir):
    at = f"{shared_dir(spark)}/paperlode-ids-{uuid.uuid4().hex}"
    token_store.write_ids(table(spark, sf_dir, "documents"), at, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_store.read_ids(spark, at)


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op11_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_token_counts, op4_decontamination, op5_nearest_neighbours, op6_url_templates, op7_license_scan, op8_token_store, op9_substring_dedup, op10_simhash, op11_phrase_collocations, op12_merkle_manifest, op13_html_extraction)}
