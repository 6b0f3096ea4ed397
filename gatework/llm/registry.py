"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from gatework.llm import sql
from gatework.llm.centroids import cluster
from gatework.llm.collocations import collocations
from gatework.llm.common import table
from gatework.llm.decontamination import contamination
from gatework.llm.exact_dedup import exact_dedup
from gatework.llm.html_text import extract
from gatework.llm.language import language_report
from gatework.llm.language_model import score_report
from gatework.llm.mixing import mix_report
from gatework.llm.nearest import nearest
from gatework.llm.pii import pii_report
from gatework.llm.quality import quality_report
from gatework.llm.simhash import near_dedup
from gatework.llm.token_output import token_output

QUERIES = {
    "op1_lm_scoring": lambda spark, sf_dir: score_report(table(spark, sf_dir, "documents")),
    "op2_html_extraction": lambda spark, sf_dir: extract(table(spark, sf_dir, "pages")),
    "op3_simhash_dedup": lambda spark, sf_dir: near_dedup(table(spark, sf_dir, "documents")),
    "op4_exact_dedup": lambda spark, sf_dir: exact_dedup(table(spark, sf_dir, "documents")),
    "op5_decontamination": lambda spark, sf_dir: contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row"),
    "op6_language_id": lambda spark, sf_dir: language_report(table(spark, sf_dir, "documents")),
    "op7_pii": lambda spark, sf_dir: pii_report(table(spark, sf_dir, "documents")),
    "op8_quality": lambda spark, sf_dir: quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_token_output": lambda spark, sf_dir: token_output(table(spark, sf_dir, "documents")),
    "op10_mixing": lambda spark, sf_dir: mix_report(table(spark, sf_dir, "documents")),
    "op11_nearest_neighbours": lambda spark, sf_dir: nearest(table(spark, sf_dir, "embeddings")),
    "op12_collocations": lambda spark, sf_dir: collocations(table(spark, sf_dir, "documents")),
    "op13_centroid_clustering": lambda spark, sf_dir: cluster(table(spark, sf_dir, "embeddings")),
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_exact_dedup": sql.OP4,
    "op5_decontamination": sql.OP5,
    "op10_mixing": sql.OP10,
    "op12_collocations": sql.OP12,
    "op13_centroid_clustering": sql.OP13,
}
