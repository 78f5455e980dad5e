"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import (
    decontamination, filter_audit, line_dedup, mixing, near_dups, pii, quality, repeats, sharding, token_counts, token_files, toxicity, variants,
)
from stowage.session import configure


def configured(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(configure(spark), sf_dir)


QUERIES = {
    name: configured(run)
    for name, run in {
        "op1_token_counts": token_counts.counts_query,
        "op2_quality_rules": quality.report_query,
        "op3_hilbert_shards": sharding.shards_query,
        "op4_near_dups": near_dups.groups_query,
        "op6_source_mix": mixing.mix_query,
        "op7_decontamination": decontamination.contamination_query,
        "op5_toxicity": toxicity.severity_query,
        "op9_repeats": repeats.repeats_query,
        "op8_personal_data": pii.personal_data_query,
        "op10_token_files": token_files.output_query,
        "op11_line_dedup": line_dedup.lines_query,
        "op12_filter_audit": filter_audit.audit_query,
        "op13_spelling_variants": variants.variants_query,
    }.items()
}

ORACLES = {
    "op2_quality_rules": quality.REPORT_SQL,
    "op11_line_dedup": line_dedup.LINES_SQL,
    "op12_filter_audit": filter_audit.AUDIT_SQL,
    "op13_spelling_variants": variants.VARIANTS_SQL,
}
