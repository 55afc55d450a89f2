"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, language, licenses, line_runs, manifest, mixing, near_dups, outliers, periodic_runs, phrase_index, quality, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for fn in (
        quality.op1_quality_nbsvm,
        language.op2_language_backoff,
        bpe.op3_byte_bpe,
        outliers.op4_robust_outliers,
        fingerprints.op5_fingerprints,
        line_runs.op6_line_runs,
        toxicity.op7_toxicity_neighbours,
        licenses.op8_license_scan,
        mixing.op9_mix_raking,
        near_dups.op10_near_dups_icws,
        periodic_runs.op11_periodic_runs,
        manifest.op12_merkle_manifest,
        phrase_index.op13_phrase_decontamination,
    ):
        queries[fn.__name__] = fn
    oracles["op6_line_runs"] = line_runs.OP6_SQL
    oracles["op12_merkle_manifest"] = manifest.OP12_SQL
    oracles["op13_phrase_decontamination"] = phrase_index.OP13_SQL
    return queries, oracles
