"""Queries on the whole match chain send nothing through the driver that grows with library, peaks or matches."""

import re

import pytest

from peakforge.plans.registry import QUERIES

CHAIN = [
    "candidate_rank", "compile_samples", "decoy_corroboration", "dedup_by_collection_priority", "explode_matches", "adduct_corroboration", "apply_match_params",
    "export_goldens_ions", "export_goldens_peaks", "fit_score_v2", "incomplete_aggregates", "intensity_matrix_filter", "ion_match_category",
]


@pytest.mark.parametrize("name", CHAIN)
def test_samples_and_single_rows_alone_are_broadcast(spark, sf_dir, name):
    """At this size Catalyst takes every table for small, as it took the exploded library at 60 times sf0.1, whose file has 5 MB."""
    lines = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[ :+-]*", line)[0])
    for k, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        sent = []
        for below in lines[k + 1 :]:
            if depth(below) <= depth(line):
                break
            sent.append(below)
        single = any("HashAggregate(keys=[]," in s for s in sent[:2])
        tables = {t for s in sent for t in re.findall(r"/(\w+)\.parquet", s)}
        assert single or tables <= {"supplier", "nation", "region"}, "\n".join([line, *sent])
