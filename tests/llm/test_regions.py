"""Voronoi regions of document pivots on the supplied table."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import jaccard


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(size=5, num=80)])
def test_regions_replicate_boundary_documents(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.xxhash64("text").alias("u"), "text").dropDuplicates(["u"])
    near, _ = jaccard.candidate_edges(docs, rule)
    held: dict[int, list[np.ndarray]] = {}
    for r in rule.cells(near).join(docs, "u").orderBy("cell", "u").collect():
        held.setdefault(r.cell, []).append(jaccard.shingles(r.text, rule.size))
    seen = Counter()
    keep = jaccard.Cell.voronoi

    def watched(self, region):
        before = len(self.edges)
        parts = keep(self, region)
        together = np.concatenate(parts)
        seen["cuts"] += 1
        seen["regions"] += len(parts)
        seen["linked with pivots"] += len(self.edges) - before
        seen["in several regions"] += len(together) - len(np.unique(together))
        assert set(together.tolist()) == set(region.tolist())
        return parts

    jaccard.Cell.voronoi = watched
    try:
        for sets in held.values():
            if len(sets) > 1:
                seen["links"] += len(jaccard.Cell(sets, rule).links())
    finally:
        jaccard.Cell.voronoi = keep
    several = sum(len(s) > 2 for s in held.values())
    assert seen["cuts"] >= several > 3 and seen["regions"] > 2 * seen["cuts"] and seen["in several regions"] > 20 and seen["links"] > 0
