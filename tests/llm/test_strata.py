"""Strata of the n-gram join by all shingles of their sets."""

import random
import sys
from fractions import Fraction
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from spotlake.llm import jaccard  # noqa: E402


def test_a_common_passage_does_not_make_pairs_of_blocks(spark, monkeypatch):
    """Short texts that share a passage but little else were one stratum, whose blocks met in pairs."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [f"p{k}" for k in range(13)]
    texts = [" ".join([word() for _ in range(9)] + passage + [word() for _ in range(9)]) for _ in range(150)]
    texts += [t + " more" for t in texts[:20]] + ["no " + t + " more" for t in texts[:5]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [jaccard.shingle_sets(pa.array([t]), 4)[0] for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j], Fraction("0.85")):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]

    def refused():
        raise AssertionError("pairs of blocks")

    monkeypatch.setattr(jaccard, "block_keys", refused)
    got = jaccard.near_duplicates(table, 4, "0.85", leaf=10).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root)) and len(set(root)) < 150 + 25
