"""Keys of the Jaccard tiles: what links shares a kept one, what meets by chance is not sent."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.llm import jaccard
from tests.llm import brute


def test_unrelated_texts_are_not_sent(spark, monkeypatch):
    """Empty segments are common to many sets; they bring a few of 400 unrelated texts together, not most."""
    rng = random.Random(3)
    data = [(i, " ".join(f"v{rng.randrange(10**9)}" for _ in range(rng.randrange(90, 240)))) for i in range(400)]
    data += [(1000 + i, t + " x") for i, t in data[:5]]
    sent = []
    joined = jaccard.joined

    def counting(members, payload, percent):
        sent.append(members.count())
        return joined(members, payload, percent)

    monkeypatch.setattr(jaccard, "joined", counting)
    kept = {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(range(400))
    assert sent[0] < 400


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_keep_a_common_key(spark, percent):
    """Chains of edits at the threshold among copies of one passage, whose keys many sets have."""
    rng = random.Random(percent)
    passage, texts = [f"p{i}" for i in range(30)], {}
    for n in (6, 9, 20, 45, 90, 150, 330):
        for _ in range(6):
            words = passage[: n // 3] + [f"v{rng.randrange(10**6)}" for _ in range(n)]
            for _ in range(9):
                texts[len(texts)] = " ".join(words)
                for _ in range(rng.randrange(1, max(2, n // 30))):
                    words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
                if rng.random() < 0.3:
                    words.append("more")
    sets = {i: brute.shingles(t, 5) for i, t in texts.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert len(linked) > 50
    hashed = list(jaccard.shingle_sets(pa.array([t.encode() for t in texts.values()], pa.binary()), 5))
    rows = [(i, jaccard.segment_keys(h, percent).view(np.int64).tolist()) for i, h in zip(texts, hashed)]
    reps = spark.createDataFrame(rows, "node long, keys array<long>")
    parts = [jaccard.shared_keys(reps, part) for part in range(jaccard.PARTS)]
    filed = parts[0]
    for part in parts[1:]:
        filed = filed.unionByName(part)
    assert filed.count() == reps.select("node", F.explode("keys").alias("g")).join(filed.select("g").distinct(), "g").count()
    of = defaultdict(set)
    for r in jaccard.met(filed, percent).collect():
        of[r.g].add(r.node)
    assert not {p for p in linked if not any(p[0] in m and p[1] in m for m in of.values())}
    assert len({frozenset(m) for m in of.values()}) == len(of)


def test_keys_are_exchanged_once(spark):
    """The grouping of keys and the join that follows read one exchange."""
    reps = spark.createDataFrame([(i, [j << jaccard.BAND_BITS for j in range(i)]) for i in range(9)], "node long, keys array<long>")
    shared = jaccard.shared_keys(reps, 0)
    assert {(r.g >> jaccard.BAND_BITS, r.node, r.n) for r in shared.collect()} == {(j, i, 8 - j) for j in range(0, 7, jaccard.PARTS) for i in range(j + 1, 9)}
    plan = shared._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") == 1
