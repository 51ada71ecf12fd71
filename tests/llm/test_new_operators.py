"""Neighbours, spelling variants and resampling against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import neighbours, resampling, spelling
from tests.llm.brute import ASCII_LOWER

# --- nearest neighbours -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v string, h int, members long"


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], VECTORS).repartition(3)


def brute_nearest(rows, every, k):
    """Each query's nearest, over usable vectors; of several under one id the smallest."""
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        usable[i] = min(usable.get(i, v), v)
    dot = lambda a, b: math.fsum(x * y for x, y in zip(a, b))
    return {q: sorted((-dot(v, w), i) for i, w in usable.items() if i != q)[:k] for q, v in usable.items() if q % every == 0}


def found_nearest(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((-r["score"], r["vec_id"]))
    return out


def test_neighbours_of_odd_rows(spark):
    """With one list the search is exact: ties, copies, short vectors, unusable rows, repeated ids."""
    rng = random.Random(5)
    whole = lambda n: [float(rng.randrange(-3, 4)) for _ in range(n)]
    rows = [(i, whole(4)) for i in range(200)] + [(1000 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 1.0, 1.0]), (2060, [1.0, float("nan"), 0.0, 0.0]), (2080, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (2100, []), (2120, [3.0]), (40, [1.0, 2.0, 0.0, 1.0]), (40, [1.0, 2.0, 0.0, 1.0]), (-20, whole(4))]
    got = found_nearest(neighbours.nearest(vectors_table(spark, rows), lambda i: i % 20 == 0, k=20))
    want = brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_fewer_candidates_than_asked(spark):
    rows = [(i, [1.0, float(i)]) for i in range(6)]
    got = found_nearest(neighbours.nearest(vectors_table(spark, rows), lambda i: i % 2 == 0, k=20))
    assert {q: len(x) for q, x in got.items()} == {0: 5, 2: 5, 4: 5}
    # lists of one vector, of which the ratio alone would take too few
    narrow = neighbours.nearest(vectors_table(spark, rows), lambda i: i % 2 == 0, k=3, ratio=1.0, list_rows=1)
    assert {q: len(x) for q, x in found_nearest(narrow).items()} == {0: 3, 2: 3, 4: 3}


def test_no_vectors(spark):
    assert neighbours.nearest(vectors_table(spark, [(1, None), (20, [0.0])]), lambda i: i % 20 == 0).collect() == []


def test_recall_over_many_lists_and_blocks(spark):
    """Gaussian clouds of very different size in many lists, dealt in small blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24)) * 2
    of = rng.choice(30, 4000, p=np.r_[0.4, np.full(29, 0.6 / 29)])
    x = (centres[of] + rng.normal(size=(4000, 24)) * rng.uniform(0.2, 1, 30)[of][:, None]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = found_nearest(neighbours.nearest(vectors_table(spark, rows), lambda i: i % 20 == 0, list_rows=50, block_rows=40, block_queries=16))
    wide = x.astype(float)
    hits = []
    for q in range(0, 4000, 20):
        s = wide @ wide[q]
        s[q] = -np.inf
        hits.append(len({i for _, i in got[q]} & set(np.lexsort((np.arange(4000), -s))[:20])) / 20)
        assert len(got[q]) == 20
        assert np.allclose([-m for m, _ in got[q]], [wide[q] @ wide[i] for _, i in got[q]])
    assert np.mean(hits) >= 0.9


def test_halving_is_balanced_and_whole():
    x = np.random.default_rng(1).normal(size=(1000, 5))
    parts = neighbours.halves(x, 64)
    assert sorted(np.concatenate(parts)) == list(range(1000))
    assert max(map(len, parts)) <= 64 and min(map(len, parts)) >= 31
    assert neighbours.halves(np.zeros((10, 3)), 3)


def test_walk_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(400, 9))
    lists = neighbours.Lists(c, np.zeros((1, 1), int), 1.0, 8, c[:5, :8], np.zeros(5, int))
    own = np.arange(400)
    lists.graph = np.hstack([np.argsort(lists.distances(c), axis=1)[:, : neighbours.DEGREE + 1], np.roll(own, 1)[:, None], np.roll(own, -1)[:, None]])
    points = rng.normal(size=(50, 9))
    d = lists.distances(points)
    scan = d <= 1.2 * d.min(1)[:, None]
    walk = lists.near(points, 1.2)
    assert (walk & scan).sum() >= 0.98 * scan.sum()


# --- spelling variants ------------------------------------------------------------------


def brute_variants(rows, least_chars=5, least_n=3):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_n}
    near = {w: [x for x in n if x != w and one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_against_all_pairs(spark, docs, texts):
    rng = random.Random(8)
    stems = ["colour", "aaaaaa", "ananas", "élèvesÿ", "mississippi", "bookkeeper", "abcde"]
    rows = list(texts.items()) + [(None, "colour color colours colour"), (None, "Colour COLOUR ÉLÈVES Élèves")]
    for i in range(400):
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.insert(at, rng.choice("abcsé")), lambda: w.pop(at), lambda: w.__setitem__(at, rng.choice("abcsé"))])()
        rows.append((1000 + i, " ".join(["".join(w)] * rng.randrange(1, 9)) + "\n" + rng.choice(stems).upper()))
    rows += rows[-20:]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert found_variants(spelling.variants(df)) == brute_variants(rows)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=5, max_size=9), min_size=2, max_size=40, unique=True))
def test_prefixes_lose_no_pair(words):
    """Of any two words one apart, some of the rarest bigrams meet as the join lets them."""
    held = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    order = {g: i for i, g in enumerate(sorted(held, key=lambda g: (held[g], g)))}
    rare = {w: spelling.prefix(w, order) for w in words}
    for a in words:
        for b in words:
            if a != b and len(a) <= len(b) and one_apart(a, b):
                shifts = (0,) if len(a) == len(b) else (0, 1)
                assert any((g, at + s) in rare[b] for g, at in rare[a] for s in shifts), (a, b)
                assert ((spelling.letters(a) ^ spelling.letters(b)) & (2**64 - 1)).bit_count() <= 2


def test_long_chains_reach_their_root(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w7")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {a: "w40" for a, _ in links}


def test_no_words(empty):
    assert spelling.variants(empty).collect() == []


# --- importance resampling --------------------------------------------------------------


def brute_resampling(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in rows for f in grams(cut(t)))
    t = Counter(of(f) for x in target for f in grams(cut(x)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets)))))
    out = []
    for doc, text in rows:
        w = cut(text)
        f = grams(w)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    may = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = Counter((x[0], x[3]) for x in may[: percent * len(may) // 100])
    return sorted(out, key=str), rank, percent * len(may) // 100


@pytest.mark.parametrize("longest, percent, frequent", [(1, 10, 50_000), (1, 40, 20), (2, 100, 3), (3, 50, 1)])
def test_resampling_against_brute_force(spark, texts, longest, percent, frequent):
    rng = random.Random(longest)
    rows = list(texts.items()) + [(100 + i, " ".join(rng.choice(["The", "fox", "Ünï", "w7", "x" * 90, "3"]) for _ in range(rng.randrange(10, 60)))) for i in range(60)]
    rows += [(None, "a null id " * 12), (None, "another null id " * 12), *rows[20:24]]
    target = ["the quick w7 w8", None, "", "w7 " * 30]
    df = spark.createDataFrame([(i, t, 3, "g", 1) for i, t in rows], "doc_id long, text string, weight int, rank string, row int").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, longest=longest, percent=percent, frequent=frequent).collect()
    want, rank, drawn = brute_resampling(rows, target, longest, percent=percent)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got), key=str) == want
    placed = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in placed] == list(range(1, drawn + 1))
    assert Counter((r.doc_id, r.score) for r in placed) == rank
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in placed] == sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in placed)


def test_resampling_nothing(spark, empty, docs):
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, goal).collect() == []
    assert resampling.resample(docs, goal.filter("text is null")).count() == docs.count()
