"""The pipeline's near-duplicate stage against brute force over all pairs."""

import itertools
import os
import random
import sys

import numpy as np
import pytest

from siftwood.llm import near_copies, simhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The class of each row by its position."""
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            of = [of[i] if x == of[j] else x for x in of]
    return of


def corpus():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    line = " ".join(r.choices(words, k=12))
    rows = []
    for k in range(60):
        text = r.choices(words, k=r.randint(3, 160)) + line.split() * (k % 2)
        rows.append((10 * k, " ".join(text)))
        for c in range(k % 4):
            for _ in range(c + 1):
                text[r.randrange(len(text))] = r.choice(words).upper()
            rows.append((10 * k + c + 1, " ".join(text)))
    return rows + [(9001, ""), (9002, None), (9003, "one two"), (9004, "One  TWO"), (9005, "one three")]


@pytest.mark.parametrize("frequent", [1, 4])
def test_stage_merges_all_near_copies(spark, monkeypatch, frequent):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    rows = corpus()
    of = brute(rows)
    assert 20 < len(rows) - len(set(of)) < 90
    want = {min(rows[j][0] for j in range(len(rows)) if of[j] == c) for c in set(of)}
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def simhash_of(text):
    """SimHash of a text's shingles, bit by bit."""
    import pyarrow as pa

    hashes = next(near_copies._sets(pa.array([text or ""]))).tolist()
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_stage_joins_by_simhash(spark, monkeypatch):
    """Without the prefix filter the stage merges what is within the radius and near."""
    import corpus_pipeline

    rows, seen = corpus(), []
    monkeypatch.setattr(near_copies, "candidates", lambda prints: prints.select(*[prints.node.alias(c) for c in "ab"]).limit(0))
    monkeypatch.setattr(near_copies, "near_links", lambda fps, radius: seen.append(radius) or simhash.near_links(fps, radius), raising=False)
    sets, prints = [shingles(t) for _, t in rows], [simhash_of(t) for _, t in rows]
    of = list(range(len(rows)))
    within = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 6]
    for i, j in within:
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            of = [of[i] if x == of[j] else x for x in of]
    assert 5 < len(rows) - len(set(of)) < len(rows) - len(set(brute(rows)))
    want = {min(rows[j][0] for j in range(len(rows)) if of[j] == c) for c in set(of)}
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and seen == [6]


def test_pairs_that_simhash_has_joined_are_settled(spark):
    pairs, found = [(1, 2), (1, 3), (2, 3), (3, 4), (5, 6), (6, 8), (7, 8)], [(1, 2), (2, 3), (5, 8), (6, 8), (9, 10)]
    left = near_copies.unsettled(*[spark.createDataFrame(x, "a long, b long") for x in (pairs, found)])
    assert sorted(map(tuple, left.collect())) == [(3, 4), (7, 8)]


@pytest.mark.parametrize("radius", [2, 4, 6, 8])
def test_near_links_reach_all_within_the_radius(spark, radius, monkeypatch):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for fp in fps[:20]:
        for _ in range(3):
            for k in rng.sample(range(64), rng.randint(1, radius + 2)):
                fp ^= 1 << k
            fps.append(fp)
    fps = sorted(set(fps))
    of = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            of = [of[i] if x == of[j] else x for x in of]
    assert len(fps) - len(set(of)) > 10
    nodes = spark.createDataFrame([(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)], "node long, fp long")
    for hot in (simhash.HOT_BUCKET, 1):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        links = [(r.a, r.b) for r in simhash.near_links(nodes, radius).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= radius for a, b in links)
        got = list(range(len(fps)))
        for a, b in links:
            got = [got[a] if x == got[b] else x for x in got]
        assert len(set(got)) == len(set(of)) == len(set(zip(got, of, strict=True)))


def test_sweep_carries_groups_over_batches():
    import pyarrow as pa

    r = np.random.default_rng(3)
    h, node = r.integers(0, 6, 300), r.integers(0, 50, 300)
    n = node % 9 + 1
    order = np.lexsort((node, n, h))
    cut = lambda k: pa.RecordBatch.from_arrays([pa.array(x[order][k : k + 7]) for x in (h, node, n)], names=["h", "node", "n"])
    got = [x for b in near_copies._sweep(map(cut, range(0, 300, 7))) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    unique = {(int(x), int(y)) for x, y in zip(h, node, strict=True)}
    size = lambda k: k % 9 + 1
    want = [(min(y, z), max(y, z)) for (x, y), (u, z) in itertools.combinations(sorted(unique), 2) if x == u and 5 * min(size(y), size(z)) >= 4 * max(size(y), size(z))]
    assert sorted(x[:2] for x in got) == sorted(want) and all(x[2:] == (size(x[0]), size(x[1])) for x in got)


def test_stage_keeps_rows_with_null_or_repeated_ids(spark):
    import corpus_pipeline

    base = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"]
    near = [x + " more" for x in base]
    rows = [(None, base[0]), (None, base[1]), (None, near[1]), (None, base[1]), (1, base[2]), (None, near[2]), (2, near[2]), (3, base[3]), (3, base[4]), (3, near[3]), (4, near[4]), (4, base[5])]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    got = sorted((repr(r.doc_id), base.index(r.text.removesuffix(" more"))) for r in left)
    assert got == [("1", 2), ("3", 3), ("3", 4), ("4", 5), ("None", 0), ("None", 1)]
