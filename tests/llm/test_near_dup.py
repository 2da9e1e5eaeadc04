from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from keepsight.llm.near_dup import NearDup, distinct_documents, near_duplicates
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs


def brute(texts, size, threshold):
    """doc -> (set size, component) by comparing every pair that shares a shingle."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        runs = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        sets[i] = runs if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in holds[x])
        for j, n in shared.items():
            if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for x in sets[i]:
            holds[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,threshold", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, size, threshold):
    docs = documents(spark)
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()}, size, threshold)
    rows = near_duplicates(docs, NearDup(shingle=size, threshold=threshold)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_chains_families_and_blocks(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(6):  # families with one changed word after another, so chains arise
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(40):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.choice([1, 1, 2, 4])):
                base[rng.randrange(80)] = rng.choice(words)
    rng.shuffle(texts)
    docs = docs_of(spark, texts)
    want = brute(dict(enumerate(texts)), 3, 85)
    rows = near_duplicates(docs, NearDup(shingle=3, threshold=85, block=4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_one_family_of_thousands(spark):
    """Near copies around the threshold: many are no neighbours of a given hub, none may be lost."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(5000):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            words[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"d{k}-{j}" for j in range(60)) for k in range(500)]
    how = NearDup(shingle=3, threshold=85)
    rows = near_duplicates(docs_of(spark, texts), how).collect()
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    often = Counter(x for s in sets for x in s)
    place = {x: k for k, x in enumerate(x for x, n in often.items() if n > 1)}
    holds = np.zeros((len(sets), len(place)), np.float32)
    for k, s in enumerate(sets):
        holds[k, [place[x] for x in s if x in place]] = 1
    both, size = holds @ holds.T, np.array([len(s) for s in sets])
    near = 100 * both >= 85 * (size[:, None] + size - both)
    comp, before = np.arange(len(sets)), None
    while before is None or (comp != before).any():  # the least neighbour's component, until nothing changes
        before, comp = comp, np.where(near, comp, len(sets)).min(1).clip(max=comp)
    assert [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == comp.tolist()


def test_least_matches_grow_and_spare_true_pairs():
    how = NearDup(threshold=85)
    steps = how.least_matches
    assert steps[-1][0] == how.hashes and all(m < 0.85 * n for n, m in steps)
    assert [m for _, m in steps] == sorted(m for _, m in steps)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["n_shingles"] == 0 and r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert [r["kept"] for r in rows if r["doc_id"] == 4] == [True, True]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert near_duplicates(empty_docs(spark)).count() == 0
    left = distinct_documents(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
