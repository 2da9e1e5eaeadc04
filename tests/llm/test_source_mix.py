from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from keepsight.llm.source_mix import Mix, mixed
from tests.llm.helpers import DOCS, documents, empty_docs, odd_docs


def targets_of(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source -> target, by handing what is over to the others until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest / free * weight[s] for s in names}
        over = {s for s in names if target[s] > most * sizes[s]} - full
        if not over:
            return target
        full |= over


def docs_from(spark, sizes):
    rows = [(k, "w " * n, "en", s, 2 * n) for k, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, DOCS)


def mix(docs, how=Mix()):
    rows, pieces = mixed(docs, how)
    return rows.collect(), pieces.collect()


@pytest.mark.parametrize("block", [1, 16, 256])
def test_targets_and_pieces(spark, block):
    rng = random.Random(block)
    names = ["b", "a", None, "é", "Z", "tiny", "none"]
    sizes = [(s, rng.randrange(90)) for s in rng.choices(names[:5], [50, 5, 5, 2, 1], k=400)]
    sizes += [("tiny", 1), ("none", 0)]
    rows, pieces = mix(docs_from(spark, sizes), Mix(block=block))
    total = Counter()
    for s, n in sizes:
        total[s] += n
    want = targets_of(total)
    by_row = {r["row"]: r for r in rows}
    assert len(by_row) == len(rows) == len(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == total[r["source"]] and r["size"] == sizes[r["doc_id"]][1]
    taken, by_source = Counter(), Counter()
    for p in pieces:
        r = by_row[p["row"]]
        assert 0 <= p["start"] and p["start"] + p["length"] <= r["size"] and p["length"] > 0
        taken[p["row"]] += p["length"]
        by_source[r["source"]] += p["length"]
    assert all(taken[k] <= 2 * r["size"] for k, r in by_row.items())
    assert all(abs(by_source[s] - want[s]) <= 0.5 for s in total)
    # a slot holds one source's words, one after another, and slots are whole but for each source's last
    slots = defaultdict(list)
    for p in pieces:
        slots[p["slot"]].append(p)
    assert sorted(slots) == list(range(len(slots)))
    short = Counter()
    for held in slots.values():
        assert len({by_row[p["row"]]["source"] for p in held}) == 1
        at = 0
        for p in sorted(held, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        short[by_row[held[0]["row"]]["source"]] += at < block
    assert all(n <= 1 for n in short.values())
    # every stretch of the mix holds each source in nearly its share
    run = Counter()
    share = Counter(by_row[held[0]["row"]]["source"] for held in slots.values())
    for k in sorted(slots):
        run[by_row[slots[k][0]["row"]]["source"]] += 1
        assert all(abs(run[s] - share[s] * (k + 1) / len(slots)) < 6 for s in share)


def test_reruns_and_other_partitions_agree(spark):
    docs = documents(spark)
    key = lambda rows: sorted((r["doc_id"], r["size"], r["target"]) for r in rows)
    one, other = mix(docs), mix(docs.repartition(7))
    assert key(one[0]) == key(other[0])
    ids = [{r["row"]: r["doc_id"] for r in rows} for rows, _ in (one, other)]
    pieces = [
        sorted((p["slot"], p["offset"], names[p["row"]], p["start"], p["length"]) for p in found)
        for names, (_, found) in zip(ids, (one, other))
    ]
    assert pieces[0] == pieces[1]


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "'x' AS at", "'x' AS slot", "'x' AS none", "'x' AS target")
    rows, pieces = mix(docs)
    assert len(rows) == docs.count()
    assert sorted(r["size"] for r in rows)[:4] == [0, 0, 0, 0]
    size = {r["row"]: r["size"] for r in rows}
    taken = Counter()
    for p in pieces:
        taken[p["row"]] += p["length"]
    assert all(taken[k] <= 2 * n for k, n in size.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=2)
    assert mix(empty_docs(spark)) == ([], [])
    blank = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "s", 1)], DOCS)
    rows, pieces = mix(blank)
    assert [r["target"] for r in rows] == [0.0, 0.0] and pieces == []
