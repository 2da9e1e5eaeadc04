from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from keepsight.llm.bag_search import Search, search
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id bigint, text string"


def brute(docs, items, top=10):
    """(item, rank) -> (doc_id, score) with every row scored by itself."""
    bags = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    words = {}
    for i, t in items:
        words.setdefault(i, set()).update(TERM.findall((t or "").translate(UPPER)))
    out = {}
    for item, terms in words.items():
        found = []
        for doc, bag in bags:
            score = 0
            for w in terms & bag.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                m = 10 + (90 * bag.total() * n_docs) // length
                score += weight * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc, ))
        for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out[item, rank] = (doc, -score)
    return out


def rows_of(found):
    return {(r["item"], r["rank"]): (r["doc_id"], r["score"]) for r in found.collect()}


@pytest.mark.parametrize("postings", [1 << 17, 40])
def test_results_match_brute_force(spark, postings):
    rng = random.Random(postings)
    words = ["Alpha", "beta", "gamma7", "delta", "épée", "ÉPÉE", "x", "the", "of", "zeta"]
    texts = ["; ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(300)]
    items = [(k, " ".join(rng.choices(words + ["absent"], k=rng.randrange(1, 7)))) for k in range(30)]
    docs, table = docs_of(spark, texts), spark.createDataFrame(items, ITEMS)
    found = search(docs, table, Search(top=4, postings=postings))
    assert rows_of(found) == brute(list(enumerate(texts)), items, 4)


def test_table_matches_brute_force(spark):
    docs = documents(spark)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    found = search(docs, spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_a_hot_class_gives_its_first_members(spark):
    docs = docs_of(spark, ["same words here"] * 500 + ["other words"])
    found = rows_of(search(docs, spark.createDataFrame([(1, "same here")], ITEMS)))
    assert [found[1, k][0] for k in range(1, 11)] == list(range(10))


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (None, "ONE words"), (3, "word5 part7"), (3, "no"), (4, "...")]
    docs, table = odd_docs(spark), spark.createDataFrame(items, ITEMS)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert rows_of(search(docs, table)) == want
    assert search(empty_docs(spark), table).count() == 0
    assert search(docs, table.limit(0)).count() == 0


def test_a_text_longer_than_a_piece_adds_up(spark):
    long = "needle " + "hay stack " * 120_000 + "needle " + "y" * 600_000 + " needle"
    docs = [(0, long), (1, "needle"), (2, "hay")]
    items = [(1, "needle"), (2, "stack hay")]
    found = search(docs_of(spark, [t for _, t in docs]), spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute(docs, items)
