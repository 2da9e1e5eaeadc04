from __future__ import annotations

import itertools
import random

import numpy as np

from keepsight.llm.spaced_seeds import Seeds, contamination, decontaminated, longest_agreement, overlaps
from tests.conftest import SF_DIR
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs


def brute(doc, item, least=13, percent=80):
    d, t = doc.lower().split(), item.lower().split()
    need = min(least, len(t))
    for shift in range(-len(t) + 1, len(d)):
        low, high = max(0, -shift), min(len(t), len(d) - shift)
        if high - low >= need:
            equal = np.array([d[i + shift] == t[i] for i in range(low, high)])
            if equal.sum() and longest_agreement(equal, percent)[1] >= need:
                return True
    return False


def test_longest_agreement_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.random(rng.integers(1, 40)) < rng.random()
        want = max((j - i for i, j in itertools.combinations(range(len(x) + 1), 2) if x[i:j].mean() >= 0.8), default=0)
        at, n = longest_agreement(x, 80)
        assert n == want and (not n or x[at : at + n].mean() >= 0.8)


def test_changed_passages_are_found_and_other_texts_are_not(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(800)]
    items = [[rng.choice(words) for _ in range(rng.choice([15, 20, 40]))] for _ in range(30)]
    texts, want = [], []
    for k in range(120):
        body = [rng.choice(words) for _ in range(60)]
        if k % 2:
            passage = list(rng.choice(items))
            for at in rng.sample(range(len(passage)), len(passage) // 5):
                passage[at] = "changed"
            body[30:30] = passage
        texts.append(" ".join(body).upper() if k % 3 else " ".join(body))
        want.append(bool(k % 2))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    rows = {r["doc_id"]: r["contaminated"] for r in contamination(docs_of(spark, texts), table).collect()}
    assert [rows[k] for k in range(120)] == want


def test_given_tables_match_brute_force(spark):
    docs = documents(spark)
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in contamination(docs, items).collect()}
    benchmark = {r["item_id"]: r["text"] for r in items.collect()}
    for r in docs.collect():
        low = set(r["text"].lower().split())
        near = [i for i, t in benchmark.items() if len(low & set(t.lower().split())) >= 5]
        found = [i for i in near if brute(r["text"], benchmark[i])]
        assert rows[r["doc_id"]]["item_ids"] == sorted(found), r["doc_id"]
    assert any(r["contaminated"] for r in rows.values())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "too short"), (None, "no id here but a few words"), (4, "no id here but a few words")],
        "item_id bigint, text string",
    )
    rows = contamination(docs, items).collect()
    assert len(rows) == docs.count() and not any(r["contaminated"] for r in rows)
    assert overlaps(docs, items).count() == 2  # found, though the row has no id to report
    assert contamination(empty_docs(spark), items).count() == 0
    assert not any(r["contaminated"] for r in contamination(docs, items.limit(0)).collect())
    left = decontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert Seeds().shortest == 7


def test_items_shorter_than_a_mask_are_found_whole(spark):
    items = ["capital is paris of france", "one", "a b c d e f", "never there at all", "", "seven words are enough for a mask"]
    texts = [
        "we know the Capital is Paris of\nFrance today", "capital is paris of", "of france capital is paris", "x a b c d e f",
        "a b c d e g f", "one", "ones", "say one and one", "never there at", "", "so seven words are enough for a mask here",
        " ".join(["pad"] * 300 + ["capital is paris of france"] + ["pad"] * 300),
    ]
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"], r["start"], r["length"]) for r in overlaps(docs_of(spark, texts), table).collect()}
    want = set()
    for d, text in enumerate(texts):
        words = text.lower().split()
        for i, item in enumerate(items):
            own = item.split()
            want |= {(d, i, k, len(own)) for k in range(len(words) - len(own) + 1) if own and words[k : k + len(own)] == own}
    assert found == want and len(found) == 7
