from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keepsight.llm import supervision as s
from tests.conftest import SF_DIR
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if seen[run] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    texts = ["a b c d e a b c d e f", "x x x x x x x x x x", "a\x1cb c\xa0d", "l\nl\n \n\nl ", "é # $$ ï\x0b\x0cq", "1 2 3 4"]
    docs = documents(spark).select("doc_id", "text").union(docs_of(spark, texts).select(F.col("doc_id") + 10**6, "text"))
    docs = docs.union(odd_docs(spark).select("doc_id", "text"))
    for r in s.measured(docs.withColumn("copy", F.col("text"))).collect():
        m = r["measures"]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(r["copy"]), r["doc_id"]


def test_verdicts_follow_the_labels_nobody_showed(spark):
    rows = s.judged(documents(spark)).withColumnRenamed("quality", "posterior")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = rows.join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_em_finds_the_accuracies_of_made_up_votes(spark):
    rules = ["a", "b", "c", "d"]
    good = F.rand(1) < 0.8
    rows = spark.range(40_000).withColumn("good", good)
    for k, r in enumerate(rules):
        right = F.rand(10 + k) < 0.9 - 0.05 * k
        rows = rows.withColumn(r, F.when(F.rand(20 + k) < 0.3, 0).when(F.col("good") == right, 1).otherwise(-1))
    model = s.fit(s.vote_patterns(rows, {r: F.col(r) for r in rules}), rules)
    assert abs(model.prior - 0.8) < 0.04
    for k, r in enumerate(rules):
        assert abs(model.accuracy(r)[0] - (0.9 - 0.05 * k)) < 0.05


def numpy_em(votes, n, rounds=40, tolerance=1e-4):
    """The same model fitted with arrays: share of good texts, chances, and each pattern's posterior."""
    start = (s.PRIOR, np.tile(s.ON_GOOD, (votes.shape[1], 1)), np.tile(s.ON_BAD, (votes.shape[1], 1)))
    model, weight, total = start, n.sum() * s.PSEUDO, n.sum()

    def likelihoods(model):
        sides = []
        for share, on in ((model[0], model[1]), (1 - model[0], model[2])):
            chance = np.where(votes == -1, on[:, 0], np.where(votes == 1, on[:, 1], 1 - on.sum(1)))
            sides.append(share * chance.prod(1))
        return sides

    def objective(model):
        out = (n * np.log(sum(likelihoods(model)))).sum()
        for share, on, first in ((model[0], model[1], start[1]), (1 - model[0], model[2], start[2])):
            first = np.column_stack([first, 1 - first.sum(1)])
            out += weight * (first * np.log(np.column_stack([on, 1 - on.sum(1)]))).sum()
        return out + weight * (s.PRIOR * np.log(model[0]) + (1 - s.PRIOR) * np.log(1 - model[0]))

    climb = [objective(model)]
    for _ in range(rounds):
        good, bad = likelihoods(model)
        p = good / (good + bad)
        new = [((p * n).sum() + s.PRIOR * weight) / (total + weight)]
        for mass, first in ((p * n, start[1]), ((1 - p) * n, start[2])):
            each = np.column_stack([((votes == v) * mass[:, None]).sum(0) for v in (-1, 1)])
            new.append((each + weight * first) / (mass.sum() + weight))
        moved = max(np.abs(new[k] - model[k]).max() for k in (1, 2))
        model = tuple(new)
        climb.append(objective(model))
        if moved < tolerance:
            break
    good, bad = likelihoods(model)
    return model, good / (good + bad), climb


def test_a_rule_worse_than_chance_is_turned_round(spark):
    rng = np.random.default_rng(3)
    good = rng.random(40_000) < 0.5
    votes = np.column_stack([np.where(rng.random(len(good)) < r, good, ~good) * 2 - 1 for r in (0.85, 0.8, 0.25)])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    table = spark.createDataFrame([(*map(int, v), int(k)) for v, k in zip(patterns, n)], "a int, b int, c int, n bigint").coalesce(1)
    model = s.fit(table, ["a", "b", "c"])
    want, _, climb = numpy_em(patterns, n)
    assert abs(model.prior - 0.5) < 0.02 and abs(model.prior - want[0]) < 1e-6
    assert model.weights("c")[0] > 0 > model.weights("c")[2]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(climb, climb[1:]))


def test_kept_equals_em_with_arrays(spark):
    rows = s.judged(documents(spark))
    votes = s.default_rules(F.col("measures"))
    rows = rows.select("kept", "base_failed", "quality", *[v.alias(k) for k, v in votes.items()]).collect()
    found = np.array([[r[k] for k in votes] for r in rows])
    patterns, which, n = np.unique(found, axis=0, return_inverse=True, return_counts=True)
    _, quality, climb = numpy_em(patterns, n)
    for r, q in zip(rows, quality[which.ravel()]):
        assert abs(r["quality"] - q) < 1e-6
        assert r["kept"] == (not r["base_failed"] and q >= 0.5)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(climb, climb[1:]))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = s.judged(docs).collect()
    assert len(rows) == docs.count()
    assert not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 5, 6, None))
    assert s.judged(empty_docs(spark)).count() == 0
    kept = s.good_documents(docs)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_plan_has_no_python(spark):
    plan = s.judged(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
