from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepsight.llm import cross_entropy as ce
from keepsight.llm import packed_counts as pc
from keepsight.llm.cross_entropy import Shape, cross_entropy_difference
from keepsight.llm.words import PIECE, word_hashes
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs


def ids(spark, numbers):
    return spark.createDataFrame([(i,) for i in numbers], "doc_id bigint")


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]))[0][0])


def brute(texts, target, shape):
    """Losses by plain dictionaries: vocabulary, counts without the text itself, thinning by the key's hash."""
    split = [(t or "").lower().split() for t in texts]
    seen = Counter(w for t in split for w in t)
    vocabulary = sorted(hashed(w) for w, n in seen.items() if n > 1)
    number = {h: i + ce.KNOWN for i, h in enumerate(vocabulary)}
    size = len(vocabulary) + ce.KNOWN
    coded = [[number.get(hashed(w), ce.UNKNOWN) for w in t] for t in split]
    pairs = [Counter(zip([ce.BEGIN, *t], t)) for t in coded]
    words = [Counter(t) for t in coded]
    add = lambda counters: sum(counters, Counter())
    all_pairs = Counter({p: n for p, n in add(pairs).items() if n > 1})
    all_words = Counter({w: n for w, n in add(words).items() if n > 1})
    good_pairs = Counter({p: n for p, n in add([pairs[i] for i in target]).items() if p in all_pairs})
    good_words = Counter({w: n for w, n in add([words[i] for i in target]).items() if w in all_words})
    total, good = sum(all_words.values()), sum(good_words.values())
    share = good / total
    base = [(all_words[w] + 1) / (total + size) for w in range(size)]
    thin = lambda n, key: float(ce.thinned(np.array([n]), np.array([key]), share)[0])

    def loss(pair, of_h, of_w, n, w):
        p = (of_w + shape.word_weight * base[w]) / (n + shape.word_weight)
        return -math.log((pair + shape.pair_weight * p) / (of_h + shape.pair_weight))

    of_context, good_context = Counter(), Counter()
    for (h, w), n in all_pairs.items():
        of_context[h] += thin(n, h * size + w)
        good_context[h] += good_pairs[h, w]
    out = []
    for i, t in enumerate(coded):
        own_context = Counter()
        for (h, w), n in pairs[i].items():
            own_context[h] += n * ((h, w) in all_pairs)
        losses = [0.0, 0.0]
        for (h, w), n in pairs[i].items():
            own = n * ((h, w) in all_pairs)
            if i in target:
                c = good_pairs[h, w] - own
                args = c, max(good_context[h] - own_context[h], c), max(good_words[w] - words[i][w], 0), max(good - len(t), 0)
            else:
                args = good_pairs[h, w], good_context[h], good_words[w], good
            losses[0] += n * loss(*args, w)
            c = thin(max(all_pairs[h, w] - own, 0), h * size + w)
            of_h = max(of_context[h] - share * own_context[h], c)
            of_w = thin(max(all_words[w] - words[i][w], 0), size * size + w)
            losses[1] += n * loss(c, of_h, of_w, share * max(total - len(t), 0), w)
        out.append([x / len(t) for x in losses] if t else [None, None])
    return out


def test_losses_match_plain_counts(spark):
    texts = [
        "the cat sat on the mat", "The dog sat", "", None, "mat mat mat", "an unseen story of a dog", "the dog sat on the dog",
        "a story the cat sat on", "the cat sat on the mat", "mat mat dog the dog",
    ]
    for target in ([6, 7], [0, 1, 4, 6, 7, 8, 9], [3]):
        rows = cross_entropy_difference(docs_of(spark, texts), ids(spark, target)).orderBy("doc_id").collect()
        for r, want in zip(rows, brute(texts, target, Shape()), strict=True):
            assert r["in_target"] == (r["doc_id"] in target)
            for x, y in zip((r["target_loss"], r["background_loss"]), want):
                assert (x is None and y is None) or abs(x - y) < 1e-9
            assert r["score"] is None or abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-9


@pytest.mark.parametrize("chunk", [1, 12, 60])
def test_losses_do_not_depend_on_chunks(spark, chunk):
    texts = one_distribution(40, 12, 3) + ["", None, "w1", "w0 w0 w0 w0 unseen"]
    target = list(range(0, len(texts), 3))
    rows = cross_entropy_difference(docs_of(spark, texts).coalesce(2), ids(spark, target), shape=Shape(chunk=chunk))
    for r, want in zip(rows.orderBy("doc_id").collect(), brute(texts, target, Shape()), strict=True):
        assert r["in_target"] == (r["doc_id"] in target)
        for x, y in zip((r["target_loss"], r["background_loss"]), want):
            assert (x is None and y is None) or abs(x - y) < 1e-9


def test_words_and_pairs_have_no_bound(spark):
    """140,000 words and as many pairs, each in two documents: none is the more frequent, none may be left out."""
    length, n, good = 500, 280, 20
    texts = [" ".join(f"w{k}" for k in range(i * length, (i + 1) * length)) for i in range(n)] * 2
    target = [*range(good), *range(n, n + good)]
    rows = cross_entropy_difference(docs_of(spark, texts), ids(spark, target)).collect()
    shape, base = Shape(), 3 / (2 * n * length + n * length + ce.KNOWN)

    def loss(pair, first, word, others):
        share = (word + shape.word_weight * base) / (others + shape.word_weight)
        each = [-math.log((pair + shape.pair_weight * share) / (h + shape.pair_weight)) for h in (first, pair)]
        return (each[0] + (length - 1) * each[1]) / length

    inside = loss(1, 2 * good - 1, 1, (2 * good - 1) * length)
    outside = loss(0, 2 * good, 0, 2 * good * length)
    assert len(rows) == 2 * n
    for r in rows:
        assert abs(r["target_loss"] - (inside if r["in_target"] else outside)) < 1e-9


def one_distribution(n, length, seed):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, 801)
    drawn = rng.choice(800, (n, length), p=chance / chance.sum())
    return [" ".join(f"w{k}" for k in row) for row in drawn]


def test_one_distribution_scores_alike_in_and_out_of_the_target(spark):
    texts = one_distribution(200, 150, 5)
    rows = cross_entropy_difference(docs_of(spark, texts), ids(spark, range(20))).collect()
    mean = {side: np.mean([r["score"] for r in rows if r["in_target"] == side]) for side in (True, False)}
    assert abs(mean[True]) < 0.25 and abs(mean[False]) < 0.25 and abs(mean[True] - mean[False]) < 0.15


def test_documents_that_occur_twice_stand_apart(spark):
    texts = one_distribution(120, 150, 9)
    texts += texts[60:80]
    rows = cross_entropy_difference(docs_of(spark, texts), ids(spark, range(60))).collect()
    twice = [r["score"] for r in rows if r["doc_id"] >= 60 and r["doc_id"] not in range(80, 120)]
    once = [r["score"] for r in rows if r["doc_id"] in range(80, 120)]
    assert min(twice) > max(once)


def test_target_language_scores_lowest(spark):
    docs = documents(spark)
    rows = cross_entropy_difference(docs, docs.filter("lang = 'de'")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    means = {x: [r["score"] for r in rows if r["lang"] == x] for x in ("de", "en")}
    assert sum(means["de"]) / len(means["de"]) < sum(means["en"]) / len(means["en"])


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumns({c: F.lit("x") for c in ("in_target", "outside", "inside", "place", "n", "block", "_place")})
    rows = cross_entropy_difference(docs, docs).collect()
    assert len(rows) == docs.count()
    assert all(r["score"] is None for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in rows if r["doc_id"] in (4, 5, 6))
    assert all(r["in_target"] == (r["doc_id"] is not None) for r in rows)
    assert cross_entropy_difference(empty_docs(spark), docs).count() == 0
    alone = cross_entropy_difference(docs, empty_docs(spark)).collect()
    assert len(alone) == docs.count()
    assert all(abs(r["score"]) < 1e-9 for r in alone if r["score"] is not None)


def test_a_text_longer_than_a_piece_is_numbered_whole():
    words = [f"w{k % 503}" for k in range(PIECE // 2)]
    texts = ["w1 w2", " ".join(words), "w3", "", " ".join(words[:7])]
    vocabulary = np.sort(np.array([hashed(w) for w in sorted(set(words[:400]))], np.uint64))
    column = pa.array(texts)
    found = {}
    for base, numbers, first in ce.numbered(column, vocabulary):
        for k in range(len(first) - 1):
            assert base + k not in found
            found[base + k] = numbers[first[k] : first[k + 1]].tolist()
    place = {int(h): i + ce.KNOWN for i, h in enumerate(vocabulary)}
    assert [found[k] for k in range(5)] == [[place.get(hashed(w), ce.UNKNOWN) for w in t.split()] for t in texts]


@pytest.mark.parametrize("limit", [0, 7, 40, 1000])
def test_counts_are_exact_and_levels_whole(spark, limit):
    rng = np.random.default_rng(3)
    numbers = (rng.zipf(1.4, 5000) % 300).astype(int).tolist()
    rows = spark.createDataFrame([(k,) for k in numbers], "k bigint").repartition(5)

    def keys(batches):
        for batch in batches:
            yield batch.column(0).to_numpy().astype(np.uint64)

    table = pc.totals(pc.count_table(rows, keys, 300).unionAll(pc.count_table(rows.filter("k % 2 = 0"), keys, 300, second=True)), 300)
    want = {k: n for k, n in Counter(numbers).items() if n > 1}
    found = pc.most_frequent(table, limit)
    assert dict(zip(found[0].tolist(), found[1].tolist())) == {k: want[k] for k in found[0].tolist()}
    assert all(b == (n if k % 2 == 0 else 0) for k, n, b in zip(*(x.tolist() for x in found)))
    assert len(found[0]) <= limit
    levels = lambda ks: {int(pc.level(np.array([want[k]]))[0]) for k in ks}
    kept = set(found[0].tolist())
    assert not levels(kept) & levels(set(want) - kept)
    if limit >= len(want):
        assert kept == set(want)
