from __future__ import annotations

import tempfile

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsight.llm.queries import rolled_up
from keepsight.llm.storage import listed
from keepsight.llm.token_rollup import TokenLedger, signed, token_counts
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs

CHANGE = "before struct<source: string, lang: string, tokenizer: string, tokens: bigint>, after struct<source: string, lang: string, tokenizer: string, tokens: bigint>"


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGE)


def totals(ledger):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}


def test_batches_add_up_and_count_once(spark):
    ledger = TokenLedger(spark, tempfile.mkdtemp())
    assert ledger.totals().count() == 0
    first = changes(spark, [(None, ("a", "en", "v1", 10)), (None, ("a", "en", "v1", 5)), (None, ("b", None, "v1", 7))])
    assert ledger.commit("one", first) and not ledger.commit("one", first)
    assert totals(ledger) == {("a", "en", "v1"): (2, 15), ("b", None, "v1"): (1, 7)}
    second = changes(spark, [(("a", "en", "v1", 10), ("a", "en", "v1", 12)), (("b", None, "v1", 7), ("a", "fr", "v2", 8)), (("a", "en", "v1", 5), None)])
    assert ledger.commit("two", second) and not ledger.commit("two", second)
    assert totals(ledger) == {("a", "en", "v1"): (1, 12), ("a", "fr", "v2"): (1, 8)}
    with pytest.raises(ValueError):
        ledger.commit("../x", first)


def test_a_batch_that_was_not_moved_does_not_count_and_can_be_written_again(spark):
    ledger = TokenLedger(spark, tempfile.mkdtemp())
    one = changes(spark, [(None, ("a", "en", "v1", 3))])
    ledger.commit("one", one)
    signed(one).write.parquet(f"{ledger.root}/staged/half")  # the driver died here
    assert totals(ledger) == {("a", "en", "v1"): (1, 3)}
    assert ledger.commit("two", one)
    assert totals(ledger) == {("a", "en", "v1"): (2, 6)}


def test_a_late_writer_changes_nothing(spark, monkeypatch):
    root = tempfile.mkdtemp()
    ledger, late = TokenLedger(spark, root), TokenLedger(spark, root)
    assert ledger.commit("one", changes(spark, [(None, ("a", "en", "v1", 3))]))
    monkeypatch.setattr(late, "committed", lambda batch: False)  # it looked before the first was done
    assert not late.commit("one", changes(spark, [(None, ("a", "en", "v1", 99))]))
    assert totals(late) == {("a", "en", "v1"): (1, 3)}
    assert listed(spark, f"{root}/staged") == []


@pytest.mark.parametrize("every", [1, 3, 100])
def test_snapshots_and_later_deltas_make_the_totals(spark, every):
    ledger = TokenLedger(spark, tempfile.mkdtemp(), compact_every=every)
    want = {}
    for k in range(5):
        group = (None if k % 2 else "a", "en", "v1")
        assert ledger.commit(f"b{k}", changes(spark, [(None, (*group, k)), (None, (*group, k))]))
        n, tokens = want.get(group, (0, 0))
        want[group] = (n + 2, tokens + 2 * k)
        assert totals(ledger) == want
    assert not ledger.commit("b1", changes(spark, [(None, ("a", "en", "v1", 5))]))
    assert len(listed(spark, f"{ledger.root}/snapshots")) == 5 // every
    path, held = ledger._snapshot()
    assert len(held) == 5 - 5 % every and (path is None) == (every == 100)
    assert TokenLedger(spark, ledger.root).commit("undo", changes(spark, [(("a", "en", "v1", 0), None)]))
    n, tokens = want["a", "en", "v1"]
    assert totals(ledger)["a", "en", "v1"] == (n - 1, tokens)


def test_query_counts_each_distinct_text_once(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.unionByName(odd_docs(spark).select(*docs.columns)).unionByName(docs.limit(7))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first, want = {}, {}
    for r in odd.collect():
        no = lambda x: (x is not None, x or "")
        key = object() if r["text"] is None else r["text"]
        place = (r["doc_id"] is None, r["doc_id"] or 0, no(r["source"]), no(r["lang"]))
        if key not in first or place < first[key][0]:
            first[key] = place, r
    for _, r in first.values():
        n, tokens = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n + 1, tokens + len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids))
    found = rolled_up(spark, odd).collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in found if r["tokenizer"] == "byte_bpe_50k"} == want
    assert len(found) == 2 * len(want)
    four = docs_of(spark, ["one two", "one two"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = rolled_up(spark, four.unionAll(four)).collect()
    assert [r["n_docs"] for r in rows] == [1, 1]
    assert rolled_up(spark, empty_docs(spark)).count() == 0


def test_counts_equal_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts(docs, {"v": "byte_bpe_50k.tiktoken"}).collect():
        assert r["counts"]["v"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = token_counts(docs, {"v": "byte_bpe_50k.tiktoken"})
    assert rows.count() == docs.count()
    assert all(r["counts"]["v"] == 0 for r in rows.collect() if r["doc_id"] in (1, 2))
    assert token_counts(empty_docs(spark), {"v": "byte_bpe_50k.tiktoken"}).count() == 0
    assert signed(changes(spark, [(None, None), (None, (None, None, None, None))])).first()["n_tokens"] == 0
    assert signed(changes(spark, []).select("*", F.lit(1).alias("sign"))).count() == 0
