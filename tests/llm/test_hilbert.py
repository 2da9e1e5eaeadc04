from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsight.llm import hilbert
from keepsight.llm.storage import Scratch
from tests.llm.helpers import documents, empty_docs, odd_docs

DIMS = ["lang", "source", "n_chars", "doc_id"]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def laws(rows, n, shards=8):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == n and all(0 <= s < shards for s in by)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_gapless_and_measured(spark):
    docs = documents(spark)
    rows = hilbert.shard_rows(docs, 8, DIMS).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    laws(rows, len(texts))
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 1
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])


def test_runs_are_compact_in_every_dimension(spark):
    rows = hilbert.shard_rows(documents(spark), 8, ["n_chars", "doc_id"])
    ranges = hilbert.file_ranges(rows, ["n_chars", "doc_id"], run_rows=1000).collect()
    n = max(r["max_doc_id"] for r in ranges) + 1
    assert np.mean([(r["max_doc_id"] - r["min_doc_id"]) / n for r in ranges]) < 0.7


def test_text_bins_are_even_whatever_the_values_share(spark):
    """Hosts that differ late, one of them with a third of the rows, and nulls."""
    values = [f"https://host{k % 100:03d}.example.org/" for k in range(4000)] + ["https://host050.example.org/"] * 2000
    docs = spark.createDataFrame([(k, v, "t") for k, v in enumerate(values)] + [(-1, None, "t")], "doc_id bigint, host string, text string")
    scratch, curve = Scratch("test"), hilbert.Curve(bits=4)
    bounds = hilbert.bin_bounds(docs, ["host"], scratch, curve)["host"]
    order = sorted(v.encode() for v in values)
    firsts = {}
    for at, v in reversed(list(enumerate(order))):
        firsts[v] = at
    least = {}
    for v, at in sorted(firsts.items()):
        least.setdefault(at * 16 // len(order), v)
    assert bounds == [v for part, v in sorted(least.items()) if part > 0] and len(bounds) > 9
    rows = hilbert.with_curve(docs, ["host"], curve).collect()
    want = lambda v: 0 if v is None else sum(b <= v.encode() for b in bounds)
    assert all(r["curve"] == want(r["host"]) for r in rows)


def test_shards_match_a_brute_force_order(spark):
    docs = documents(spark)
    rows = hilbert.shard_rows(docs, 8, DIMS).collect()
    bounds = hilbert.bin_bounds(docs, DIMS, Scratch("test"))
    def place(r):
        cell = []
        for d in DIMS:
            v = r[d].encode() if isinstance(r[d], str) else r[d]
            cell.append(0 if v is None else sum(b <= v for b in bounds[d]))
        return int(hilbert.hilbert_index(np.array([cell]), 8)[0])
    order = sorted(docs.collect(), key=lambda r: (place(r), r["doc_id"]))
    n, want = len(order), {}
    for rank, r in enumerate(order):
        shard = rank * 8 // n
        want[r["doc_id"]] = (shard, rank - -(-shard * n // 8))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == want


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = hilbert.shard_rows(docs, 8, DIMS).collect()
    laws(rows, docs.count())
    assert sorted(r["size"] for r in rows)[:3] == [1, 1, 1]
    assert hilbert.shard_rows(empty_docs(spark), 8, DIMS).count() == 0
    assert hilbert.shard_rows(docs.limit(3), 8, DIMS).agg(F.max("slot")).first()[0] == 0
