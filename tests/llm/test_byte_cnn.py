from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from keepsight.llm import byte_cnn as c
from tests.llm.helpers import DOCS, documents, empty_docs, odd_docs

def held():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2



def test_held_out_accuracy(spark):
    docs = documents(spark)
    rows = c.identify(docs, ~held()).join(docs.select("doc_id", "lang", held().alias("held")), "doc_id")
    rows = rows.filter("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_windows_cover_whole_texts():
    data = np.frombuffer(b"abc" * 200 + b"" + b"xyz", np.uint8)
    rows, counts = c.windows_of(data, np.array([0, 600, 600, 603]), 256)
    assert counts.tolist() == [3, 1, 1]
    assert (rows > 0).sum() == 603 and rows[4, :3].tolist() == [24, 25, 26]


def test_gradients_match_differences():
    config = c.Config(widths=(2, 4), filters=3, window=12)
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abcdef "), 30).tolist()) for _ in range(6)]
    net = c.train(texts, ["p", "q"] * 3, c.Config(widths=(2, 4), filters=3, window=12, epochs=1))
    net = c.Network(config, net.languages, [w.astype(float) for w in net.weights], net.dense.astype(float), net.bias.astype(float))
    x, _ = c.windows_of(np.frombuffer(texts[0], np.uint8), np.array([0, 30]), 12)
    y = np.array([0, 1, 1])
    loss = lambda: -c.log_probabilities(net, net.pairs(), x)[np.arange(3), y].mean()
    for value, grad in zip([*net.weights, net.dense, net.bias], c._gradients(net, x, y)):
        for at in [tuple(rng.integers(s) for s in value.shape) for _ in range(15)] + [np.unravel_index(np.abs(grad).argmax(), grad.shape)]:
            before, eps = value[at], 1e-6
            value[at] = before + eps
            up = loss()
            value[at] = before - eps
            down = loss()
            value[at] = before
            assert abs((up - down) / (2 * eps) - grad[at]) < 1e-4


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = c.identify(docs, F.lit(True), config=c.Config(epochs=1)).collect()
    assert len(rows) == docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] in ("en", "fr") for r in rows if r["doc_id"] in (4, 5, 6))
    assert c.identify(empty_docs(spark), F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "text", None, None, 4)], DOCS)
    assert c.identify(one, F.lit(True)).first()["lang_pred"] == "und"
