"""Language identification by a convolutional network over bytes, in numpy.

A window of fixed length is a row of byte classes. Filters of several widths slide over
it, each filter's greatest response is kept, and a softmax layer turns these into language
probabilities. A text's windows vote with their log-probabilities, so all of it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.llm.words import pieces, utf8

# classes: 0 for everything that is not a letter, then a-z, then the bytes beyond ASCII
CLASS = np.zeros(256, np.int64)
CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)
N_CLASSES = 155


@dataclass(frozen=True)
class Config:
    """The network and its training. The sample has at most ``per_language`` texts of a
    language, and of all their windows at most ``windows`` a language, by hash."""

    widths: tuple[int, ...] = (2, 4, 6)
    filters: int = 8
    window: int = 256
    per_language: int = 300
    windows: int = 4096
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    seed: int = 7


@dataclass
class Network:
    config: Config
    languages: list[str]
    weights: list[np.ndarray]  # for each width: (width, classes, filters)
    dense: np.ndarray
    bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width, tables of the joint response to every pair of neighbouring classes."""
        return [
            [(w[j][:, None] + w[j + 1][None]).reshape(-1, self.config.filters) for j in range(0, len(w), 2)]
            for w in self.weights
        ]


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of classes, the last of a text filled up with 0, and
    the number of windows of each text (an empty one has one)."""
    lengths = np.diff(offsets)
    counts = np.maximum(-(-lengths // size), 1)
    out = np.zeros((int(counts.sum()), size), np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    base = (np.cumsum(counts) - counts) * size
    out.ravel()[np.arange(len(data)) - offsets[:-1][text] + base[text]] = CLASS[data]
    return out, counts


def log_probabilities(net: Network, tables, rows: np.ndarray) -> np.ndarray:
    """Log-probability of each language for each window."""
    pair = rows[:, :-1] * N_CLASSES + rows[:, 1:]
    pooled = []
    for width, parts in zip(net.config.widths, tables):
        n = rows.shape[1] - width + 1
        response = parts[0][pair[:, :n]]
        for j, part in enumerate(parts[1:], 1):
            response += part[pair[:, 2 * j : 2 * j + n]]
        pooled.append(response.max(1))
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.dense + net.bias
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(texts: list[bytes], labels: list[str], config: Config = Config()) -> Network:
    """Adam on windows of the texts, some cut short; the same sample gives the same network."""
    rng = np.random.default_rng(config.seed)
    languages = sorted(set(labels))
    weights = [rng.normal(0, 0.3, (w, N_CLASSES, config.filters)).astype(np.float32) for w in config.widths]
    total = config.filters * len(config.widths)
    dense = rng.normal(0, 0.3, (total, len(languages))).astype(np.float32)
    net = Network(config, languages, weights, dense, np.zeros(len(languages), np.float32))
    number = {x: k for k, x in enumerate(languages)}
    rows, target = [], []
    for text, label in zip(texts, labels):
        data = np.frombuffer(text, np.uint8)
        found, _ = windows_of(data, np.array([0, len(data)]), config.window)
        rows.append(found)
        target += [number[label]] * len(found)
    if not rows:
        return net
    rows, target = np.concatenate(rows), np.array(target)
    values = [*weights, dense, net.bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(config.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), config.batch):
            chosen = order[at : at + config.batch]
            x, y = rows[chosen].copy(), target[chosen]
            short = rng.random(len(x)) < 0.3  # so that short texts are known too
            for k in np.flatnonzero(short):
                x[k, rng.integers(min(16, config.window // 2), config.window) :] = 0
            step += 1
            for v, g, a, b in zip(values, _gradients(net, x, y), first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= config.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean loss. Only the place of a filter's greatest response has a share in it."""
    filters, pooled, places = net.config.filters, [], []
    for w, width in zip(net.weights, net.config.widths):
        n = x.shape[1] - width + 1
        response = w[0][x[:, :n]]
        for j in range(1, width):
            response = response + w[j][x[:, j : j + n]]
        places.append(response.argmax(1))
        pooled.append(response.max(1))
    features = np.concatenate(pooled, 1)
    active = np.maximum(features, 0)
    logits = active @ net.dense + net.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.dense.T) * (features > 0)
    out, row = [], np.arange(len(x))[:, None]
    for k, (w, width) in enumerate(zip(net.weights, net.config.widths)):
        share, grad = back[:, k * filters : (k + 1) * filters], np.zeros_like(w)
        for j in range(width):
            np.add.at(grad[j], (x[row, places[k] + j], np.arange(filters)[None]), share)
        out.append(grad)
    return [*out, active.T @ p, p.sum(0)]


def training_sample(docs: DataFrame, allowed: Column, text_col: str, lang_col: str, config: Config) -> DataFrame:
    """``lang, window`` of a bounded sample: for each language, windows of least hash from
    all places of the whole texts of least hash."""
    rows = docs.filter(allowed).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.filter(F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    order = Window.partitionBy("lang").orderBy("_hash")
    hashes = rows.select("lang", "_hash").distinct().withColumn("_n", F.row_number().over(order))
    chosen = hashes.filter(F.col("_n") <= config.per_language).select("lang", "_hash")
    data, size = F.col("_text").cast("binary"), config.window
    starts = F.sequence(F.lit(0), F.octet_length("_text") - 1, F.lit(size))
    cut = rows.join(chosen, ["lang", "_hash"]).dropDuplicates(["lang", "_hash"])
    cut = cut.select("lang", "_hash", data.alias("_data"), F.posexplode(starts).alias("_at", "_start"))
    cut = cut.select("lang", "_hash", "_at", F.substring("_data", F.col("_start") + 1, F.lit(size)).alias("window"))
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("_hash", "_at"), "_hash", "_at")
    cut = cut.withColumn("_n", F.row_number().over(drawn)).filter(F.col("_n") <= config.windows)
    return cut.orderBy("lang", "_n").select("lang", "window")


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` and 0 where a text has no letter."""
    size, names = net.config.window, [*net.languages, "und"]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                rows, counts = windows_of(part, own, size)
                logs = np.concatenate(
                    [log_probabilities(net, tables, rows[k : k + 256]) for k in range(0, len(rows), 256)]
                )
                letters = (rows > 0).sum(1)[:, None] + 1e-9
                starts = np.cumsum(counts) - counts
                mean = np.add.reduceat(logs * letters, starts) / np.add.reduceat(letters, starts)
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best, score = p.argmax(1), p.max(1).astype(np.float64)
                none = ~batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                best[none], score[none] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([names[k] for k in best], pa.string()),
                        pa.array(np.clip(score, 0, 1), pa.float64()),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col), has_letter.alias("_letter"))
    return rows.mapInArrow(classify, f"doc_id {kind}, lang_pred string, score double")


def identify(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    config: Config = Config(),
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, by a network trained on rows of ``learn_from``.

    Texts are read whole, in windows. A null text or one without a letter is ``und``; so is
    every text if there is no labelled row to learn from. Equal texts have equal results;
    an empty table gives an empty result. Language, source and id are never inputs.
    """
    sample = training_sample(docs, learn_from, text_col, lang_col, config).collect()
    net = train([bytes(r["window"]) for r in sample], [r["lang"] for r in sample], config)
    if not sample:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return predict(docs, net, id_col, text_col)
