"""Quality by weak supervision: rules vote or abstain, and EM weighs the votes.

No rule decides alone. Each looks at one measure of a text and votes good or bad where
the measure is telling, else it abstains. Nobody labels documents: the accuracies of the
rules are the parameters of a two-class mixture in which votes are independent given the
class, and expectation-maximisation fits them. All it needs is how often each combination
of votes occurs, a table of at most 3^rules rows however large the corpus is.

Everything runs as DataFrame expressions; there is no Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.llm.storage import Scratch

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_SYMBOL_RUN = r"[#*$%&|<>]{2,}|(?<![^ \t-\r])[#*$%&|<>](?![^ \t-\r])"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with measures of each whole text in one struct, ``measures``.

    Fields: ``n_words`` (between ASCII white space), ``word_chars`` (code points in words),
    ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines`` (equal to an earlier
    line), ``n_repeat_words`` (words covered by ``window``-word windows that occur twice or
    more in the text), ``n_upper``, ``n_marks`` (exclamation marks), ``n_ends`` (words
    that end a sentence), ``n_symbol_runs`` (two symbols or more together, or one alone). A null or blank text has zeros. Windows count as equal by 64-bit hashes within
    one text. Columns of any other name stay; ``_q_`` is a reserved prefix.
    """
    text, n = F.col("_q_text"), F.col("_q_n")
    bare = text
    for blank in BLANK:
        bare = F.replace(bare, F.lit(blank))
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(s))) for s in SYMBOLS), F.lit(0))
    lines = F.filter(F.split("_q_text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    words = F.split(F.btrim("_q_text", F.lit(BLANK)), "[ \t-\r]+")
    no_words = F.array().cast("array<bigint>")
    df = docs.withColumn("_q_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns(
        {
            "_q_hash": F.when(
                F.btrim("_q_text", F.lit(BLANK)) != "", F.transform(words, lambda w: F.xxhash64(w))
            ).otherwise(no_words),
            "_q_lines": lines,
            "_q_chars": F.char_length(bare),
            "_q_symbols": symbols,
            "_q_upper": F.regexp_count("_q_text", F.lit(r"\p{Lu}")),
            "_q_marks": F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"))),
            "_q_runs_of": F.regexp_count("_q_text", F.lit(_SYMBOL_RUN)),
            "_q_ends": F.regexp_count("_q_text", F.lit(r"[.!?…。](?=[ \t-\r]|\z)")),
        }
    )
    df = df.withColumn("_q_n", F.size("_q_hash"))
    at = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    run = lambda i: F.xxhash64(*[F.get("_q_hash", i + k) for k in range(window)])
    df = df.withColumn("_q_runs", F.transform(at, run))
    df = df.withColumn("_q_again", F.size(F.array_distinct("_q_runs")) < F.size("_q_runs"))
    places = F.array_sort(F.transform("_q_runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_q_sorted", F.when(F.col("_q_again"), places))

    def repeated(place: Column, k: Column) -> Column:
        same = lambda other: F.get("_q_sorted", other)["x"] == place["x"]
        return F.coalesce(same(k - 1), F.lit(False)) | F.coalesce(same(k + 1), F.lit(False))

    df = df.withColumn("_q_found", F.filter("_q_sorted", repeated))
    df = df.withColumn("_q_at", F.array_sort(F.transform("_q_found", lambda p: p["i"])))
    # a window covers up to the next repeated window, and all its words if that is far off
    cover = F.transform("_q_at", lambda p, k: F.least(F.coalesce(F.get("_q_at", k + 1) - p, F.lit(window)), F.lit(window)))
    df = df.withColumn("_q_cover", F.aggregate(cover, F.lit(0), lambda a, x: a + x))
    values = {
        "n_words": n,
        "word_chars": F.col("_q_chars"),
        "n_symbols": F.col("_q_symbols"),
        "n_lines": F.size("_q_lines"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.coalesce("_q_cover", F.lit(0)),
        "n_symbol_runs": F.col("_q_runs_of"),
        "n_upper": F.col("_q_upper"),
        "n_marks": F.col("_q_marks"),
        "n_ends": F.col("_q_ends"),
    }
    struct = F.struct(*[v.cast("bigint").alias(k) for k, v in values.items()])
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c != "measures"], struct.alias("measures"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def default_rules(m: Column) -> dict[str, Column]:
    """Votes of each rule on a text's measures: 1 good, -1 bad, 0 abstains."""
    n, chars = m["n_words"], m["word_chars"]
    never = F.lit(False)
    return {
        "base": _vote(base_failed(m), never),
        "symbols": _vote(m["n_symbols"] * 5 > n, m["n_symbols"] * 200 <= n),
        "symbol_share": _vote(m["n_symbols"] * 25 > chars, m["n_symbols"] * 1000 <= chars),
        "symbol_runs": _vote(m["n_symbol_runs"] * 10 > n, never),
        "repeats": _vote(m["n_repeat_words"] * 5 > n, never),
        "lines": _vote(m["n_dup_lines"] * 2 > m["n_lines"], never),
        "capitals": _vote(m["n_upper"] * 10 > chars * 4, (m["n_upper"] > 0) & (m["n_upper"] * 100 <= chars * 15)),
        "marks": _vote(m["n_marks"] * 5 > n, never),
        "length": _vote(n < 10, n.between(50, 50_000)),
        "word_length": _vote((chars < 2 * n) | (chars > 15 * n), chars.between(3 * n, 10 * n)),
        "sentences": _vote((n >= 40) & (m["n_ends"] * 200 < n), (m["n_ends"] * 80 >= n) & (m["n_ends"] * 2 <= n)),
    }


@dataclass(frozen=True)
class Model:
    """Share of good texts, and each rule's chances of a bad and a good vote in either class."""

    prior: float
    on_good: dict[str, tuple[float, float]] = field(default_factory=dict)
    on_bad: dict[str, tuple[float, float]] = field(default_factory=dict)

    def accuracy(self, rule: str) -> tuple[float, float]:
        """Of the rule's votes on good and on bad texts, the share that is right."""
        (gb, gg), (bb, bg) = self.on_good[rule], self.on_bad[rule]
        return gg / (gb + gg), bb / (bb + bg)

    def weights(self, rule: str) -> tuple[float, float, float]:
        """Log-odds of a bad vote, of none and of a good vote."""
        (gb, gg), (bb, bg) = self.on_good[rule], self.on_bad[rule]
        return math.log(gb / bb), math.log((1 - gb - gg) / (1 - bb - bg)), math.log(gg / bg)


def posterior(votes: dict[str, Column], model: Model) -> Column:
    """Probability that a text is good, given its votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, vote in votes.items():
        bad, none, good = model.weights(name)
        odds = odds + F.when(vote == 1, F.lit(good)).when(vote == -1, F.lit(bad)).otherwise(F.lit(none))
    return 1 / (1 + F.exp(-odds))


#: Where EM starts: rules mostly right. It also weighs in as a small share of the texts.
PRIOR, ON_GOOD, ON_BAD, PSEUDO = 0.9, (0.01, 0.7), (0.4, 0.3), 0.01


def fit(patterns: DataFrame, rules: list[str], rounds: int = 40, tolerance: float = 1e-4) -> Model:
    """EM on ``patterns``: one column of votes for each rule, and ``n`` texts that have them.

    The starting values count as ``PSEUDO`` of all texts, which keeps every chance off 0
    and 1. Each round is one small aggregation. No text at all gives the starting values.
    """
    start = Model(PRIOR, dict.fromkeys(rules, ON_GOOD), dict.fromkeys(rules, ON_BAD))
    total = patterns.agg(F.sum("n")).first()[0]
    if not total:
        return start
    model, weight = start, total * PSEUDO
    for _ in range(rounds):
        p, n = F.col("_p"), F.col("n")
        sums = [F.sum(p * n).alias("_good")]
        for name in rules:
            for key, mass in (("g", p * n), ("b", (1 - p) * n)):
                for tag, vote in (("b", -1), ("g", 1)):
                    sums.append(F.sum(F.when(F.col(name) == vote, mass).otherwise(0.0)).alias(f"{key}{tag}_{name}"))
        row = patterns.withColumn("_p", posterior({r: F.col(r) for r in rules}, model)).agg(*sums).first()
        good, bad = row["_good"], total - row["_good"]

        def chances(side: str, mass: float, at_first: tuple[float, float], name: str):
            return tuple(
                (row[f"{side}{tag}_{name}"] + weight * first) / (mass + weight) for tag, first in zip("bg", at_first)
            )

        new = Model(
            (good + PRIOR * weight) / (total + weight),
            {r: chances("g", good, ON_GOOD, r) for r in rules},
            {r: chances("b", bad, ON_BAD, r) for r in rules},
        )
        moved = max(
            abs(x - y) for r in rules for a, b in ((new.on_good, model.on_good), (new.on_bad, model.on_bad)) for x, y in zip(a[r], b[r])
        )
        model = new
        if moved < tolerance:
            break
    return model


def vote_patterns(rows: DataFrame, votes: dict[str, Column]) -> DataFrame:
    return rows.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).agg(F.count("*").alias("n"))


def judged(
    docs: DataFrame,
    text_col: str = "text",
    rules=default_rules,
    threshold: float = 0.5,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with ``measures``, ``base_failed``, ``quality`` (posterior) and ``kept``.

    ``kept`` is false where the base rule fails or the posterior is below ``threshold``.
    The measures are written once, without the text unless ``keep_text``; the accuracies
    come from every row, repeated ones included. Rows with null or empty text have no
    words, so they fail. An empty table gives an empty result. Columns named as one of the
    four results are replaced.
    """
    scratch = Scratch("supervision")
    names = ("measures", "base_failed", "quality", "kept")
    columns = [c for c in docs.columns if c not in names and (keep_text or c != text_col)]
    found = measured(docs.select(*{*columns, text_col}), text_col)
    rows = scratch.write(found.select(*columns, "measures"), "measures")
    m = F.col("measures")
    votes = rules(m)
    patterns = scratch.write(vote_patterns(rows, votes), "patterns")
    model = fit(patterns.coalesce(1), list(votes))
    failed = F.coalesce(base_failed(m), F.lit(True))
    quality = posterior(votes, model)
    return rows.withColumns({"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= threshold)})


def good_documents(docs: DataFrame, text_col: str = "text", rules=default_rules, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the base rule and the weighed votes keep; columns stay as they are.

    The rows are written once with their measures, so no text is measured twice or shuffled.
    """
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    rows = judged(plain, f"c{columns.index(text_col)}", rules, threshold, keep_text=True)
    return rows.filter("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
