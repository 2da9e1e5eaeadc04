from __future__ import annotations

from keepsight.llm.line_runs import line_report, without_copied_lines
from tests.llm.helpers import docs_of, empty_docs, odd_docs


def brute(texts, least):
    """Deleted line numbers of each text, by comparing runs of lines as text."""
    places, runs = {}, []
    for d, text in enumerate(texts):
        lines = [(n, x.strip(" \t\n\x0b\f\r")) for n, x in enumerate((text or "").split("\n"))]
        lines = [(n, x) for n, x in lines if x]
        for p in range(len(lines)):
            m = next((m for m in range(1, len(lines) - p + 1) if sum(len(x.split()) for _, x in lines[p : p + m]) >= least), None)
            if m:
                key = tuple(x for _, x in lines[p : p + m])
                places.setdefault(key, (d, p))
                runs.append((d, p, m, key, lines))
    gone = {d: set() for d in range(len(texts))}
    for d, p, m, key, lines in runs:
        fd, fp = places[key]
        if fd != d or p >= fp + m:
            gone[d] |= {n for n, _ in lines[p : p + m]}
    return gone


def sample():
    a = [f"line {k} of the passage has seven words" for k in range(9)]
    return [
        "\n".join(["intro", *a, "end"]),
        "\n".join(["other start", "", *a[2:7], "tail text here"]),
        "\n".join([a[0], "break", a[1], a[2]]),
        "\n".join(["ha ha"] * 60),
        "\n".join(a[3:5] + ["x"] + a[3:9]),
        None,
        "",
        " \n \n",
        "\n".join([" " + a[4] + "\t", a[5], a[6] + " "]),
    ]


def test_deleted_lines_match_brute_force(spark):
    for least in (3, 8, 20):
        rows = line_report(docs_of(spark, sample()), least).collect()
        assert {r["doc_id"]: set(r["deleted_lines"]) for r in rows} == brute(sample(), least)


def test_texts_lose_only_later_copies(spark):
    docs = docs_of(spark, sample())
    left = {r["doc_id"]: r["text"] for r in without_copied_lines(docs, 20).collect()}
    assert left[0] == sample()[0]
    assert left[1] == "other start\n\ntail text here"
    assert 8 not in left  # nothing is left of it
    assert left[5] is None and left[6] == "" and left[7] == " \n \n"


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = line_report(docs).collect()
    assert len(rows) == docs.count() and all(r["n_deleted_words"] == 0 for r in rows)
    left = without_copied_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert line_report(empty_docs(spark)).count() == 0
