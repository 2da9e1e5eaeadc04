from __future__ import annotations

import random

import pytest
import re

from keepsight.llm import licenses as li
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in li.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_match_brute_force(spark):
    odd = ["cc by cc-by CC\nBY, xcc by cc byx", "all rights all rights reserved. ALL RIGHTS RESERVED", "é cc by é", "ccé by", "0cc by"]
    for docs in (documents(spark), docs_of(spark, odd), odd_docs(spark)):
        texts = docs.select("text").collect()
        rows = li.license_scan(docs).collect()
        got = [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows]
        assert got == [brute(t["text"]) for t in texts]
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_rules(spark):
    assert len(li.default_rules()) >= 200
    cases = {
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc"},
        "SPDX-License-Identifier: Apache-2.0": {"apache"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl"},
        "under the GNU Lesser General Public License v2.1": {"gpl", "lgpl"},
        "Released under the MIT License.": {"mit"},
        "Redistribution and use in source and binary forms, with or without": {"bsd"},
        "see https://creativecommons.org/licenses/by-sa/4.0/": {"cc-by-sa"},
        "the licensee admitted a mite of cc": set(),
    }
    rows = li.license_scan(docs_of(spark, list(cases))).orderBy("doc_id").collect()
    assert [set(filter(None, r["labels"].split(","))) for r in rows] == list(cases.values())


def test_suppression_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        found = []
        for k in range(rng.randrange(12)):
            a = rng.randrange(20)
            found.append(li.Match(a, a + 1 + rng.randrange(8), "x", 1.0, k))
        want = []
        for m in found:
            if not any((k.start <= m.start and m.end <= k.end) or (m.start <= k.start and k.end <= m.end) for k in want):
                want.append(m)
        assert li.suppressed(found) == sorted(want, key=lambda m: m.start)


def test_empty(spark):
    assert li.license_scan(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(
    "text,label",
    [
        ("licensed under the\n * apache license,\n * version 2.0", "apache"),
        ("permission is hereby granted, free\n# of charge, to any\n# person obtaining a copy", "mit"),
        ("released under GPLv3 or later", "gpl"),
        ("see LGPLv2.1", "lgpl"),
        ("under the terms of the gnu general\r\n   public license", "gpl"),
    ],
)
def test_wrapped_texts_are_recognised(text, label):
    matches = li.Scanner(li.default_rules()).matches(text.lower())
    assert {m.label for m in matches} == {label}


@pytest.mark.parametrize("text", ["the apache helicopter was licensed", "free of worry and of charge", "gpl is short", "a public road, a general"])
def test_other_texts_are_left_alone(text):
    assert li.Scanner(li.default_rules()).matches(text) == []
