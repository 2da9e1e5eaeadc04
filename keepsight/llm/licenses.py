"""License statements found by ordered signature rules.

A rule is a regular expression, a keyword without which it cannot match, a label, a weight
and a place in the order. Only rules whose keyword occurs in a text are tried. Matches may
overlap: taken in order, a match that lies within one already accepted, or around one of
an earlier rule, is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are always looked for, word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label: (keyword, how the license is named, identifiers in tags, where its text is published)
FAMILIES = {
    "apache": ("apache", r"apache(?: software)?", r"apache-\d\.\d", r"apache\.org/licenses"),
    "mit": ("mit", r"\bmit\b(?:/x11|/expat)?", r"mit(?:-0)?\b", r"opensource\.org/licenses/mit"),
    "bsd": ("bsd", r"(?:new |modified |simplified |[234]-clause )?bsd", r"0?bsd(?:-[1234]-clause)?", r"opensource\.org/licenses/bsd"),
    "gpl": ("general public", r"gnu general public", r"gpl-[123](?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    "lgpl": ("lesser general", r"gnu (?:lesser|library) general public", r"lgpl-[23](?:\.[01])?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    "agpl": ("affero", r"(?:gnu )?affero general public", r"agpl-[13](?:\.0)?", r"gnu\.org/licenses/agpl"),
    "gfdl": ("free documentation", r"gnu free documentation", r"gfdl-1\.[123]", r"gnu\.org/licenses/fdl"),
    "mpl": ("mozilla", r"mozilla public", r"mpl-[12]\.[01]", r"mozilla\.org/mpl"),
    "epl": ("eclipse", r"eclipse public", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    "edl": ("eclipse dist", r"eclipse distribution", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    "cddl": ("development and distribution", r"common development and distribution", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    "cpl": ("common public", r"common public", r"cpl-1\.0", r"opensource\.org/licenses/cpl"),
    "ipl": ("ibm public", r"ibm public", r"ipl-1\.0", r"opensource\.org/licenses/ibmpl"),
    "isc": ("isc", r"\bisc\b", r"isc\b", r"opensource\.org/licenses/isc"),
    "zlib": ("zlib", r"zlib(?:/libpng)?", r"zlib\b", r"zlib\.net/zlib_license"),
    "boost": ("boost", r"boost software", r"bsl-1\.0", r"boost\.org/license_1_0"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", r"unlicense\b", r"unlicense\.org"),
    "wtfpl": ("what the", r"do what the \w+ you want to public", r"wtfpl\b", r"wtfpl\.net"),
    "artistic": ("artistic", r"(?:perl )?artistic", r"artistic-[12]\.0", r"perlfoundation\.org/artistic"),
    "python": ("python", r"python software foundation", r"(?:psf|python)-2\.0", r"python\.org/psf/license"),
    "php": ("php", r"\bphp\b", r"php-3\.0\d?", r"php\.net/license"),
    "ruby": ("ruby", r"\bruby\b", r"ruby\b", r"ruby-lang\.org/\w+/about/license"),
    "openssl": ("openssl", r"openssl", r"openssl\b", r"openssl\.org/source/license"),
    "postgresql": ("postgresql", r"postgresql", r"postgresql\b", r"postgresql\.org/about/licence"),
    "eupl": ("european union public", r"european union public", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    "ofl": ("open font", r"sil open font", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    "odbl": ("open database", r"open (?:data commons )?(?:open )?database", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by": ("open data commons", r"open data commons attribution", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    "pddl": ("public domain dedication", r"public domain dedication and", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    "ogl": ("open government", r"open government", r"ogl-(?:uk-)?[123]\.0", r"nationalarchives\.gov\.uk/doc/open-government"),
    "ms-pl": ("microsoft public", r"microsoft public", r"ms-pl\b", r"opensource\.org/licenses/ms-pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal", r"ms-rl\b", r"opensource\.org/licenses/ms-rl"),
    "apsl": ("apple public", r"apple public source", r"apsl-[12]\.\d", r"opensource\.apple\.com/apsl"),
    "nposl": ("non-profit open", r"non-profit open software", r"nposl-3\.0", r"opensource\.org/licenses/nposl"),
    "osl": ("open software", r"open software", r"osl-[123]\.[01]", r"opensource\.org/licenses/osl"),
    "afl": ("academic free", r"academic free", r"afl-[123]\.\d", r"opensource\.org/licenses/afl"),
    "ecl": ("educational community", r"educational community", r"ecl-[12]\.0", r"opensource\.org/licenses/ecl"),
    "ncsa": ("illinois", r"university of illinois(?:/ncsa)?(?: open source)?", r"ncsa\b", r"opensource\.org/licenses/ncsa"),
    "upl": ("universal permissive", r"universal permissive", r"upl-1\.0", r"opensource\.org/licenses/upl"),
    "cecill": ("cecill", r"cecill", r"cecill-(?:[bc]|[12]\.[01])", r"cecill\.info"),
    "mulan": ("mulan", r"mulan (?:psl|permissive software)", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn/mulan"),
    "bsl-1.1": ("business source", r"business source", r"busl-1\.1", r"mariadb\.com/bsl11"),
    "sspl": ("server side public", r"server side public", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    "elastic": ("elastic", r"elastic", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    "openrail": ("rail", r"(?:creativeml |bigscience )?open ?rail(?:-m)?", r"(?:creativeml-)?openrail(?:-m)?\+*", r"huggingface\.co/spaces/\S*license"),
    "blueoak": ("blue oak", r"blue oak model", r"blueoak-1\.0\.0", r"blueoakcouncil\.org/license"),
    "vim": ("vim", r"\bvim\b", r"vim\b", r"vimhelp\.org/uganda"),
    "w3c": ("w3c", r"w3c(?: software)?", r"w3c\b", r"w3\.org/consortium/legal"),
    "unicode": ("unicode", r"unicode", r"unicode-(?:dfs-\d+|3\.0)", r"unicode\.org/(?:license|copyright)"),
    "json": ("json", r"\bjson\b", r"json\b", r"json\.org/license"),
}

#: Sentences that belong to one license text: (label, keyword, expression).
SENTENCES = [
    ("mit", "free of charge", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("isc", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", r"redistributions? and use in source and binary forms"),
    ("apache", "in compliance with", r"you may not use this (?:file|work) except in compliance with the license"),
    ("gpl", "redistribute it", r"redistribute it and/or modify it under the terms of the gnu general public"),
    ("lgpl", "redistribute it", r"redistribute it and/or modify it under the terms of the gnu lesser general public"),
    ("agpl", "redistribute it", r"redistribute it and/or modify it under the terms of the gnu affero"),
    ("zlib", "express or implied", r"provided 'as-is', without any express or implied warranty"),
    ("unlicense", "public domain", r"released into the public domain"),
    ("public-domain", "public domain", r"(?:is|are|placed) (?:in )?the public domain|dedicated to the public domain"),
    ("cc0", "cc0", r"\bcc0\b(?: 1\.0)?(?: universal)?"),
    ("proprietary", "prior written", r"without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", "confidential", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "no part", r"no part of this (?:work|publication|book) may be (?:reproduced|used)"),
    ("copyright", "copyright", r"copyright (?:\(c\)|©|\d{4})(?:[ ,]*(?:\(c\)|©|\d{4}(?:-\d{2,4})?))*"),
    ("copyright", "©", r"© ?\d{4}"),
    ("gpl", "gplv", r"\bgplv[123](?:\.0)?\+?"),
    ("lgpl", "lgplv", r"\blgplv[23](?:\.[01])?\+?"),
    ("agpl", "agplv", r"\bagplv[13](?:\.0)?\+?"),
]

_CC = ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by")
_CC_WORDS = {
    "by-nc-nd": r"attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?", "by-nc-sa": r"attribution[- ]non-?commercial[- ]share-?alike",
    "by-nc": r"attribution[- ]non-?commercial", "by-nd": r"attribution[- ]no-?deriv(?:ative)?s?",
    "by-sa": r"attribution[- ]share-?alike", "by": r"attribution",
}
_VERSION = r"(?:,? ?(?:version|v\.?)? ?\d(?:\.\d)*)?"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    weight: float


@lru_cache(1)
def default_rules() -> tuple[Rule, ...]:
    """All rules, the most telling first: tags, grants, whole sentences, addresses, plain names."""
    tags, grants, addresses, names = [], [], [], []
    for label, (keyword, name, tag, url) in FAMILIES.items():
        licence = rf"{name} (?:public |style |open source )?licen[sc]e"
        tags.append(Rule(label, "spdx", rf"spdx-license-identifier: *\(?{tag}(?:-only|-or-later|\+)?", 1.0))
        grants.append(Rule(label, keyword, rf"(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{licence}{_VERSION}", 0.95))
        addresses.append(Rule(label, url.split(r"\.")[0], rf"(?:https?://)?(?:www\.)?{url}\S*", 0.85))
        names.append(Rule(label, keyword, licence + _VERSION, 0.7))
        names.append(Rule(label, "licen", rf"\blicen[sc]e: *{tag}", 0.7))
    for kind in _CC:
        spaced, tag = kind.replace("-", "[ -]"), rf"cc-{kind}-\d\.\d"
        tags.append(Rule(f"cc-{kind}", "spdx", rf"spdx-license-identifier: *{tag}", 1.0))
        grants.append(Rule(f"cc-{kind}", "cc", rf"under (?:the )?(?:a )?cc[ -]{spaced}(?![ -](?:nc|nd|sa)\b){_VERSION}", 0.95))
        addresses.append(Rule(f"cc-{kind}", "creativecommons", rf"creativecommons\.org/licenses/{kind}(?=/|\b)\S*", 0.85))
        names.append(Rule(f"cc-{kind}", "creative commons", rf"creative commons {_CC_WORDS[kind]}{_VERSION}", 0.8))
        names.append(Rule(f"cc-{kind}", "cc", rf"\bcc[ -]{spaced}(?![ -](?:nc|nd|sa)\b){_VERSION}", 0.7))
    sentences = [Rule(label, keyword, pattern, 0.9) for label, keyword, pattern in SENTENCES]
    return (*tags, *grants, *sentences, *addresses, *names)


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    label: str
    weight: float
    rule: int


def _wrapped(pattern: str) -> str:
    """The pattern with each blank outside a class matching white space, line ends and comment marks of any length.

    License texts are wrapped, and often stand in a comment.
    """
    gap, out, inside, k = r"[\s*#/;]", [], False, 0
    while k < len(pattern):
        c, more = pattern[k], pattern[k + 1 : k + 2]
        if c == "\\":
            out.append(c + more)
            k += 2
            continue
        inside = c != "]" if inside else c == "["
        if c == " " and not inside:
            c = gap + ("*" if more in ("*", "?") and more else "+")
            k += more in ("*", "?", "+") and more != ""
        out.append(c)
        k += 1
    return "".join(out)


class Scanner:
    """The compiled rules and one automaton of the first words of their keywords."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(_wrapped(r.pattern)) for r in rules]
        by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            by_keyword.setdefault(r.keyword, []).append(k)
        self.words = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            first = keyword.split()[0]  # what follows may stand on the next line
            self.words.add_word(first, self.words.get(first, []) + numbers)
        self.words.make_automaton()

    def matches(self, text: str) -> list[Match]:
        """The accepted matches in a lower-cased text, by place."""
        tried = sorted({k for _, numbers in self.words.iter(text) for k in numbers})
        found = [
            Match(m.start(), m.end(), self.rules[k].label, self.rules[k].weight, k)
            for k in tried
            for m in self.compiled[k].finditer(text)
            if m.end() > m.start()
        ]
        return suppressed(found)


def suppressed(found: list[Match]) -> list[Match]:
    """Without the matches that contain or are contained in one of an earlier rule.

    ``found`` is in the rules' order. Of accepted intervals none contains another, so they
    are in order of start and of end at once and one look at either neighbour is enough.
    """
    from bisect import bisect_left, insort

    kept: list[Match] = []
    key = lambda m: (m.start, m.end)
    for m in found:
        at = bisect_left(kept, key(m), key=key)
        inside = (at < len(kept) and kept[at].start == m.start) or (at and kept[at - 1].end >= m.end)
        around = (at < len(kept) and kept[at].end <= m.end) or (at and kept[at - 1].start == m.start)
        if not inside and not around:
            insort(kept, m, key=key)
    return kept


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_TO_CLASS = bytes(ord("w") if w else ord(" ") for w in _WORD_BYTE)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NOT_WORD = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"


@lru_cache(4)
def _phrase(words: str) -> re.Pattern:
    """Where a phrase's words stand one after the other; no byte of one use is lost to the next."""
    inner = (_NOT_WORD + rb"+").join(map(re.escape, words.encode().split()))
    return re.compile(rb"(?<![^\x00-\x2f\x3a-\x60\x7b-\x7f])(?=(" + inner + rb")(?![^\x00-\x2f\x3a-\x60\x7b-\x7f]))")


def base_places(lowered: bytes) -> tuple[int, dict[str, list[int]]]:
    """Number of words, and for each phrase's label the numbers of the words where it starts."""
    classes = b" " + lowered.translate(_TO_CLASS)
    found = {}
    for words, label in PHRASES.items():
        if words.split()[0].encode() in lowered:
            starts = [m.start() for m in _phrase(words).finditer(lowered)]
            if starts:
                found[label] = []
                at = number = 0
                for start in starts:
                    number += classes.count(b" w", at, start + 1)
                    at = start
                    found[label].append(number)
    return classes.count(b" w"), found


@lru_cache(2)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row.

    A-Z count as a-z; words are runs of digits, letters and characters beyond ASCII.
    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are
    the least and greatest word number where one starts. Labels are distinct, sorted and
    joined by commas, an empty string where there are none. ``score`` is the weight of the
    most telling match (a base phrase: 0.5), 0 without any. ``spans`` are the rules' matches:
    code points, label and rule number. Texts are scanned whole; a null text counts as
    empty; equal rows have equal results; other columns are not read.
    """
    chosen = default_rules() if rules is None else rules
    ddl = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(chosen)
        for batch in batches:
            rows, spans = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                lowered = (text.as_py() or b"").translate(_LOWER)
                n, base = base_places(lowered)
                places = [p for found in base.values() for p in found]
                matches = scanner.matches(lowered.decode("utf-8", "replace"))
                labels = set(base) | {m.label for m in matches}
                score = max([m.weight for m in matches] + [0.5 if base else 0.0])
                least, most = (min(places), max(places)) if places else (None, None)
                rows.append((n, len(places), least, most, ",".join(sorted(base)), ",".join(sorted(labels)), score))
                spans.append([{"start": m.start, "end": m.end, "label": m.label, "rule": m.rule} for m in matches])
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(spans, pa.list_(span))],
                ["doc_id", *[d.split()[0] for d in ddl.split(", ")], "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(
        scan, f"doc_id {kind}, {ddl}, spans array<struct<start: bigint, end: bigint, label: string, rule: int>>"
    )
