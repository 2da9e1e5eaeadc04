from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from keepsight.llm import prefix_trie
from keepsight.llm.prefix_trie import conversation_trie

KIND = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """(conv_id, depth) -> the other columns, by walking every prefix of every conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        parent = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(parent, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, cs in members.items():
        s = (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += s
            leaves[path[:d]] += children[path] == 0
    out = {}
    for path, cs in members.items():
        ends = ",".join(str(c) for c in cs if whole[c] == path)
        up = members[path[:-1]][0] if path else None
        out[cs[0], len(path)] = (
            up, len(cs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()
        )
    return out


def rows_of(nodes):
    names = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return {(r["conv_id"], r["depth"]): tuple(r[n] for n in names) for r in nodes.collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_nodes_match_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for c in range(0, 130):
        for t in range(rng.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "bot"]), "a b" if rng.random() < 0.8 else f"c {rng.randrange(3)}"))
    rng.shuffle(rows)
    assert rows_of(conversation_trie(table(spark, rows), block)) == brute(rows)


def test_logs_that_grow_turn_by_turn(spark):
    rows = [(40 + c, t, "u", f"turn {t}") for c in range(20) for t in range(c + 1)]
    rows += [(60 + c, t, "u", f"turn {t}") for c in range(20) for t in range(20 - c)]
    assert rows_of(conversation_trie(table(spark, rows))) == brute(rows)


def test_many_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c, t, "u", f"same {t}") for c in range(200) for t in range(5)]
    rows += [(c, t, "u", f"long {t % 7}") for c in (1000, 1001) for t in range(60)]
    rows += [(1002, t, "u", f"long {t % 7}") for t in range(31)]
    assert rows_of(conversation_trie(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "u", "nobody's"), (1, None, "u", "first"), (1, 0, None, None), (1, 0, "u", "tie"), (1, 0, "u", "tie"),
        (2, 3, "", ""), (2, 3, None, None), (3, None, None, None), (-7, 1, "u", "below"), (-20, 1, "u", "zero"),
        (5, 1, "u", "long " * 200_000), (25, 1, "u", "long " * 200_000), (6, 1, "1:u", "x"), (6, 2, "1", ":ux"),
    ]
    docs = table(spark, rows).selectExpr("*", "'x' AS c", "'x' AS pos", "'x' AS depth", "'x' AS via", "'x' AS digest")
    assert rows_of(conversation_trie(docs)) == brute(rows)
    assert conversation_trie(table(spark, [])).count() == 0
    assert conversation_trie(table(spark, rows[:1])).count() == 0


def test_a_conversation_without_turns_left_is_the_root(spark):
    rows = [(c, 0, "u", "only") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0]
    nodes = rows_of(conversation_trie(table(spark, rows)))
    assert nodes == brute(rows) and set(nodes) == {(rows[0][0], 0)}
