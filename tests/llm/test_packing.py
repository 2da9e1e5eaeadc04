from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from keepsight.llm.bpe import vocabulary
from keepsight.llm.packing import packed
from tests.llm.helpers import docs_of, documents, empty_docs, odd_docs

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizers(spark):
    bpe = vocabulary("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    odd = ["  two  spaces ", "a \n b", "\n\n x", " ", "tab\t end ", "a\x1c b", "x  y", "a<|endoftext|> b <|endoftext|>", "don't we'll", "１２ 34", "a  b", "\x85 c"]
    for text in [*odd, *[r["text"] for r in documents(spark).collect()]]:
        assert bpe.ids(text).tolist() == ids_of(text)[:-1], text[:50]


def check(rows, texts):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        ids, at = ids_of(texts[i]), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    groups = defaultdict(int)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at == pieces[0]["sequence_length"]
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
        groups[pieces[0]["step_group"]] += at
    assert padding == 0
    assert sum(n != 8192 for n in groups.values()) <= 8  # the last of a partition
    return total


def test_every_id_lies_in_one_piece_and_no_sequence_is_padded(spark):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packed(docs.repartition(3)).collect()
    assert check(rows, texts) == sum(len(ids_of(t)) for t in texts.values())
    assert np.mean([r["sequence_length"] == 1024 for r in rows]) > 0.9


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = packed(docs, with_ids=True).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"])) for r in docs.collect())
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packed(empty_docs(spark)).count() == 0
    texts = ["", None, "a", " ".join(["word"] * 1023), " ".join(["word"] * 3000)]
    check(packed(docs_of(spark, texts)).collect(), dict(enumerate(texts)))
