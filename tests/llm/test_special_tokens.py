"""Texts that hold special-token strings, against the untouched library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import llm_brute as brute
from rowmill.llm.packing import pack
from rowmill.llm.text import chunks
from rowmill.llm.token_files import read_tokens, write_tokens
from rowmill.llm.tokens import Encoder, vocabulary

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y's z", "<|startoftext|>Hello", "plain text",
         "", "split <|endof", "text|> over two texts", "<|ENDOFTEXT|> <| endoftext |>", "  <|endoftext|>\n\n tail  "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_untouched_library(name):
    path = public_tokenizers.path(name)
    t, enc = Tokenizer.from_file(path), Encoder(vocabulary(path))
    g = random.Random(3)
    mixed = ["".join(g.choice([" ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "Don't", "é", "\n", "12", "word"])
                     for _ in range(g.randrange(12))) for _ in range(300)]
    for _, buf, offs in chunks(pa.record_batch([pa.array(TEXTS + mixed)], names=["text"]), "text"):
        ids, counts = enc.encode(buf, offs)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in TEXTS + mixed]


def test_operators_give_the_special_ids(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows}
    got = {r.id: (r.length, r.ids_crc32) for r in pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {i: (len(x), brute.crc(x)) for i, x in ids.items()}
    t, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    files = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert sorted(tuple(r) for r in read_tokens(spark, files).collect()) == want
