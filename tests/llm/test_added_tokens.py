"""Texts that hold the tokenizer's added tokens, against the library as it comes."""

import struct

import public_tokenizers as P
from tokenizers import Tokenizer

from metasieve.llm.sstable import SpanEncoder


def test_added_tokens_as_the_library_gives_them():
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>Y<|startoftext|> É<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "<|endoftext|>\n<|endoftext|>.", "plain", "ß中<|endoftext|>1 2", "a <|endof text|>"]
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in SpanEncoder(P.path("word_bpe_49k.json")).encode_all(rows)]
    assert got == [words.encode(r, add_special_tokens=False).ids for r in rows]
    assert 49407 in got[0]
