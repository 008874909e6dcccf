"""Byte-level BPE, sorted-string tables and token rollups against the tokenizer libraries."""

import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metasieve.llm.byte_bpe import ByteBpe, decode_documents, encode_documents, read_ranks, round_trips
from metasieve.llm.common import scratch
from metasieve.llm.sstable import SpanEncoder, id_of, key_of, lookup, read_sstables, write_sstables
from metasieve.llm.token_rollup import TokenRollup, changes, count_tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n  b\n\n c ", "don't  DON'T 'S 'll", "x" * 5000, "ab" * 3000, "é" * 700, "a\x1cb \x1c c", "  a  b", "1234 5 67", "👩‍👩‍👧 ok", "́a ́b H̱ ΑΣ ΑΣ.", "\x01", "a \x01 b", "İI ıi", " " * 300 + "a", "\t\ta\tb ", "A <|endoftext|> b", "<|STARTOFTEXT|> H̱<|startoftext|>"]
docs_text = st.lists(st.sampled_from([" ", "  ", "\n", "the", " thon", "'s", "É", "9", "\t", "!!", "ß", " ", "\x1f", "中文", "aaaa", "́", "<|endoftext|>", "Ḥ"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(WORDS)


BPE = ByteBpe(read_ranks(RANKS), P.PATTERN)
SPANS = SpanEncoder(WORDS)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(docs_text, st.text(max_size=60)))
def test_byte_bpe_as_tiktoken(libraries, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = BPE.encode(text)
    assert ids == libraries[0].encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(rows=st.lists(st.one_of(docs_text, st.text(max_size=60)), max_size=5))
def test_spans_as_tokenizers(libraries, rows):
    rows = [r.encode("utf-8", "ignore").decode() for r in rows]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in SPANS.encode_all(rows)] == [libraries[1].encode(r, add_special_tokens=False).ids for r in rows]


def test_odd_texts(libraries):
    for t in ODD:
        assert BPE.encode(t) == libraries[0].encode_ordinary(t), repr(t[:20])
        assert list(struct.unpack(f"<{len(SPANS.encode_all([t])[0]) // 4}I", SPANS.encode_all([t])[0])) == libraries[1].encode(t, add_special_tokens=False).ids, repr(t[:20])


def test_another_pattern_is_not_cut_at_spaces(libraries):
    import tiktoken

    pattern = r"\S+ |\S+|\s+"
    bpe = ByteBpe(BPE.ranks, pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=BPE.ranks, special_tokens={})
    assert [bpe.encode(t) for t in ODD] == [other.encode_ordinary(t) for t in ODD]


def test_round_trips(spark, libraries):
    df = docs(spark)
    got = round_trips(df, RANKS, P.PATTERN, with_ids=True).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in df.collect():
        ids = libraries[0].encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()), len((r.text or "").encode()), ids))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes, list(r.ids)) for r in got) == sorted(want)
    assert round_trips(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_pieces_are_merged_apart_from_each_other():
    """Pre-tokens that are in the queue together get what each gets alone."""
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aabthein ") for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))) for _ in range(400)]
    assert BPE.merge_all(pieces) == [BPE.merge_all([p])[0] for p in pieces]


def test_merge_is_the_plain_rule():
    """Lowest rank first, leftmost first among equals, against a quadratic version, on long pre-tokens."""
    rng = random.Random(1)
    for n in (1, 2, 50, 3000):
        piece = bytes(rng.choice(b"abcn ie") for _ in range(n))
        parts = [piece[i : i + 1] for i in range(n)]
        while piece not in BPE.ranks and len(parts) > 1:
            rank, at = min((BPE.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert BPE.merge(piece) == ([BPE.ranks[piece]] if piece in BPE.ranks else [BPE.ranks[p] for p in parts])


def docs(spark):
    rows = [(i * 7 % 50 - 5, t, "zz", 3) for i, t in enumerate(ODD)] + [(None, "null id", "zz", 3), (4, None, None, 3), (4, "again", "en", 3), (4, "again", "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids int").withColumn("source", F.lit("s"))


def test_encode_decode_documents(spark, libraries):
    df = docs(spark)
    got = decode_documents(encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    want = sorted((str(r.doc_id), libraries[0].encode_ordinary(r.text or "")) for r in df.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((r.text or "").encode() for r in df.collect())
    assert encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_sstables(spark, libraries):
    df = docs(spark)
    path = scratch(spark, "t")
    write_sstables(df, WORDS, 2, path, shards=3)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = read_sstables(spark, path).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in rows]
    total = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == total
        total += len(r.ids) // 4
    encode = lambda t: libraries[1].encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted(zlib.crc32(bytes(r.ids)) for r in got) == sorted(zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for x in (encode(r.text) for r in rows))
    for key in (4, None, -5, 12):
        assert sorted(lookup(spark, path, key)) == sorted(encode(r.text) for r in rows if r.doc_id == key)
    assert lookup(spark, path, 10**12) == []
    assert [id_of(key_of(x)) for x in (None, -(2**63), 0, 2**63 - 1)] == [None, -(2**63), 0, 2**63 - 1]
    empty = scratch(spark, "t")
    write_sstables(df.limit(0), WORDS, 2, empty)
    assert read_sstables(spark, empty).count() == 0


def test_rollup(spark, libraries):
    df = docs(spark)
    counted = count_tokens(df, RANKS, P.PATTERN, "v1").cache()
    roll = TokenRollup(spark, scratch(spark, "t"))
    assert roll.totals().count() == 0
    assert roll.commit("b1", changes(inserted=counted)) and not roll.commit("b1", changes(inserted=counted))
    want = {}
    for r in df.collect():
        n, k = want.get(r.lang, (0, 0))
        want[r.lang] = (n + 1, k + len(libraries[0].encode_ordinary(r.text or "")))
    assert {r.lang: (r.n_docs, r.n_tokens) for r in roll.totals().collect()} == want
    zz = counted.filter("lang = 'zz'")
    roll.commit("b2", changes(deleted=zz))
    assert {r.lang: (r.n_docs, r.n_tokens) for r in roll.totals().collect()} == {k: v for k, v in want.items() if k != "zz"}
    # a revision: the old count goes, the new one comes
    en = counted.filter("lang = 'en'")
    roll.commit("b3", changes(inserted=en.withColumn("n_tokens", F.col("n_tokens") + 1), deleted=en))
    assert {r.lang: (r.n_docs, r.n_tokens) for r in roll.totals().collect()}["en"] == (want["en"][0], want["en"][1] + want["en"][0])
    assert roll.batches() == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        roll.commit("../x", changes(inserted=counted))
    # folds change nothing, nor does a replay after them, nor an attempt that was lost or came second
    before = sorted(map(str, roll.totals().collect()))
    assert roll.fold() == 3 and roll.fold() == 0
    roll.forget()
    assert sorted(map(str, roll.totals().collect())) == before and roll.batches() == ["b1", "b2", "b3"]
    assert not roll.commit("b1", changes(inserted=counted))
    counted.withColumn("n_docs", F.lit(1)).select("source", "lang", "tokenizer", "n_docs", "n_tokens").write.parquet(f"{roll.path}/attempts/lost")
    assert not roll._mark("bases/1", "lost")
    roll.commit("b4", changes(inserted=zz))
    later = TokenRollup(spark, roll.path)
    assert later.fold() == 1 and later.batches() == ["b1", "b2", "b3", "b4"]
    assert {r.lang: r.n_docs for r in roll.totals().collect()} == {k: n for k, (n, _) in want.items()}


def test_rollup_query_reaches_the_plain_totals(spark, libraries, tmp_path):
    """The query's totals, which come from signed batches, against counts of the library."""
    import tiktoken

    from metasieve.llm.queries import op3_token_rollup

    df = docs(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in df.collect():
        n, k = want.get(r.lang, (0, 0))
        want[r.lang] = (n + 1, k + len(library.encode_ordinary(r.text or "")))
    assert {r.lang: (r.n_docs, r.n_tokens) for r in op3_token_rollup(spark, str(tmp_path)).collect()} == want
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op3_token_rollup(spark, f"{tmp_path}/none").count() == 0
