import base64
import random
from array import array

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from veritide.llm.bpe import CHUNK, Codec, compile_pattern, encode_texts, piece_ends
from veritide.llm.common import emit
from veritide.llm.token_counts import Lengths, count_tokens, frequent_lengths

RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, extra string, id string"
HARD = ["", None, "a", "  two  spaces \n\n\tand  tabs ", "x" * 3000, "é" * 500 + "漢字 " * 200, "a b   c\x1cd", "it's we'll I'D", "<|endoftext|> in text", "12345 67,8!!", " lead", "trail ", "a \nb", "\x1f \x1f"]


def plain(text):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "e", "clash") for i, t in enumerate(texts)] + [(None, "null id", None, None), (0, texts[0], None, None)], DOCS)


def test_ids_and_bytes_are_those_of_the_library(spark):
    rows = encode_texts(table(spark, HARD), RANKS, P.PATTERN).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else HARD[r.doc_id]
        assert list(array("I", bytes(r.ids))) == plain(text)
        assert bytes(r.decoded) == (text or "").encode()


def test_chunks_stitch_at_any_size():
    rng = random.Random(4)
    split = compile_pattern(P.PATTERN)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "1", "!", "é", "'s", "wordy"]) for _ in range(rng.randint(0, 400)))
        whole = [m.end() for m in split.finditer(text)]
        for chunk, overlap in ((7, 3), (16, 1), (40, 30), (5, 60)):
            assert piece_ends(split, text, chunk, overlap) == whole
    long = "y" * 5000 + " z"
    assert piece_ends(split, long, 100, 10) == [5000, 5002]


def test_decoding_is_a_round_trip():
    coder = Codec(RANKS, P.PATTERN)
    for text in HARD:
        assert coder.decode(coder.encode(text or "")).decode() == (text or "")


def test_counts_are_those_of_the_tokenizer(spark):
    known = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = HARD + ["the cat sat on the mat " * 300, "déjà " * 40_000 + "x" * 30_000]
    for entries in (0, 100):
        rows = count_tokens(table(spark, texts), P.path("byte_bpe_50k.json"), 1024, entries=entries).collect()
        for r in rows:
            text = "null id" if r.doc_id is None else texts[r.doc_id] or ""
            n = len(known.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024), text[:30]


@pytest.mark.parametrize("what", ["bpe", "counts"])
def test_empty_table(spark, what):
    none = spark.createDataFrame([], DOCS)
    out = encode_texts(none, RANKS, P.PATTERN) if what == "bpe" else count_tokens(none, P.path("byte_bpe_50k.json"))
    assert out.count() == 0


def test_texts_of_many_chunks_and_text_ids(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["wörd", "a", "  ", "\n", "123", "it's", "!?", "漢字"]) for _ in range(60_000)), "z" * (CHUNK + 500) + " tail", " " * (CHUNK + 100) + "end"]
    assert all(len(t) > CHUNK for t in texts)
    docs = spark.createDataFrame([(f"d{i}", t, 1, 2) for i, t in enumerate(texts)], "doc_id string, text string, ids int, decoded int")
    for r in encode_texts(docs, RANKS, P.PATTERN).collect():
        text = texts[int(r.doc_id[1:])]
        assert list(array("I", bytes(r.ids))) == plain(text) and bytes(r.decoded).decode() == text
    assert {r.doc_id for r in count_tokens(docs, P.path("byte_bpe_50k.json")).collect()} == {"d0", "d1", "d2"}


def test_the_table_holds_lengths_of_whole_pre_tokens():
    path = P.path("byte_bpe_50k.json")
    words, lengths = frequent_lengths(path)
    assert len(words.split("\0")) == len(lengths) > 40_000 and len(words) < 1_000_000
    known = Lengths(path, (words, lengths))
    rng = random.Random(1)
    for word in rng.sample(sorted(known.frequent), 2_000):
        assert known.frequent[word] == len(known.tokens.tokenizer.encode(word, add_special_tokens=False).ids)


def test_other_tokenizers_count_whole_texts(spark):
    path = P.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    for r in count_tokens(table(spark, HARD), path).collect():
        text = "null id" if r.doc_id is None else HARD[r.doc_id] or ""
        assert r.n_tokens == len(known.encode(text, add_special_tokens=False).ids)


def test_output_batches_are_small_and_whole():
    rows = [(i, bytes(100_000 + i)) for i in range(100)]
    batches = list(emit(iter(rows), pa.schema([("id", pa.int64()), ("ids", pa.binary())]), lambda r: len(r[1])))
    assert max(b.nbytes for b in batches) < 3 << 20
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows
