"""Token counts by a two-tier lookup on the map side.

A byte-level tokenizer cuts a text into pre-tokens by a pattern and encodes each on its own, so their
lengths add up. Tier one is a broadcast table of the lengths of frequent pre-tokens: those that a
public vocabulary, learned from frequent text, holds whole. It is compact (the pre-tokens as one
string, a byte of length for each) and its size is that of the vocabulary, whatever the corpus. Tier
two is a worker's memo of the lengths of all other pre-tokens, filled by the tokenizer. One pass over
the documents; nothing is shuffled and nothing comes to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veritide.llm.bpe import compile_pattern
from veritide.llm.common import emit, id_types, worker_memo
from veritide.session import ship_package

#: Pre-tokens that a worker's memo keeps, and the longest one that it or the table keeps.
MEMO, KEPT_CHARS = 150_000, 64
#: Entries of the broadcast table at most.
TABLE_ENTRIES = 1 << 17
#: Fixed value: the split pattern of byte-level tokenizers that name none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """A tokenizer of the library ``tokenizers``, and the pattern of its pre-tokens (none: texts are counted whole)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before = kind.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer")
        self.pattern = BYTE_LEVEL if plain else None

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def frequent_lengths(path: str, entries: int = TABLE_ENTRIES) -> tuple[str, bytes]:
    """The compact table: pre-tokens that the vocabulary holds whole, joined by null characters, and their lengths."""
    tokens = Tokens(path)
    if tokens.pattern is None:
        return "", b""
    split = compile_pattern(tokens.pattern)
    tokenizer = tokens.tokenizer
    words = tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False)
    whole = [w for w in words if w and "�" not in w and "\0" not in w and len(w) <= KEPT_CHARS and split.fullmatch(w) and split.findall(w) == [w]][:entries]
    lengths = [len(e.ids) for e in tokenizer.encode_batch(whole, add_special_tokens=False)]
    return "\0".join(whole), bytes(min(n, 255) for n in lengths)


class Lengths(dict):
    """Pre-token -> number of tokens: from the broadcast table, then a memo, then the tokenizer."""

    def __init__(self, path: str, table: tuple[str, bytes]):
        super().__init__()
        self.tokens = Tokens(path)
        self.frequent = dict(zip(table[0].split("\0"), table[1], strict=True)) if table[1] else {}
        self.update(self.frequent)
        self.split = compile_pattern(self.tokens.pattern) if self.tokens.pattern else None

    def __missing__(self, piece: str) -> int:
        n = self.tokens.count(piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= MEMO + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def of(self, text: str) -> int:
        if self.split is None or any(s in text for s in self.tokens.special):
            return self.tokens.count(text)  # a special token may end inside a pre-token
        return sum(map(self.__getitem__, self.split.findall(text)))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row.

    A null text counts as empty; null ids stay null and ids may be of any type; repeated rows each
    get a row, and ties mean nothing here; a very long text is held whole, with its pre-tokens; an
    empty table gives an empty result; other columns are ignored. The counts are those of the
    tokenizer on the whole text, whatever the table holds.
    """
    spark = docs.sparkSession
    ship_package(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(path, entries))
    key = uuid.uuid4().hex
    kind, sql = id_types(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = worker_memo(key, lambda: Lengths(path, table.value))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py() or ""
                    n = lookup.of(text)
                    yield row, len(text.encode()), n, n > limit

        schema = pa.schema([("id", kind), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        return emit(rows(), schema, lambda r: 32)

    out = docs.selectExpr(f"`{id_col}` id", f"cast(`{text_col}` as string) text").mapInArrow(run, f"id {sql}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
