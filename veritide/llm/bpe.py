"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into fixed-size chunks that overlap. Each chunk is pre-tokenised on its own (in
parallel for long texts), and the pieces are stitched where the boundaries of two neighbouring
chunks agree: the pattern looks only forward, so from a common boundary on both chunks give the
same pieces. Pieces are then encoded one by one through a bounded memo. Decoding concatenates
the bytes of the ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veritide.llm.common import emit, id_types, worker_memo
from veritide.session import ship_package

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pieces kept by a worker's memo, and the longest piece that is kept.
MEMO, MEMO_CHARS = 60_000, 64


def compile_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with Unicode white space, as Rust's regular expressions define it."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def chunk_ends(split: regex.Pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pieces of text[start:stop] that no character past ``stop`` can change."""
    ends = [m.end() for m in split.finditer(text, start, stop, concurrent=True)]
    if stop < len(text):
        while ends and ends[-1] > stop - 2:
            ends.pop()
    return ends


def piece_ends(split: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 2) -> list[int]:
    """Ends of all pieces of ``text``, from overlapping chunks stitched at common boundaries."""
    n = len(text)
    windows = [(s, min(n, s + chunk + overlap)) for s in range(0, n, chunk)]
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(lambda w: chunk_ends(split, text, *w), windows))
    ends: list[int] = []
    at = 0
    for (start, _), part in zip(windows, parts, strict=True):
        index = {e: i for i, e in enumerate(part)}
        index[start] = -1
        if at not in index and part and at < part[-1]:
            for m in split.finditer(text, at):  # no common boundary in the overlap: go on alone until there is one
                at = m.end()
                ends.append(at)
                if at in index or at >= part[-1]:
                    break
        if at in index:
            ends += part[index[at] + 1 :]
            at = ends[-1] if ends else 0
    ends += [m.end() for m in split.finditer(text, at)]
    return ends


def pieces(split: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    if len(text) <= chunk:
        return split.findall(text)
    ends = piece_ends(split, text, chunk, overlap)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Codec(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; also decodes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = compile_pattern(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.core.encode_single_piece(piece.encode())).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pieces(self.split, text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``id_col``, ``ids`` (little-endian unsigned 32-bit integers) and, if asked for, ``decoded`` (raw bytes).

    One row per input row, repeated rows included; ties mean nothing here. A null text counts as
    empty (no ids); a null id stays null and ids may be of any type; an empty table gives an empty
    result; other columns are ignored. A very long text is cut into chunks; memory is that of one
    text, its pieces and one output batch.
    """
    ship_package(docs.sparkSession)
    kind, sql = id_types(docs, id_col)
    names = [("id", kind), ("ids", pa.binary())] + ([("decoded", pa.binary())] if decode else [])
    schema = pa.schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memo(f"bpe {path} {pattern}", lambda: Codec(path, pattern))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = coder.encode(text.as_py() or "")
                    yield (key, ids, coder.decode(ids)) if decode else (key, ids)

        return emit(rows(), schema, lambda r: sum(map(len, r[1:])))

    out = docs.selectExpr(f"`{id_col}` id", f"cast(`{text_col}` as string) text").mapInArrow(
        run, f"id {sql}, ids binary" + ", decoded binary" * decode
    )
    return out.withColumnRenamed("id", id_col)
