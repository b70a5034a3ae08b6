"""Language identification by unigrams marginalised over segmentations.

The pieces are a fixed public vocabulary. For each language a piece has a probability; the score
of a word is the sum, over all its segmentations into pieces, of the product of their
probabilities (a forward algorithm), and a text's score is the sum of its words' log scores.
Probabilities are expected piece counts from a few rounds of expectation maximisation over a
bounded sample of labelled documents. A character that no piece covers is an edge of its own, whose
share of the probability is learned too and spread evenly over all letters, so that what a language
gives to pieces and uncovered characters sums to one. Words of any length are summed over all their
segmentations; long ones are rescaled on the way.
"""

from __future__ import annotations

import copy
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.common import emit, forget, id_types, saved, worker_memo
from veritide.session import ship_package

WORD = regex.compile(r"\p{L}+")
#: Words up to this length need no rescaling; longer ones are rescaled whenever so many characters are read.
PLAIN_CHARS, RESCALE = 48, 16
#: Words that the memo keeps, and their characters.
MEMO, MEMO_CHARS = 250_000, 1 << 23
#: Sampled documents that one language gives to the fit.
SAMPLE_DOCS = 300
ROUNDS = 3
#: Letters over which the probability of uncovered characters is spread, and its least share.
LETTERS, LEAST_OTHER = 1 << 17, 1e-3
#: Texts that are scored together, so that the lattice works on many words at once.
LOT_ROWS, LOT_BYTES = 2_000, 4 << 20
MARK = "▁"


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, lower-cased, with the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    ok = regex.compile(rf"{MARK}?\p{{L}}+|{MARK}")
    return sorted(p for p in found if ok.fullmatch(p))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Lattice:
    """All segmentations of many words at once, for K probability columns."""

    def __init__(self, pieces: list[str], probs: np.ndarray, other: np.ndarray):
        self.longest = max(map(len, pieces), default=1)
        chars = np.array(pieces, f"<U{self.longest}").view(np.uint32).reshape(len(pieces), self.longest).astype(np.uint64)
        lengths, key, known = np.array([len(p) for p in pieces], np.int64), np.zeros(len(pieces), np.uint64), []
        for n in range(self.longest):
            key = np.where(n < lengths, (key + chars[:, n]) * _BASE, key)
            known.append(key[n < lengths])
        #: Keys of all beginnings of pieces, and the piece that each is, -1 if it is none.
        self.beginnings = np.unique(np.concatenate(known))
        self.piece = np.full(len(self.beginnings), -1, np.int64)
        self.piece[np.searchsorted(self.beginnings, key)] = np.arange(len(pieces))
        self.probs, self.other, self.n_pieces = np.ascontiguousarray(probs), other, len(pieces)

    def column(self, k: int) -> Lattice:
        """The same pieces with the probabilities of one column."""
        out = copy.copy(self)
        out.probs, out.other = np.ascontiguousarray(self.probs[:, [k]]), self.other[[k]]
        return out

    def edges(self, chars: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, which words, which piece) for the pieces that begin at ``start``; words whose stretch begins no piece drop out."""
        if not len(self.beginnings):
            return
        words, key = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for end in range(start + 1, min(chars.shape[1], start + self.longest) + 1):
            key = (key + chars[words, end - 1]) * _BASE
            at = np.searchsorted(self.beginnings, key)
            at[at == len(self.beginnings)] = 0
            alive = self.beginnings[at] == key
            words, key, piece = words[alive], key[alive], self.piece[at[alive]]
            if not len(words):
                return
            whole = piece >= 0
            if whole.any():
                yield end, words[whole], piece[whole]

    def forward(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums over the segmentations of every beginning, and for long words the logs of the scales they are in."""
        n = chars.shape[1]
        alpha = np.zeros((n + 1, len(chars), len(self.other)))
        alpha[0] = 1.0
        scales = np.zeros_like(alpha) if n > PLAIN_CHARS else None
        for start in range(n):
            if scales is not None and start % RESCALE == 0:
                ahead = alpha[start : start + self.longest + 1]
                most = ahead.max(axis=0)
                ahead /= most
                scales[start:] += np.log(most)
            alpha[start + 1] += alpha[start] * self.other
            for end, hit, piece in self.edges(chars, start):
                alpha[end, hit] += alpha[start, hit] * self.probs[piece]
        return alpha, scales

    def log_scores(self, words: list[str]) -> np.ndarray:
        """One row for each word: the log of the sum over its segmentations."""
        out = np.zeros((len(words), len(self.other)))
        for n, at in by_length(words):
            alpha, scales = self.forward(_chars([MARK + words[i] for i in at]))
            out[at] = np.log(alpha[n]) + (0 if scales is None else scales[n])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the counted words, and at the end those of uncovered characters, for a single column."""
        uses = np.zeros(self.n_pieces + 1)
        for n, at in by_length(words):
            chars, weight = _chars([MARK + words[i] for i in at]), counts[at]
            alpha, scales = self.forward(chars)
            alpha = alpha[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[n] = 1.0
            back = np.zeros(len(at))
            for start in range(n - 1, -1, -1):
                if scales is not None and (n - 1 - start) % RESCALE == 0:
                    ahead = beta[start + 1 : start + 1 + self.longest]
                    most = ahead.max(axis=0)
                    ahead /= most
                    back += np.log(most)
                share = weight / alpha[n] if scales is None else weight / alpha[n] * np.exp(scales[start, :, 0] + back - scales[n, :, 0])
                beta[start] = beta[start + 1] * self.other[0]
                uses[-1] += (share * alpha[start] * beta[start]).sum()
                for end, hit, piece in self.edges(chars, start):
                    through = self.probs[piece, 0] * beta[end, hit]
                    beta[start, hit] += through
                    np.add.at(uses, piece, share[hit] * alpha[start, hit] * through)
        return uses


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length with the mark, which words) in lots of bounded size."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
        n = int(lengths[group[0]])
        step = max(1, min(4096, (1 << 18) // n))
        for i in range(0, len(group), step):
            yield n, group[i : i + step]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _chars(same_length: list[str]) -> np.ndarray:
    n = len(same_length[0])
    return np.array(same_length, f"<U{n}").view(np.uint32).reshape(len(same_length), n).astype(np.uint64)


class Scores:
    """Word -> row of log scores; the memo is bounded."""

    def __init__(self, pieces: list[str], probs: np.ndarray, other: np.ndarray):
        self.lattice, self.k = Lattice(pieces, probs, other), len(other)
        self.drop()

    def drop(self) -> None:
        self.at, self.table, self.used, self.held = {}, np.zeros((1024, self.k)), 0, 0

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        if self.used + len(new) > MEMO or self.held > MEMO_CHARS:
            self.drop()
            new = [*words]
        if self.used + len(new) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), self.used + len(new)), self.k))
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        self.table[self.used : self.used + len(new)] = self.lattice.log_scores(new)
        self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)
        self.held += sum(map(len, new))

    def ready(self, lots: list[list[str]]) -> Iterator[list[list[str]]]:
        """``lots`` in runs whose words are all held, so that the lattice never works for a single text, unless one has too many words."""
        words = set().union(*lots)
        if len(words) <= MEMO // 2:
            self.add(words)
            yield lots
        elif len(lots) == 1:
            yield lots
        else:
            yield from self.ready(lots[: len(lots) // 2])
            yield from self.ready(lots[len(lots) // 2 :])

    def total(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.k)
        for i in range(0, len(words), MEMO // 4):  # a text may hold more different words than the memo
            part = words[i : i + MEMO // 4]
            try:
                at = [*map(self.at.__getitem__, part)]
            except KeyError:
                self.add(set(part))
                at = [*map(self.at.__getitem__, part)]
            total += self.table[at].sum(axis=0)
        return total


def fit(train: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, id_col: str = "doc_id"):
    """(languages, piece probabilities [piece, language], probability of an uncovered character).

    The fit takes about ``sample_docs`` documents of each language, chosen by a hash of the id, so
    that neither a common language nor the corpus size matters. Rows without text or language
    teach nothing.
    """
    spark = train.sparkSession
    train = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces), 0)), np.zeros(0)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / sizes[k]))])
    chosen = train.where(F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << 20)) < F.try_element_at(share, F.col(lang_col)) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.update((lang, w) for w in words_of(text.as_py()))
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        yield from emit(((*k, v) for k, v in counts.items()), schema, lambda r: 40)

    words = saved(
        chosen.select(lang_col, text_col).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "langid-words",
    )
    probs, other = np.full((len(pieces), len(langs)), (1 - LEAST_OTHER) / len(pieces)), np.full(len(langs), LEAST_OTHER / LETTERS)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, probs, other))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, lattice = np.zeros((len(pieces) + 1, len(langs))), Lattice(*model.value)
            for batch in batches:
                lang, word, n = (np.array(c.to_pylist(), dtype=object) for c in batch.columns)
                for k, name in enumerate(langs):
                    if (own := lang == name).any():
                        sums[:, k] += lattice.column(k).expected([*word[own]], n[own].astype(float))
            at = np.argwhere(sums > 0)
            schema = pa.schema([("piece", pa.int32()), ("k", pa.int32()), ("uses", pa.float64())])
            yield from emit(((int(i), int(k), float(sums[i, k])) for i, k in at), schema, lambda r: 16)

        # At most one row for each piece and language comes back.
        got = words.repartition(16, "word").mapInArrow(expect, "piece int, k int, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("uses")).collect()
        uses, uncovered = np.zeros_like(probs), np.zeros(len(langs))
        for r in got:
            if r.piece < len(pieces):
                uses[r.piece, r.k] = r.uses
            else:
                uncovered[r.k] = r.uses
        share = np.maximum(LEAST_OTHER, uncovered / np.maximum(uncovered + uses.sum(axis=0), 1e-12)).clip(max=0.5)
        other = share / LETTERS
        shared = uses.sum(axis=1, keepdims=True) / max(uses.sum(), 1e-9)
        smooth = uses + 0.02 * uses.sum(axis=0) * (0.5 * shared + 0.5 / len(pieces))
        probs = (1 - share) * smooth / np.maximum(smooth.sum(axis=0), 1e-12)
        model.unpersist()
    return langs, probs, other


def identify(docs: DataFrame, model: tuple, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (the predicted language's posterior, with text
    log scores divided by the square root of the number of words).

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.
    Ties go to the first language in order. Repeated rows each get a row; null ids stay null and ids
    may be of any type; a very long text, or a very long word, is scored whole; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    langs, probs, other = model
    sent = spark.sparkContext.broadcast((pieces, probs, other))
    key = uuid.uuid4().hex
    kind, sql = id_types(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(key, lambda: Scores(*sent.value))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                texts = batch.column(1)
                step = max(1, min(LOT_ROWS, int(LOT_BYTES * len(texts) / max(1, texts.nbytes))))
                for i in range(0, len(texts), step):
                    lots = [words_of(t.as_py() or "") for t in texts.slice(i, step)]
                    held = chain.from_iterable(memo.ready(lots))
                    for row, words in zip(batch.column(0).slice(i, step).to_pylist(), held, strict=True):
                        if not langs or not words:
                            yield row, "und", 0.0
                            continue
                        total = memo.total(words) / math.sqrt(len(words))
                        best = int(total.argmax())
                        yield row, langs[best], float(1 / np.exp(total - total[best]).sum())

        schema = pa.schema([("id", kind), ("lang_pred", pa.string()), ("score", pa.float64())])
        return emit(rows(), schema, lambda r: 32)

    out = docs.selectExpr(f"`{id_col}` id", f"cast(`{text_col}` as string) text").mapInArrow(run, f"id {sql}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
