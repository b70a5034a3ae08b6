"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (a word or word beginning learned from labels, with its log odds),
threat, target, negation, report, other. A pattern says that one symbol follows another within a
reach, and is compiled to a deterministic transducer with one accepting state. The transducers of all
patterns (insult, insult aimed at a target in either order, threat at a target, negation over an
insult or threat, reported speech in either order) are composed into one machine, which reads a
clause; at the clause's end its accepting states tell how the clause was meant, and the clause is
scored once: by the log odds of its insults or of a threat, times the weights of the patterns it matched. A
logistic curve over the sums of clauses, fitted on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.common import emit, forget, id_types, saved, worker_memo
from veritide.session import ship_package

WORD = regex.compile(r"[\p{L}']+")
#: Bound of the fit: labelled rows of each class.
SAMPLE_ROWS = 3_000
PREFIX = range(3, 9)
MIN_DOCS, MIN_ODDS, MIN_EVIDENCE = 3, 3.0, 14.0
#: Entries of a worker's memo of tokens, and (feature, count) pairs that a task holds before it gives them out.
MEMO, HELD = 80_000, 100_000
THRESHOLD = 0.3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
# Closed-class words of the four languages and verbs of threat.
WORDS = {
    TARGET: "you your you're u ur he she they them people du dich dir ihr euch sie tu te toi vous il elle ils tú ti usted ustedes vosotros él ella ellos",
    NEGATION: "not never no isn't aren't don't wasn't nicht nie kein keine keinen pas jamais aucun aucune ni nunca jamás ningún ninguna tampoco",
    REPORT: "said says say called calls wrote writes quoted reported claims claimed according sagte sagt nannte schrieb dit écrit appelle selon dijo dice escribió llamó según",
    THREAT: "kill hurt destroy burn beat hang shoot stab töte töten schlagen vernichten tuer frapper brûler détruire matar golpear quemar destruir",
}
SYMBOLS = {w: s for s, words in WORDS.items() for w in words.split()}

#: How a clause can be meant; one sum is kept for each.
PLAIN, AIMED, DENIED, TOLD, MENACE = range(5)
FAR = -1
#: Patterns: what they tell, the symbols of which one is followed by one of the others, and within how many words (FAR: any number).
PATTERNS = [
    ("insult", {INSULT}, None, 0),
    ("aimed", {TARGET}, {INSULT}, 6),
    ("aimed", {INSULT}, {TARGET}, 4),
    ("menace", {THREAT}, {TARGET}, 4),
    ("menace", {TARGET}, {THREAT}, 4),
    ("denied", {NEGATION}, {INSULT, THREAT}, 3),
    ("told", {REPORT}, {INSULT, THREAT}, FAR),
    ("told", {INSULT, THREAT}, {REPORT}, FAR),
]
#: What a clause's weight is multiplied by for what its patterns tell, and the log odds of a threat.
WEIGHTS, THREAT_ODDS = {"aimed": 1.5, "denied": 0.5, "told": 0.6}, 4.0


class Transducer:
    """One pattern, ``first`` and then ``second`` within ``reach`` words, or ``first`` alone: deterministic, over clauses.

    State 0 waits for ``first``; states 1 to ``reach`` count the words left for ``second``; the last
    one has matched and is kept.
    """

    def __init__(self, first: set[int], second: set[int] | None, reach: int):
        self.first, self.second, self.reach = first, second, max(reach, 1)
        self.far, self.matched = reach == FAR, max(reach, 1) + 1

    def step(self, state: int, symbol: int) -> int:
        if state == self.matched or (self.second is None and symbol in self.first) or (state and self.second and symbol in self.second):
            return self.matched
        if symbol in self.first:
            return self.reach
        return state if self.far else max(0, state - 1)


class Machine:
    """The composition of transducers: product states are made when first reached, and told by what they accept."""

    def __init__(self, parts: list[tuple[str, Transducer]]):
        self.parts = parts
        self.number = {(0,) * len(parts): 0}
        self.states, self.table = [(0,) * len(parts)], [[-1] * END]
        self.accepts = [frozenset()]

    def step(self, state: int, symbol: int) -> int:
        to = self.table[state][symbol]
        if to < 0:
            reached = tuple(t.step(s, symbol) for (_, t), s in zip(self.parts, self.states[state], strict=True))
            to = self.table[state][symbol] = self.number.setdefault(reached, len(self.states))
            if to == len(self.states):
                self.states.append(reached)
                self.table.append([-1] * END)
                self.accepts.append(frozenset(tells for (tells, t), s in zip(self.parts, reached, strict=True) if s == t.matched))
        return to


def compose() -> Machine:
    return Machine([(tells, Transducer(first, second, reach)) for tells, first, second, reach in PATTERNS])


def meaning(accepts: frozenset[str], insults: float) -> tuple[int, float]:
    """How a clause that ends in such a state was meant, and its weight; weight 0 if no clause pattern matched."""
    menace = "menace" in accepts
    if not menace and "insult" not in accepts:
        return PLAIN, 0.0
    weight = max(insults, THREAT_ODDS if menace else 0.0) * math.prod(WEIGHTS[x] for x in accepts if x in WEIGHTS)
    kind = TOLD if "told" in accepts else DENIED if "denied" in accepts else MENACE if menace else AIMED if "aimed" in accepts else PLAIN
    return kind, weight


class Grammar:
    """A lexicon of insults with weights, the symbols of words, and the machine."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.machine = lexicon, compose()
        self.memo: dict[str, tuple] = {}

    def weigh(self, word: str) -> float:
        found = [self.lexicon.get("=" + word, 0.0)]
        found += [self.lexicon[word[:n]] for n in PREFIX if n <= len(word) and word[:n] in self.lexicon]
        return max(found)

    def read(self, token: str) -> tuple[tuple[int, float], ...]:
        """Symbols of a whitespace-separated token, with weights."""
        out = []
        for word in WORD.findall(token):
            weight = self.weigh(word.strip("'"))
            out.append((INSULT, weight) if weight > 0 else (SYMBOLS.get(word, OTHER), 0.0))
        if token[-1:] in ".!?;:":
            out.append((END, 0.0))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        got = self.memo[token] = tuple(out)
        return got

    def clauses(self, text: str) -> Iterator[tuple[int, float]]:
        """(meaning, weight) of every clause that a pattern of insult or threat matches."""
        memo, step, accepts = self.memo, self.machine.step, self.machine.accepts
        for line in text.split("\n"):
            tokens = line.split()
            if not any(s == INSULT or s == THREAT for t in tokens for s, _ in (memo[t] if t in memo else self.read(t))):
                continue
            state, insults = 0, 0.0
            for token in [*tokens, "."]:
                for symbol, weight in memo[token] if token in memo else self.read(token):
                    if symbol != END:
                        state = step(state, symbol)
                        insults += weight
                    else:
                        kind, total = meaning(accepts[state], insults)
                        if total:
                            yield kind, total
                        state, insults = 0, 0.0

    def sums(self, text: str) -> np.ndarray:
        """Summed weights of matched clauses by the way they were meant."""
        sums = np.zeros(5)
        for kind, weight in self.clauses(text.lower()):
            sums[kind] += weight
        return sums


def features(sums: np.ndarray) -> np.ndarray:
    meant = sums[PLAIN] + sums[AIMED]
    return np.array([1.0, math.log1p(meant), math.log1p(sums[DENIED]), math.log1p(sums[TOLD]), math.log1p(sums[MENACE]), float(sums[:4].sum() > 0)])


def beginnings(text: str) -> tuple[set[str], str]:
    """Features of a text for the lexicon, and a key that near copies share."""
    words = {w.strip("'") for w in WORD.findall(text.lower())}
    words = {w for w in words if len(w) > 2}
    long = [w for w in words if len(w) > 7]
    rare = min(long, key=lambda w: (hash_of(w), w)) if len(long) > 4 else " ".join(sorted(words))
    return {"=" + w for w in words} | {w[:n] for w in words for n in PREFIX if n <= len(w)}, rare


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def sample_ids(labels: DataFrame, docs_held_out, id_col: str = "doc_id", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """(key, y): at most about ``rows`` labelled ids of each class, by a hash of the id, and each class's share."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~docs_held_out).select(F.col(id_col).alias("key"), F.col(label_col).alias("y"))
    known = known.groupBy("key").agg(F.max("y").cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, rows / sizes[y]) for y in sizes}
    limit = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return known.where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 20)) < limit * (1 << 20)), share


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, near-copy key) rows of texts."""
    forget()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for text in batch.column(0):
                found, key = beginnings(text.as_py() or "")
                yield from ((f, key) for f in found)

    return emit(rows(), pa.schema([("f", pa.string()), ("k", pa.string())]), lambda r: 24)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n) of texts."""
    forget()
    schema, counts = pa.schema([("f", pa.string()), ("n", pa.int64())]), Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(beginnings(text.as_py() or "")[0])
            if len(counts) > HELD:
                yield from emit(counts.items(), schema, lambda r: 24)
                counts.clear()
    yield from emit(counts.items(), schema, lambda r: 24)


def learn_lexicon(toxic: DataFrame, clean: DataFrame, n1: int, n0: int, text_col: str = "text") -> dict[str, float]:
    """Words ("=word") and word beginnings that labelled texts tie to toxicity, with log odds.

    Near copies of a toxic text count once, so that a word they share by descent proves nothing.
    Only what is telling enough comes to the driver, no matter how many words there are.
    """
    if not n1:
        return {}
    often = toxic.select(text_col).mapInArrow(_feature_rows, "f string, k string").groupBy("f").agg(F.count_distinct("k").alias("a")).where(F.col("a") >= MIN_DOCS)
    against = clean.select(text_col).mapInArrow(_feature_counts, "f string, n long").groupBy("f").agg(F.sum("n").alias("b"))
    both = often.join(against, "f", "left").select("f", F.col("a").cast("double").alias("a"), F.coalesce("b", F.lit(0)).cast("double").alias("b"))
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    odds = F.ln((F.col("a") + 0.5) / (n1 + 1)) - F.ln((F.col("b") + 0.5) / (n0 + 1))
    evidence = 2 * (F.col("a") * F.ln(F.col("a") / (n1 * share)) + F.when(F.col("b") > 0, F.col("b") * F.ln(F.col("b") / (n0 * share))).otherwise(0.0))
    telling = both.select("f", odds.alias("odds"), evidence.alias("evidence")).where((F.col("odds") >= MIN_ODDS) & (F.col("evidence") >= MIN_EVIDENCE))
    kept = {r.f: min(r.odds, 6.0) for r in telling.collect()}
    # The shortest beginning that is as telling stands for the longer ones and for the words.
    lean: dict[str, float] = {}
    for f in sorted(kept, key=lambda f: (len(f.lstrip("=")), f)):
        word = f.lstrip("=")
        shorter = [kept[word[:n]] for n in PREFIX if n < len(word) and word[:n] in lean]
        if not shorter or kept[f] > max(shorter) + 1.0:
            lean[f] = kept[f]
    return lean


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the intercept is not shrunk."""
    beta = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - shrink * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _measured(lexicon, schema: pa.Schema, rows_of):
    """mapInArrow function over (key, text), giving rows_of(grammar sums, key)."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = worker_memo(key, lambda: Grammar(lexicon.value))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield rows_of(grammar.sums(text.as_py() or ""), own)

        return emit(rows(), schema, lambda r: 32)

    return run


def fit(docs: DataFrame, labels: DataFrame, docs_held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, coefficients) from labelled rows that are not held out.

    Without labelled rows of both classes the lexicon is empty and every score is the base rate.
    Rows with a null id or text, or another label than 0 or 1, teach nothing; an id with several
    labels counts as toxic if one says so.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ids, share = sample_ids(labels, docs_held_out, id_col, label_col)
    # At most about 2 * SAMPLE_ROWS ids: the bound of the broadcast.
    texts = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen = saved(texts.join(F.broadcast(ids), "key").select("y", "text").where(F.col("text").isNotNull()), "toxicity-sample")
    n = {r[0]: r[1] for r in chosen.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        rate = 1e-3 if not n.get(1) else 0.5
        return {}, np.array([math.log(rate / (1 - rate)), 0, 0, 0, 0, 0])
    lexicon = learn_lexicon(chosen.where("y = 1"), chosen.where("y = 0"), n[1], n[0])
    sent = spark.sparkContext.broadcast(lexicon)
    schema = pa.schema([("y", pa.int32()), *[(f"s{i}", pa.float64()) for i in range(5)]])
    run = _measured(sent, schema, lambda sums, y: (y, *map(float, sums)))
    got = chosen.select("y", "text").mapInArrow(run, "y int, s0 double, s1 double, s2 double, s3 double, s4 double").toPandas()
    y = got["y"].to_numpy(float)
    x = np.array([features(s) for s in got[[f"s{i}" for i in range(5)]].to_numpy()])
    w = np.where(y == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
    return lexicon, fit_curve(x, y, w / w.mean())


def chance(sums: np.ndarray, beta: np.ndarray) -> float:
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(sums) @ beta))))))


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``predicted`` for every row.

    A null or empty text gets the score of a text in which nothing matches; null ids stay null;
    repeated rows each get a row, and equal texts equal scores; a very long text is read once, clause
    by clause; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    lexicon, beta = spark.sparkContext.broadcast(model[0]), model[1]
    kind, sql = id_types(docs, id_col)
    schema = pa.schema([("id", kind), ("score", pa.float64()), ("predicted", pa.int32())])

    def rows_of(sums: np.ndarray, key) -> tuple:
        p = chance(sums, beta)
        return key, p, int(p >= threshold)

    out = docs.selectExpr(f"`{id_col}` id", f"cast(`{text_col}` as string) text").mapInArrow(_measured(lexicon, schema, rows_of), f"id {sql}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns, whatever their names.

    Each row is judged by its own text: repeated rows stay or go together, ids do not matter and may
    be null or repeated; null and empty texts score as texts in which nothing matches.
    """
    spark = docs.sparkSession
    ship_package(spark)
    lexicon, beta, at = spark.sparkContext.broadcast(model[0]), model[1], docs.columns.index(text_col)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = worker_memo(key, lambda: Grammar(lexicon.value))
        for batch in batches:
            kept = [chance(grammar.sums(str(text.as_py() or "")), beta) < threshold for text in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
