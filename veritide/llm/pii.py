"""Personal data: exact base patterns, and terms that disclose what the patterns protect.

Base spans (email, ip, card, phone) are found in every text. Over all documents, the information
that a term gives about a protected value is measured by their co-occurrence:
log(P(value|term) / P(value)) / -log P(value), 1 for a term that occurs with that value only. Every
term of a document that holds a value is measured; a term at or above the threshold is a span
wherever it stands in any document. When a text is sanitised, such a term is generalised to the
first half of its characters, if all terms that begin like that disclose less than the threshold
about every value that it disclosed; else it is removed, as base spans are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.common import OUT_BYTES, emit, forget, fresh, id_types, saved
from veritide.session import ship_package

KINDS = ("email", "ip", "card", "phone", "term")
#: Least disclosure, and least number of documents in which term and value meet.
DISCLOSURE, SUPPORT = 0.8, 2
#: Bits of the filter that tells which words may be context terms: its size is fixed.
FILTER_BITS = 1 << 23
MEMO = 100_000
#: Texts in which a task meets a term before it reports it as frequent.
OFTEN = 3
#: Disclosing terms up to which they are broadcast; beyond it their occurrences are joined with them.
BROADCAST_ROWS = 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"\d")
_JOINS = str.maketrans("", "", "-'’")
_EDGE = ".,;:!?()[]{}<>\"'`*#$%&|/\\-–—…¿¡«»“”‘’=+_~^@"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0  # free: the first character that no match has taken
    while at >= 0:
        seg = text[free:at]
        start = at - len(seg) + len(seg.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7 or text.count(".", run.start(), run.end()) < 3:
            continue
        at = run.start()
        while at < run.end():
            m = _IP.match(text, at, run.end())
            if m is None:  # no address begins in this group of digits
                at = text.find(".", at, run.end())
                if at < 0:
                    break
                while at < run.end() and text[at] == ".":
                    at += 1
                continue
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                yield m.span()
            at = m.end()
            while at < run.end() and text[at] == ".":
                at += 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, in order."""
    return sorted((s, k, e) for k, find in enumerate((emails, ips, cards, phones)) for s, e in find(text))


def term_of(word: str) -> str:
    """Letters and digits, with hyphens and apostrophes between them; else nothing."""
    word = word.lower().strip(_EDGE)
    return word if len(word) > 1 and word.translate(_JOINS).isalnum() else ""


def value_of(text: str, start: int, kind: int, end: int) -> str:
    """A key of a protected value: a hash of the whole of it."""
    return hashlib.blake2b(f"{kind}:{text[start:end].lower()}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def places(text: str, base: list[tuple[int, int, int]], among: set[str] | None = None) -> Iterator[tuple[str, int, int]]:
    """Every term of a text, of the words ``among`` if given, outside its base spans (which are in order), with its place."""
    at = 0
    for m in re.finditer(r"\S+", text):
        if (among is None or m[0] in among) and (term := term_of(m[0])):
            a = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
            b = a + len(m[0].strip(_EDGE))
            while at < len(base) and base[at][2] <= a:
                at += 1
            if at == len(base) or base[at][0] >= b:
                yield term, a, b


def generalised(term: str) -> str:
    """A broader term: the first half of the characters."""
    return term[: (len(term) + 1) // 2] + "*"


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_MARK = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("to", pa.string())]))
_NEAR = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def bit_filter(keys: DataFrame, name: str) -> Broadcast:
    """A bit filter of fixed size over a column of strings, broadcast."""
    spark = keys.sparkSession
    bits = np.zeros(FILTER_BITS, bool)
    found = keys.select(F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(FILTER_BITS)).alias("bit")).distinct()
    packed = found.groupBy((F.col("bit") / 4096).cast("int").alias("page")).agg(F.collect_list(F.pmod("bit", F.lit(4096)).cast("int")).alias("bits"))
    for row in packed.toLocalIterator():  # at most FILTER_BITS numbers
        bits[row.page * 4096 + np.array(row.bits)] = True
    return spark.sparkContext.broadcast(np.packbits(bits))


def passes(sent: Broadcast) -> Callable[[str], bool]:
    flags = np.unpackbits(sent.value).tobytes()
    return lambda key: flags[zlib.crc32(key.encode("utf-8", "surrogatepass")) % FILTER_BITS] == 1


def passing(sent: Broadcast) -> Callable[[set[str]], set[str]]:
    """Those of many keys that the filter holds."""
    flags, crc = np.unpackbits(sent.value).tobytes(), zlib.crc32

    def of(keys: set[str]) -> set[str]:
        try:
            return {k for k in keys if flags[crc(k.encode()) % FILTER_BITS]}
        except UnicodeEncodeError:
            return {k for k in keys if flags[crc(k.encode("utf-8", "surrogatepass")) % FILTER_BITS]}

    return of


def lowered(text: str) -> set[str]:
    """The different words of a text in lower case. Commas and full stops at their ends are no part of a term, and
    without them more words are the same, or letters only."""
    return set(text.lower().replace(", ", " ").replace(". ", " ").replace(".\n", "\n").split())


def tally(docs: DataFrame, names: list[str], each: Callable[[], Callable[[str], Iterator[tuple]]], text_col: str) -> DataFrame:
    """names, n: in how many texts each key stands; ``each`` makes what yields the keys of a text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        of, counts = each(), Counter()
        schema = pa.schema([*((name, pa.string()) for name in names), ("n", pa.int64())])
        rows = lambda: emit(((*k, n) for k, n in counts.items()), schema, lambda r: 48)
        for batch in batches:
            for text in batch.column(0):
                for key in of(text.as_py() or ""):
                    counts[key] += 1
                    if len(counts) > MEMO:
                        yield from rows()
                        counts.clear()
        yield from rows()

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, ", ".join(f"{name} string" for name in names) + ", n long")
    return counted.groupBy(*names).agg(F.sum("n").alias("n"))


def reader() -> Callable[[str, list[tuple[int, int, int]]], set[str]]:
    """A function that gives the terms of a text outside its base spans, once each.

    Only words with digits can lie in a base span without being part of an address, so others are
    taken by their text alone: those of letters as they are, the rest through a memo.
    """
    memo: dict[str, str] = {}

    def of_word(word: str) -> str:
        if len(memo) >= MEMO:
            memo.clear()
        memo[word] = term = term_of(word)
        return term

    def of(text: str, base: list[tuple[int, int, int]]) -> set[str]:
        words = lowered(text)
        found = {w for w in words if w.isalpha() and len(w) > 1}
        words -= found
        numbered = {w for w in words if _DIGIT.search(w)} if base else set()
        found |= {memo[w] if w in memo else of_word(w) for w in words - numbered}
        if numbered:
            found |= {t for t, _, _ in places(text, base, {w for w in set(text.split()) if _DIGIT.search(w)})}
        found.discard("")
        return found

    return of


def values_and_frequent_terms(docs: DataFrame, text_col: str) -> DataFrame:
    """(value, term, n): in how many texts each value stands, and of terms that a task met OFTEN or more the texts it counted.

    Of a term's texts the latter are some, of a value's all.
    """
    schema = pa.schema([("value", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        read, values, terms = reader(), Counter(), Counter()

        def rows() -> Iterator[tuple]:
            yield from ((v, None, n) for v, n in values.items())
            yield from ((None, t, n) for t, n in terms.items() if n >= OFTEN)
            values.clear()
            terms.clear()

        for batch in batches:
            for text in batch.column(0):
                base = base_spans(text := text.as_py() or "")
                values.update({value_of(text, s, k, e) for s, k, e in base})
                terms.update(read(text, base))
                if len(values) > MEMO or len(terms) > 2 * MEMO:
                    yield from emit(rows(), schema, lambda r: 48)
        yield from emit(rows(), schema, lambda r: 48)

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "value string, term string, n long")
    return counted.groupBy("value", "term").agg(F.sum("n").alias("n"))


def whole_pairs(docs: DataFrame, support: int, disclosure: float, n: int, text_col: str) -> DataFrame:
    """(value, term, n_vt, n_v) of the terms in documents that hold a value, met in ``support`` documents or more, whose
    disclosure may reach the threshold.

    Only values that stand in so many documents are paired; a bit filter tells them. What is known of
    a term's number of documents bounds its disclosure from above: those that hold it with any such
    value, and those of tasks that met it often.
    """
    counted = saved(values_and_frequent_terms(docs, text_col), "pii-values")
    held = counted.where(F.col("value").isNotNull() & (F.col("n") >= support)).select("value", F.col("n").alias("n_v"))
    often = counted.where("term is not null").select("term", F.col("n").alias("n_o"))
    sent = bit_filter(held, "value")

    def each() -> Callable[[str], Iterator[tuple]]:
        recurs, read = passes(sent), reader()

        def of(text: str) -> Iterator[tuple]:
            base = base_spans(text)
            known = [v for v in {value_of(text, s, k, e) for s, k, e in base} if recurs(v)] if base else []
            return ((v, t) for t in (read(text, base) if known else ()) for v in ("", *known))

        return of

    met = saved(tally(docs, ["value", "term"], each, text_col).where((F.col("n") >= support) | (F.col("value") == "")), "pii-met")
    seen = met.where("value = ''").select("term", F.col("n").alias("n_m"))
    pairs = met.where("value <> ''").withColumnRenamed("n", "n_vt").join(held, "value").join(seen.join(often, "term", "left"), "term")
    pairs = pairs.withColumn("least", F.greatest("n_m", F.coalesce("n_o", F.lit(0))))
    return saved(pairs.where(told("n_vt", "least", "n_v", n) >= disclosure).drop("n_m", "n_o", "least"), "pii-pairs")


def term_documents(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): the number of documents that hold each candidate term, over all documents.

    A bit filter of fixed size, broadcast, drops nearly all other words before anything is counted;
    tasks count what is left, and the join with ``terms`` makes it exact.
    """
    sent = bit_filter(terms, "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        may, among, memo, counts = passes(sent), passing(sent), {}, Counter()
        schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

        def wanted(word: str) -> str:
            term = term_of(word)
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = got = term if term and may(term) else ""
            return got

        for batch in batches:
            for text in batch.column(0):
                words = lowered(text.as_py() or "")
                plain = {w for w in words if w.isalpha()}  # terms as they are
                found = among(plain) | {memo[w] if w in memo else wanted(w) for w in words - plain}
                found.discard("")
                counts.update(found)
                if len(counts) > MEMO:
                    yield from emit(counts.items(), schema, lambda r: 24)
                    counts.clear()
        yield from emit(counts.items(), schema, lambda r: 24)

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return terms.join(counted, "term")


def told(n_vt: str, n_t: str, n_v: str, n: int):
    """The information that a term gives about a value, from numbers of documents."""
    n = float(max(2, n))
    both, term, value = (F.col(c).cast("double") for c in (n_vt, n_t, n_v))
    return F.ln(both * n / (term * value)) / F.ln(n / F.least(value, F.lit(n - 0.5)))


def disclosing(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """(term, to): the terms whose disclosure of a value reaches the threshold, and what to put in their place."""
    n = docs.count()
    pairs = whole_pairs(docs, support, disclosure, n, text_col)
    known = term_documents(docs, pairs.select("term").distinct(), text_col)
    flagged = saved(pairs.join(known, "term").where(told("n_vt", "n_t", "n_v", n) >= disclosure).select("value", "term", "n_v"), "pii-flagged")
    half = F.substring("term", F.lit(1), ((F.length("term") + 1) / 2).cast("int"))
    wide = flagged.withColumn("broad", F.concat(half, F.lit("*")))
    values, halves = bit_filter(flagged, "value"), bit_filter(flagged.withColumn("half", half), "half")

    def each() -> Callable[[str], Iterator[tuple]]:
        asked, among, read = passes(values), passing(halves), reader()

        def of(text: str) -> Iterator[tuple]:
            base = base_spans(text)
            found = {f"{h}*" for h in among({t[: (len(t) + 1) // 2] for t in read(text, base)})}
            known = [v for v in {value_of(text, s, k, e) for s, k, e in base} if asked(v)] if base and found else []
            return ((v, g) for g in found for v in ("", *known))

        return of

    counts = saved(tally(docs, ["value", "broad"], each, text_col), "pii-broad")
    of_all = counts.where("value = ''").select("broad", F.col("n").alias("n_b"))
    measured = wide.join(counts.select("value", "broad", F.col("n").alias("n_vb")), ["value", "broad"], "left").join(of_all, "broad", "left")
    open_ = F.coalesce(told("n_vb", "n_b", "n_v", n) >= disclosure, F.lit(True))
    return saved(measured.groupBy("term", "broad").agg(F.max(open_).alias("open")).select("term", F.when(F.col("open"), F.lit("<term>")).otherwise(F.col("broad")).alias("to")), "pii-terms")


def marker(may: Callable[[str], bool]) -> Callable[[str, list], list[tuple[str, int, int]]]:
    """A function that gives the places of a text's terms for which ``may`` holds, outside its base spans.

    Words are looked up in lower case first; few texts have any such term, and only those are read as they are written.
    """
    memo: dict[str, bool] = {}

    def held(word: str) -> bool:
        if word.isalpha():
            return may(word)
        if word not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = bool(term := term_of(word)) and may(term)
        return memo[word]

    def of(text: str, base: list) -> list[tuple[str, int, int]]:
        if not any(map(held, lowered(text))):
            return []
        some = {w for w in set(text.split()) if held(w.lower())}
        return list(places(text, base, some)) if some else []

    return of


def sent_terms(flagged: DataFrame) -> Broadcast | None:
    """The terms with their replacements, if they are few enough to be broadcast."""
    if flagged.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    return flagged.sparkSession.sparkContext.broadcast({r.term: r.to for r in flagged.collect()})


def marks_of(text: str, terms: dict[str, str], mark: Callable) -> tuple[list, list]:
    """(base spans, all spans with replacements) of a text."""
    base = base_spans(text)
    added = [(a, len(KINDS) - 1, b, terms[t]) for t, a, b in mark(text, base)]
    return base, sorted([(s, k, e, f"<{KINDS[k]}>") for s, k, e in base] + added)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``id_col``, ``fp`` (a hash of the text), ``base`` and ``spans``: arrays of (start, kind, end) by start, then kind,
    ``spans`` with ``to``, what to put in the place.

    One row per input row, repeated rows included. A null text counts as empty; null ids stay
    null; an empty table gives an empty result; other columns are ignored; ties are none, since
    every term that reaches the threshold is taken. A very long text is held whole, with its spans.
    A term needs ``support`` documents that hold it with its value: with one, every word that
    stands in no other document would disclose all values beside it.
    """
    ship_package(docs.sparkSession)
    return _found(docs, disclosing(docs, disclosure, support, text_col), id_col, text_col)


def _found(docs: DataFrame, flagged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sent, kind_sql = sent_terms(flagged), id_types(docs, id_col)
    base_sql, span = "array<struct<start:int,kind:int,end:int>>", lambda s: dict(zip(("start", "kind", "end", "to"), s, strict=False))
    given = docs.select(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")), F.col(f"`{text_col}`").cast("string"))

    if sent is not None:
        schema = pa.schema([("id", kind_sql[0]), ("fp", pa.int64()), ("base", _SPAN), ("spans", _MARK)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            terms = sent.value
            mark = marker(terms.__contains__)

            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for key, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                        base, spans = marks_of(text.as_py() or "", terms, mark)
                        yield key, fp, [*map(span, base)], [*map(span, spans)]

            return emit(rows(), schema, lambda r: 48 + 24 * len(r[2]) + 80 * len(r[3]))

        out = given.mapInArrow(run, f"id {kind_sql[1]}, fp long, base {base_sql}, spans array<struct<start:int,kind:int,end:int,to:string>>")
        return out.withColumnRenamed("id", id_col)

    schema = pa.schema([("id", kind_sql[0]), ("fp", pa.int64()), ("base", _SPAN), ("near", _NEAR)])
    bits = bit_filter(flagged, "term")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mark = marker(passes(bits))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    base = base_spans(text := text.as_py() or "")
                    yield key, fp, [*map(span, base)], [{"term": t, "start": a, "end": b} for t, a, b in mark(text, base)]

        return emit(rows(), schema, lambda r: 48 + 24 * len(r[2]) + 80 * len(r[3]))

    scanned = given.mapInArrow(scan, f"id {kind_sql[1]}, fp long, base {base_sql}, near array<struct<term:string,start:int,end:int>>")
    scanned = saved(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    near = scanned.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*").join(flagged, "term")
    added = near.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end", "to")).alias("added"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    own = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.get(names, x["kind"]).alias("to")))
    spans = F.when(F.col("added").isNull(), own).otherwise(F.array_sort(F.concat(own, "added")))
    return scanned.join(added, "row", "left").select(F.col("id").alias(id_col), "fp", "base", spans.alias("spans"))


def joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with its columns, every base span replaced by its kind in angle brackets, and every
    disclosing term by what generalises it or by ``<term>``.

    Documents without spans keep their text as it is, and a null text stays null; repeated rows are
    treated alike; ids are of any type and may be null; an empty table gives an empty result; other
    columns may have any names. A very long text is held whole.
    """
    ship_package(docs.sparkSession)
    flagged = disclosing(docs, disclosure, support, text_col)
    sent, columns = sent_terms(flagged), docs.columns
    at, given = columns.index(text_col), docs
    if sent is None:  # too many terms for a broadcast: the spans are joined with their texts
        key, fp, spans = fresh(columns, "key", "fp", "spans")
        found = _found(docs, flagged, id_col, text_col).where(F.size("spans") > 0).groupBy(F.col(f"`{id_col}`").alias(key), F.col("fp").alias(fp)).agg(F.first("spans").alias(spans))
        given = docs.join(found, docs[id_col].eqNullSafe(found[key]) & (F.xxhash64(docs[text_col]) == found[fp]), "left").select(*[docs[c] for c in columns], found[spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        terms = sent.value if sent is not None else {}
        mark = marker(terms.__contains__)
        for whole in batches:
            step = max(1, int(whole.num_rows * OUT_BYTES / max(whole.nbytes, 1)))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                raw = (t.as_py() for t in batch.column(at))
                if sent is not None:
                    texts = [None if t is None else clean(t, marks_of(t, terms, mark)[1]) for t in raw]
                else:
                    found = ([tuple(x.values()) for x in s.as_py() or ()] for s in batch.column(len(columns)))
                    texts = [None if t is None else clean(t, s) for t, s in zip(raw, found, strict=True)]
                arrays = [pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return given.mapInArrow(run, docs.schema)


def clean(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``text`` with its spans (start, kind, end, replacement) replaced; of spans that overlap the first."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end, to in spans:
        if start >= at:
            out += [text[at:start], to]
        at = max(at, end)
    return "".join([*out, text[at:]])
