import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.llm import pii
from veritide.llm.pii import KINDS, base_spans, find, joined, luhn, sanitise
from veritide.llm.queries import op7_personal_data

DOCS = "doc_id long, text string, value string, row string, term string"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else True, 10 <= len(digits) <= 15]
            if ok[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    bits = ["a@b.c", "x.y@@z.org", "1.2.3.4", "300.1.2.3.4.5", "..", "4111 1111 1111 1111", "4111-1111 1111-1111", "+1 (555) 010-9999", "+", "@", " ", "\n", "12", ".", "-", "é", "a", "+49 30 123456", "0000.01.2.3", "99999999999999"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert base_spans(text) == plain(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


@pytest.mark.parametrize("text", ["1" * 50_000, "a" * 50_000 + "@", "+1" * 20_000, "@" * 20_000, "1." * 30_000, "a.b@" * 10_000, "1 " * 30_000])
def test_long_runs_take_linear_time(text):
    base_spans(text)


def test_spans_terms_and_edges(spark):
    texts = {1: "write to Zorro at z@x.org or ask or write or zorro", 2: "ask Zorro at z@x.org now", 3: "at the the the or to", 4: None, 5: "", 6: "now to ask or write at noon"}
    texts |= {i: "at to or now ask write common words" for i in range(10, 40)}
    docs = spark.createDataFrame([(k, t, "c", "c", "c") for k, t in texts.items()] + [(1, texts[1], "", "", ""), (None, "n@x.org", "", "", "")], DOCS)
    rows = find(docs).select("doc_id", F.sha2(joined(F.col("base")), 256).alias("b"), joined(F.col("spans")).alias("s")).collect()
    assert len(rows) == len(texts) + 2
    by = {r.doc_id: r for r in rows}
    start, end = texts[1].index("Zorro"), len(texts[1])
    assert by[1].s.split(",") == [f"term:{start}:{start + 5}", "email:18:25", f"term:{end - 5}:{end}"] and by[1].b == hashlib.sha256(b"email:18:25").hexdigest()
    assert "term" in by[2].s and by[3].s == by[4].s == by[5].s == ""
    assert by[4].b == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert clean[1] == "write to <term> at <email> or ask or write or <term>" and clean[6] == texts[6] and clean[4] is None and clean[5] == ""
    assert sanitise(docs).columns == docs.columns and sanitise(docs).count() == docs.count()
    assert KINDS[4] == "term"


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert find(none).count() == 0 and sanitise(none).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_disclosing_terms_go_wherever_they_stand(spark, monkeypatch, most):
    """Far from the value, again in the same document, and in documents without it; with apostrophe, hyphen and digits; broadcast or joined."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
    far = " at or to now" * 60
    long = "x" * 220
    texts = {
        1: f"O'Neil met smith-jones and emp4711{far} z@x.org now o'neil", 2: f"z@x.org{far} (Smith-Jones) O'Neil, emp4711!", 3: "at noon O'Neil or now",
        4: f"{long}1@x.org alba", 5: f"{long}1@x.org alba", 6: f"{long}2@x.org at alba2", 7: f"{long}3@x.org to alba2", 8: "4111 1111 1111 1111 now", 9: "4111 1111 1111 1111 or",
    }
    texts |= {i: "at to or now met and noon common words" for i in range(10, 40)}
    docs = spark.createDataFrame([(k, t, "c", "c", "c") for k, t in texts.items()], DOCS)
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert clean[1] == f"<term> met <term> and <term>{far} <email> now <term>"
    assert clean[2] == f"<email>{far} (<term>) <term>, <term>!"
    assert clean[3] == "at noon <term> or now"
    assert clean[4] == clean[5] == "<email> <term>" and clean[6] == "<email> at alba2" and clean[7] == "<email> to alba2"
    assert clean[8] == "<card> now" and clean[9] == "<card> or" and clean[10] == texts[10]
    spans = {r.doc_id: joined_spans(r.spans) for r in find(docs).collect()}
    assert spans == {k: joined_spans([(m.start(), 4, m.end()) for m in re.finditer(r"O'Neil|o'neil|[Ss]mith-[Jj]ones|emp4711|alba(?!2)", t)] + base_spans(t)) for k, t in texts.items()}
    none = docs.limit(0)
    assert find(none).count() == 0 and sanitise(none).count() == 0


def joined_spans(spans):
    return sorted((s[0], s[1], s[2]) for s in spans)


def test_terms_are_generalised_where_that_discloses_little(spark):
    """"mar*" stands for many words of other documents, "zan*" for one word only; a plain version tells the same of all terms."""
    rng = random.Random(1)
    texts = {1: "marlow zander m@x.org at", 2: "at m@x.org or marlow, zander"}
    texts |= {i: f"{rng.choice(['marble', 'market', 'marina'])} at or now" for i in range(10, 60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert clean[1] == "mar* <term> <email> at" and clean[2] == "at <email> or mar*, <term>" and clean[10] == texts[10]


def test_terms_are_those_of_a_plain_version(spark):
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in ("ka", "lor", "mi", "tesu") for b in ("na", "ben", "dor", "x1", "-fi")]
    people = [(f"p{i}@x.org", rng.sample(vocab, 2)) for i in range(8)]
    texts = {}
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            mail, own = rng.choice(people)
            words += [mail, f"u{mail[:2]}ser", *own]
            rng.shuffle(words)
        texts[i] = " ".join(words)
    spans = {i: base_spans(t) for i, t in texts.items()}
    terms = {i: {w for w in t.split() if "@" not in w} for i, t in texts.items()}
    values = {i: {texts[i][s:e] for s, _, e in spans[i]} for i in texts}
    n = len(texts)

    def told(value, some):
        t, v = {i for i in terms if terms[i] & some}, {i for i in values if value in values[i]}
        return math.log(len(t & v) * n / (len(t) * len(v))) / math.log(n / len(v)) if t & v else -1, len(t & v)

    want = {}
    every = set().union(*terms.values())
    for value in set().union(*values.values()):
        for term in set().union(*(terms[i] for i in terms if value in values[i])):
            d, both = told(value, {term})
            if both >= 2 and d >= 0.8:
                broad = {t for t in every if pii.generalised(t) == pii.generalised(term)}
                want[term] = "<term>" if want.get(term) == "<term>" or told(value, broad)[0] >= 0.8 else pii.generalised(term)
    got = {r.term: r.to for r in pii.disclosing(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and len(want) > 5


def test_columns_named_as_the_work_columns_and_text_ids(spark, monkeypatch):
    row = ("a", "ask z@x.org now", 1, 2, 3, 4, 5, 6)
    docs = spark.createDataFrame([row], "doc_id string, text string, _id int, _fp int, _spans int, key int, fp int, spans int")
    for most in (200_000, -1):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
        assert [tuple(r) for r in sanitise(docs).collect()] == [("a", "ask <email> now", *row[2:])]
        assert find(docs).count() == 1


def test_query_counts_each_kind(spark, tmp_path):
    texts = ["a@b.org 10.0.0.1 4111 1111 1111 1111 +49 30 1234567", "1.2.3.4 and 5.6.7.8", "+49 30 1234567 x@y.org", None, "", "z@y.org z@y.org z@y.org 9.9.9.9"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op7_personal_data(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        spans = plain(text or "")
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(s[1] == kind for s in spans) for kind in range(4)]
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans).encode()).hexdigest()


def test_words_are_read_without_stops_at_their_ends_and_give_the_same_terms():
    assert pii.lowered("Word, word. word.\nWord") == {"word"}
    rng = random.Random(11)
    bits = ["a", "Bc", "ΑΣ", "İ", "é", ".", ",", ", ", ". ", ".\n", " ", "'", "-", "1", "12", "@", "!", "x.y@z.org", "+49 30 123456", "\x1c"]
    read, terms = pii.reader(), {"bc", "a12", "ας", "éa", "a-1", "a"}
    mark = pii.marker(terms.__contains__)
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        base = base_spans(text)
        every = [(t, a, b) for t, a, b in pii.places(text, base)]
        assert read(text, base) == {t for t, _, _ in every}, text
        assert mark(text, base) == [x for x in every if x[0] in terms], text


def test_filter_of_many_keys_is_that_of_each():
    class Sent:
        value = np.packbits(np.random.default_rng(1).random(pii.FILTER_BITS) < 0.3)

    keys = {f"k{i}" for i in range(2000)} | {"é", ""}
    for more in (set(), {"\ud800"}):
        assert pii.passing(Sent)(keys | more) == {k for k in keys | more if pii.passes(Sent)(k)}
