import itertools
import random
import re

from veritide.llm.common import held_out
from veritide.llm.toxicity import AIMED, DENIED, FAR, MENACE, PATTERNS, PLAIN, TOLD, Grammar, clean_rows, compose, fit, score

DOCS = "doc_id long, text string, lang string, score double, id string"


def corpus(spark, n=900):
    rng = random.Random(8)
    plain = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "field"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(["Blarg!!", "zorp" + rng.choice(["ing", "ed", "ly"]), "BLARG###"])
        rows.append((i, " ".join(words), "xx", 0.0, "c"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = score(docs, fit(docs, labels, held_out())).join(labels, "doc_id").where(held_out()).collect()
    assert len(out) > 100 and sum(r.predicted == r.toxic for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_texts_and_labels(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None), (999999, 0, 1)], labels.schema)), held_out())
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "blarg", "", 0.0, ""), (2, "", "", 0.0, ""), (2, "", "", 0.0, ""), (3, "blarg " * 50_000, "", 0.0, "")], DOCS)
    rows = score(odd, model).collect()
    assert len(rows) == 5 and {r.predicted for r in rows if r.doc_id in (1, 2)} == {0} and {r.predicted for r in rows if r.doc_id in (3, None)} == {1}
    assert score(odd.limit(0), model).count() == 0
    bare = fit(docs, labels.limit(0), held_out())
    assert {r.predicted for r in score(docs.limit(3), bare).collect()} == {0}


def test_clauses_are_told_by_what_they_match():
    g = Grammar({"=fool": 2.0, "zor": 3.0})
    kind = lambda text: [k for k, _ in g.clauses(text)]
    assert kind("what a fool") == [PLAIN] and kind("you are a fool") == [AIMED] and kind("fool, you are") == [AIMED]
    assert kind("that is not fool") == [DENIED] and kind("it said fool") == [TOLD] and kind("a fool, he wrote") == [TOLD]
    assert kind("i will hurt you") == [MENACE] and kind("they will kill") == [MENACE] and kind("to burn wood") == [] and kind("nothing here, you") == []
    assert [w for _, w in g.clauses("you zorping. fool")] == [4.5, 2.0] and list(g.clauses("fool fool zorp")) == [(PLAIN, 7.0)]


def test_the_machine_accepts_what_the_patterns_describe():
    """Every clause of up to five symbols, and random longer ones, held against the patterns read as regular expressions."""
    letters = "OITYNR"

    def plain(clause):
        found = set()
        for tells, first, second, reach in PATTERNS:
            a, b = ("".join(letters[s] for s in group or ()) for group in (first, second))
            pattern = f"[{a}]" if second is None else f"[{a}].*[{b}]" if reach == FAR else f"[{a}].{{0,{reach - 1}}}[{b}]"
            if re.search(pattern, clause):
                found.add(tells)
        return found

    rng = random.Random(2)
    some = ["".join(c) for n in range(6) for c in itertools.product(letters, repeat=n)] + ["".join(rng.choice("OOOO" + letters) for _ in range(rng.randint(6, 25))) for _ in range(4_000)]
    machine = compose()
    for clause in some:
        state = 0
        for c in clause:
            state = machine.step(state, letters.index(c))
        assert machine.accepts[state] == plain(clause), clause


def test_columns_named_as_the_work_columns_and_text_ids(spark):
    docs, labels = corpus(spark)
    clash = docs.selectExpr("cast(doc_id as string) doc_id", "text", "1 as _id", "2 as _y", "3 as key", "4 as y", "5 as f", "6 as k", "7 as predicted")
    marks = labels.selectExpr("cast(doc_id as string) doc_id", "toxic", "1 as _id", "0 as y", "2 as key")
    got = score(clash, fit(clash, marks, held_out())).collect()
    assert len(got) == 900 and sum(r.predicted for r in got) > 250 and isinstance(got[0].doc_id, str)


def test_clean_rows_are_those_that_score_low(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels, held_out())
    twice = docs.union(docs.where("doc_id < 9")).union(spark.createDataFrame([(None, None, None, None, None), (None, "blarg blarg", "", 0.0, "")], DOCS))
    low = [r.doc_id for r in score(twice, model).where("predicted = 0").collect()]
    assert sorted(map(str, low)) == sorted(str(r.doc_id) for r in clean_rows(twice, model).collect()) and clean_rows(twice, model).columns == docs.columns
