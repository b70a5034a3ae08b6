import itertools
import math
import random

import numpy as np
import public_tokenizers as P

from veritide.llm import langid
from veritide.llm.langid import LETTERS, MARK, Lattice, Scores, fit, identify, vocabulary

DOCS = "doc_id long, text string, lang string, score double"


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", MARK + "a"]
    probs = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.2], [0.1, 0.1], [0.3, 0.3]])
    other = np.array([0.01, 0.02])
    lattice = Lattice(pieces, probs, other)
    table = dict(zip(pieces, probs, strict=True))
    for word in ("ab", "aba", "abba", "bca"):
        s = MARK + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            p = np.ones(2)
            for x, y in itertools.pairwise(at):
                p = p * (table.get(s[x:y], np.zeros(2)) + (other if y - x == 1 else 0))
            total += p
        assert np.allclose(lattice.log_scores([word])[0], np.log(total))
    uses = Lattice(pieces, probs[:, [0]], other[[0]]).expected(["ab"], np.array([2.0]))
    assert abs(uses @ [1, 1, 2, 2, 2, 1] - 6) < 1e-9


def test_accuracy_and_edges(spark):
    rng = random.Random(5)
    words = {"aa": ["the", "and", "with", "from", "this"], "bb": ["der", "und", "nicht", "eine", "auf"], "cc": ["que", "para", "con", "una", "los"]}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", ",", "."]) for _ in range(25)), k, 0.0) for i, k in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, DOCS)
    pieces = vocabulary(P.path("piece_bpe_32k.model"))
    model = fit(docs.where("doc_id < 90").union(spark.createDataFrame([(500, None, "aa", 0.0), (501, "x", None, 0.0)], DOCS)), pieces)
    got = identify(docs, model, pieces).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "", 0.0), (2, "", "", 0.0), (3, "12 34 !!", "", 0.0), (None, "the und", "", 0.0), (4, "x" * 20_000, "", 0.0), (4, "x" * 20_000, "", 0.0)], DOCS)
    got = identify(odd, model, pieces).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and all(r.lang_pred != "und" for r in got if r.doc_id in (4, None))
    assert identify(odd.limit(0), model, pieces).count() == 0
    assert {r.lang_pred for r in identify(docs.limit(2), fit(docs.limit(0), pieces), pieces).collect()} == {"und"}


def plain_log(word, table, other):
    """The log of the sum over all segmentations of a word, by log-sum-exp from the left, and each piece's expected uses."""
    s = MARK + word
    n = len(s)
    edges = lambda i: [(j, s[i:j], math.log(table[s[i:j]])) for j in range(i + 1, min(n, i + 12) + 1) if s[i:j] in table] + [(i + 1, "", math.log(other))]
    ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = back[n] = 0.0
    for i in range(n):
        for j, _, p in edges(i):
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + p)
    uses = {}
    for i in range(n - 1, -1, -1):
        for j, piece, p in edges(i):
            back[i] = np.logaddexp(back[i], back[j] + p)
            uses[piece] = uses.get(piece, 0.0) + math.exp(ahead[i] + p + back[j] - ahead[n])
    return ahead[n], uses


def test_long_words_are_summed_over_all_segmentations():
    rng = random.Random(2)
    pieces = ["a", "b", "ab", "ba", "abc", MARK + "a", "cccccccccccc"]
    probs = np.array([[0.2], [0.1], [0.3], [0.1], [0.1], [0.1], [0.1]])
    lattice = Lattice(pieces, probs, np.array([1e-5]))
    table = dict(zip(pieces, probs[:, 0], strict=True))
    words = ["".join(rng.choice("abcd") for _ in range(n)) for n in (3, 47, 48, 49, 120, 700, 3000)] + ["ccccccccccccc" * 9, "z" * 500]
    got = lattice.log_scores(words)[:, 0]
    for word, score in zip(words, got, strict=True):
        want, uses = plain_log(word, table, 1e-5)
        assert abs(score - want) < 1e-6 * abs(want)
        found = lattice.expected([word], np.array([1.0]))
        assert np.allclose(found, [uses.get(p, 0.0) for p in [*pieces, ""]], atol=1e-6)


def test_pieces_and_uncovered_characters_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "the öß and xx " * 20, "ab"[i % 2], 0.0) for i in range(20)], DOCS)
    langs, probs, other = fit(docs, vocabulary(P.path("piece_bpe_32k.model")))
    assert langs == ["a", "b"] and np.allclose(probs.sum(axis=0) + LETTERS * other, 1.0)


def test_text_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(f"d{i}", ["the and with", "der und nicht"][i % 2], "ab"[i % 2], 0.0, "x", "y") for i in range(40)], "doc_id string, text string, lang string, score double, id string, lang_pred string")
    pieces = vocabulary(P.path("piece_bpe_32k.model"))
    assert {(int(r.doc_id[1:]) % 2, r.lang_pred) for r in identify(docs, fit(docs, pieces), pieces).collect()} == {(0, "a"), (1, "b")}


def test_a_full_memo_is_filled_for_many_texts_at_once(monkeypatch):
    monkeypatch.setattr(langid, "MEMO", 400)
    rng = random.Random(3)
    pieces = ["a", "b", "ab", "ba", MARK + "a"]
    scores = Scores(pieces, np.full((len(pieces), 2), 0.1) + np.arange(2) / 50, np.array([0.01, 0.02]))
    known = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(100)]
    once = lambda n: ["".join(rng.choice("abc") for _ in range(12)) for _ in range(n)]
    texts = [rng.sample(known, 20) + once(3) for _ in range(300)] + [once(900)] + [[]]
    plain, filled = scores.lattice.log_scores, []
    want = [plain(words).sum(axis=0) for words in texts]
    scores.lattice.log_scores = lambda words: filled.append(len(words)) or plain(words)
    got = [scores.total(words) for lot in (texts[:150], texts[150:]) for run in scores.ready(lot) for words in run]
    assert np.allclose(got, want) and scores.used <= 400
    assert len(filled) < 40  # once for a run of texts; the text of 900 words goes in parts


def test_columns_of_a_lattice_are_lattices_of_their_own():
    pieces = ["a", "b", "ab", MARK + "a"]
    probs, other = np.arange(1, 9).reshape(4, 2) / 40, np.array([0.01, 0.02])
    both = Lattice(pieces, probs, other)
    for k in range(2):
        assert np.array_equal(both.column(k).log_scores(["ab", "bba"]), Lattice(pieces, probs[:, [k]], other[[k]]).log_scores(["ab", "bba"]))
