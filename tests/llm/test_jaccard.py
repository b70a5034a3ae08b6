import random
import re

import numpy as np
import pytest

from veritide.llm import jaccard
from veritide.llm.components import components
from veritide.llm.jaccard import join_components

DOCS = "doc_id long, text string, node long, component string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((" \t" if rng.random() < 0.3 else " ").join(copy).title())
        docs.append(" ".join(passage + [rng.choice(words) for _ in range(rng.randint(1, 30))]))
    docs += ["", None, "one", "ONE", "a b c d", "a b  c D", "\x0b\n", docs[0], docs[0]]
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


@pytest.mark.parametrize(("seed", "small"), [(1, 12), (2, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, small):
    monkeypatch.setattr(jaccard, "SMALL_LIST", small)
    if small < 12:
        monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 3)
        monkeypatch.setattr(jaccard, "LIST_SALT", 2)
        monkeypatch.setattr(jaccard, "LIST_ROWS", 40)
    docs = corpus(seed)
    rows = join_components(spark.createDataFrame([(k, t, 7, "clash") for k, t in docs], DOCS).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g"
    rows = join_components(spark.createDataFrame([(None, text, 1, ""), (5, text, 1, ""), (5, text, 1, ""), (9, text, 1, "")], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows if r.doc_id) == [(5, 3, 5), (5, 3, 5), (9, 3, 5)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert join_components(spark.createDataFrame([], DOCS)).count() == 0


def test_contraction_reaches_the_ends_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)], "a long, b long")
    assert {(r.node, r.label) for r in components(links).collect()} == {(i, 1) for i in range(1, 61)} | {(100, 90), (90, 90), (95, 90)}


def test_sketches_never_rule_out_a_link(spark):
    rng = np.random.default_rng(3)
    rows, pairs = [], []
    for i in range(60):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        cut, new = rng.integers(0, len(a) // 6 + 1), rng.integers(0, len(a) // 6 + 1)
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
        for k, s in ((2 * i, a), (2 * i + 1, b)):
            rows.append((k, len(s), jaccard.sketch(s).tolist(), {*s.tolist()}))
        pairs += [(2 * i, 2 * i + 1), (2 * i, (2 * i + 7) % 120)]
    sets = {r[0]: r[3] for r in rows}
    kept = {(r.a, r.b) for r in jaccard.may_link(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([r[:3] for r in rows], "node long, n int, sketch array<bigint>"), 75).collect()}
    linked = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked <= kept and len(linked) > 30 and len(kept) < 100


def test_a_long_list_of_near_copies_in_several_components(spark):
    """3,000 near copies of three bases that share a passage: links of all sizes, components that must not run together."""
    rng = random.Random(4)
    shared = [f"p{i}" for i in range(12)]
    bases = [[f"b{k}x{i}" for i in range(40)] + shared for k in range(3)]
    docs = []
    for i in range(3_000):
        w = list(bases[i % 3])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(40)] = f"e{rng.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    rows = join_components(spark.createDataFrame([(k, t, 7, "clash") for k, t in docs], DOCS).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_fast(docs)


def brute_fast(docs):
    """As ``brute``, over a matrix of the sets."""
    sets = {k: shingles(t) for k, t in docs}
    keys, root = sorted(sets), {k: k for k in sets}
    holders = {}
    for k in keys:
        for g in sets[k]:
            holders.setdefault(g, []).append(k)
    dense = sorted(g for g, who in holders.items() if len(who) > 1)
    column = {g: i for i, g in enumerate(dense)}
    m = np.zeros((len(keys), len(dense)), np.float32)
    for i, k in enumerate(keys):
        m[i, [column[g] for g in sets[k] if g in column]] = 1
    size = np.array([len(sets[k]) for k in keys])
    both = m @ m.T
    linked = 100 * both >= 75 * (size[:, None] + size[None] - both)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        x, y = find(keys[i]), find(keys[j])
        root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_a_very_long_text_and_ties(spark):
    rng = random.Random(9)
    w = [f"v{rng.randrange(5_000)}" for _ in range(80_000)]
    near = w[:70_000] + [f"u{i}" for i in range(3_000)]
    docs = [(7, " ".join(w)), (3, " ".join(near)), (5, "a b c d e f"), (4, "a b c d e f")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(spark.createDataFrame([(k, t, 7, "clash") for k, t in docs], DOCS)).collect()}
    assert got == brute(docs)


def test_pairs_that_join_nothing_come_later_and_are_not_made_again(spark, monkeypatch):
    """Of pairs of labels 1-2, 2-3 and 1-3, a forest takes two; the others are kept unless there is no room."""
    pairs = [(10, 20, 1, 2, 0.1), (11, 21, 1, 2, 0.2), (20, 30, 2, 3, 0.1), (30, 10, 3, 1, 0.3), (21, 11, 2, 1, 0.2)]
    for room, back in ((1 << 17, False), (1, True)):
        found = jaccard.Likeliest(1, room)
        for row in pairs:
            found.add(*(np.array([x]) for x in row))
        got = {(a, b): later for a, b, later in zip(*(c.tolist() for c in found.pairs()), strict=True)}
        assert found.back == back and {p for p, later in got.items() if not later} == {(10, 20), (20, 30)}
        assert {p for p, later in got.items() if later} == (set() if back else {(11, 21), (10, 30)})

    names = []
    write = jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(jaccard, "SMALL_LIST", 2)
    rng = random.Random(6)
    shared, docs = [f"p{i}" for i in range(30)], []
    for i in range(60):
        docs.append((i, " ".join([f"b{i % 4}x{k}" for k in range(18)] + shared + [f"e{rng.randrange(3)}x{k}" for k in range(9)])))
    rows = join_components(spark.createDataFrame([(k, t, 7, "clash") for k, t in docs], DOCS).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)
    assert names.count("jaccard-round") == 1 and "jaccard-nodes" not in names
