import random
import re

from pyspark.sql import functions as F

from veritide.llm.decontaminate import fingerprints, matches

DOCS = "doc_id long, text string, item string, copy string, m int"
ITEMS = "item_id long, text string, doc string"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def grams(w):
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    """Every window of an item's size, and those cut by a document's ends; weighted, then plain similarity."""
    bag = {k: grams(words(t)) for k, t in items}
    weight = {}
    for s in bag.values():
        for g in s:
            weight[g] = weight.get(g, 0) + 1
    out = {}
    for d, t in docs:
        w = words(t)
        for k, text in items:
            m = len(words(text))
            for start in range(-m + 1, len(w)):
                window = grams(w[max(0, start) : max(0, start + m)])
                both, either = window & bag[k], window | bag[k]
                if m and both:
                    s = sum(1 / weight.get(g, 1) for g in both) / sum(1 / weight.get(g, 1) for g in either)
                    plain = len(both) / len(either)
                    if max(s, plain) >= 0.75 - 1e-12:
                        out[d, k] = max(out.get((d, k), (False, 0)), (s >= 0.75 - 1e-12, s if s >= 0.75 - 1e-12 else plain))
    return {pair: s for pair, (_, s) in out.items()}


def test_matches_are_those_of_all_windows(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 20, 20, 40])))) for k in range(12)]
    items += [(50, items[2][1] + " extra"), (51, ""), (52, None)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        if i % 2:
            passage = (items[rng.randrange(12)][1]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "edit"
            at = rng.choice([0, len(w) // 2, len(w)])
            w[at:at] = passage
        docs.append((i, ("  " if i % 5 == 0 else " ").join(w).upper() if i % 3 else "\n".join(w)))
    docs += [(900, None), (901, "")]
    found = matches(spark.createDataFrame([(d, t, "c", "c", 1) for d, t in docs] + [(1, docs[1][1], "c", "c", 1)], DOCS), spark.createDataFrame([(k, t, "c") for k, t in items], ITEMS)).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    want = brute(docs, items)
    assert len(found) == len(got) and set(got) == set(want) and len(want) > 20
    assert all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h", "", "", 1)], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f g h", "")], ITEMS)
    assert [(r.doc_id, r.item_id, r.hamming) for r in matches(docs, items).collect()] == [(None, 1, 0)]
    assert matches(docs.limit(0), items).count() == 0 and matches(docs, items.limit(0)).count() == 0


def test_near_copies_of_repeated_items_match(spark):
    """An edited copy of an item that stands in the benchmark under several ids matches by its plain similarity."""
    rng = random.Random(8)
    prose = lambda n: [f"v{rng.randrange(10_000)}" for _ in range(n)]
    items, docs = [], []
    for i in range(30):
        w = prose(50)
        items += [(10 * i + j, " ".join(w)) for j in range(2 + 3 * (i % 2))]
        w[rng.randrange(8, 42)] = "edit"
        docs.append((i, " ".join(prose(20) + w + prose(20))))
    passage = prose(200)
    for i in range(10):
        items.append((1000 + i, " ".join(passage + (asked := prose(15)))))
        asked[7] = "edit"
        docs.append((1000 + i, " ".join(prose(5) + passage + asked + prose(5))))
    found = matches(spark.createDataFrame([(d, t, "c", "c", 1) for d, t in docs], DOCS), spark.createDataFrame([(k, t, "c") for k, t in items], ITEMS)).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    bag = {k: grams(t.split()) for k, t in items}
    for d, t in docs:
        for k, text in items:
            if (k // 10 == d) if d < 1000 else k == d:
                start = 20 if d < 1000 else 5
                window = grams(t.split()[start : start + len(text.split())])
                plain = len(window & bag[k]) / len(window | bag[k])
                assert plain >= 0.75 and (got[d, k].similarity >= 0.75, got[d, k].hamming <= 24) == (True, True)
    assert len(found) >= len(docs)


def test_fingerprints_stay_near_with_unequal_weights(spark):
    """300 shared shingles of weight 0.1 and 5 of weight 1 on each side: a weighted similarity of 0.75."""
    sides = []
    for i in range(20):
        shared, ends = [f"s{i}x{j}" for j in range(304)], [[f"{side}{i}x{j}" for j in range(5)] for side in "ab"]
        sides += [(i, side, shared + end) for side, end in enumerate(ends)]
    rows = spark.createDataFrame(sides, "i int, side int, w array<string>")
    common = rows.where("side = 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda j: F.xxhash64(*[F.get("w", j + k) for k in range(5)]))).alias("h"))
    got = {(r.i, r.side): r.fingerprint for r in fingerprints(rows, ["i", "side"], common.distinct().withColumn("weight", F.lit(0.1))).collect()}
    assert max(bin((got[i, 0] ^ got[i, 1]) & (2**64 - 1)).count("1") for i in range(20)) <= 24


def test_reordered_passages_match_as_all_windows_do(spark):
    """Blocks of an item in another order: windows that hold its shingles without lining up with them."""
    rng = random.Random(11)
    vocab = [f"r{i}" for i in range(4_000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([40, 60, 60, 90])))) for k in range(25)]
    docs = []
    for i in range(200):
        w = items[i % 25][1].split()
        cut = sorted(rng.sample(range(5, len(w) - 4), rng.choice([1, 1, 2])))
        parts = [w[a:b] for a, b in zip([0, *cut], [*cut, len(w)])]
        rng.shuffle(parts)
        around = [[rng.choice(vocab) for _ in range(rng.choice([0, 3, 30]))] for _ in range(2)]
        docs.append((i, " ".join(around[0] + [x for p in parts for x in p] + around[1])))
    docs.append((200, " ".join(items[1][1].split()[30:] + items[1][1].split()[:30])))
    found = matches(spark.createDataFrame([(d, t, "c", "c", 1) for d, t in docs], DOCS), spark.createDataFrame([(k, t, "c") for k, t in items], ITEMS)).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in found} == set(want) and (200, 1) in want and len(want) > 100


def test_very_long_texts_ties_and_text_ids(spark):
    rng = random.Random(5)
    item = [f"t{i}" for i in range(30)]
    w = [f"x{rng.randrange(500)}" for _ in range(60_000)]
    w[50_000:50_000], w[20_000:20_000] = item, item
    docs = spark.createDataFrame([("a", " ".join(w)), ("", " ".join(item)), (None, " ".join(item))], "doc_id string, text string")
    items = spark.createDataFrame([(1, " ".join(item), ""), (2, " ".join(item), "")], ITEMS)
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.similarity) for r in matches(docs, items).collect()), key=str)
    assert got == sorted([(d, k, 20_000 if d else 0, 1.0) for d in ("a", "", None) for k in (1, 2)], key=str)
