"""Benchmark decontamination with DataFrame operations only.

An item of m words is compared with every window of m words of a document, those that the
document's ends cut included. A window that could reach the similarity holds a least number of
shingles of items of its size (``needs``), so these are looked up first, and every window that holds
as many gets two 64-bit SimHash fingerprints, over weighted and over equal shingles; so do the items.
A multi-index of radius + 1 bit blocks finds every window within the radius of an item of its size
by either; the exact Jaccard similarity decides: a pair matches if its weighted or its plain one is
high enough. Weights are shared out among the items that hold a shingle, so the plain one keeps
near copies of items that stand in a benchmark twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.llm.common import saved

WORDS, SIMILARITY = 5, 0.75
#: Bits that fingerprints of a pair may differ in. Pairs at the similarity differ in 11 on average,
#: with a deviation of 3.
RADIUS = 24
#: Rows of a few numbers each up to which a table is broadcast; beyond it it is shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def gram(of: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(of), at + i) for i in range(k)])


def shingles(of: str) -> Column:
    """Distinct shingle hashes of a word array; with fewer words, the whole sequence as one."""
    n = F.size(of)
    short = F.when(n == 0, F.array().cast("array<bigint>"))
    for k in range(1, WORDS):
        short = short.when(n == k, F.array(gram(of, F.lit(0), k)))
    full = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: gram(of, i, WORDS))
    return F.array_distinct(short.otherwise(full))


def fingerprints(rows: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """keys, fingerprint (by weights), even (by equal weights), weight (of all shingles) and marks (shingles with weights) of word arrays ``w``."""
    each = rows.select(*keys, F.explode(shingles("w")).alias("h")).join(weights, "h", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    up = lambda b: F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1
    signs = [F.sum(F.when(up(b), F.sqrt("weight")).otherwise(-F.sqrt("weight"))).alias(f"b{b}") for b in range(64)]
    signs += [F.sum(F.when(up(b), 1).otherwise(-1)).alias(f"e{b}") for b in range(64)]
    summed = each.groupBy(*keys).agg(*signs, F.sum("weight").alias("weight"), F.collect_list(F.struct("h", "weight")).alias("marks"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    bits = {"b": zero, "e": zero}
    for b in range(64):
        bits = {k: v.bitwiseOR(F.when(F.col(f"{k}{b}") > 0, F.shiftleft(one, b)).otherwise(zero)) for k, v in bits.items()}
    return summed.select(*keys, bits["b"].alias("fingerprint"), bits["e"].alias("even"), "weight", "marks")


def blocks(rows: DataFrame, radius: int) -> DataFrame:
    """One row for each of radius + 1 blocks of either fingerprint's bits: two fingerprints within the radius agree on one.

    ``print`` is the fingerprint that the block is of; blocks of ``even`` have numbers above the radius.
    """
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [
        F.struct(F.lit(i + k * (radius + 1)).alias("block"), F.shiftrightunsigned(name, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("bits"), F.col(name).alias("print"))
        for k, name in enumerate(("fingerprint", "even"))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    kept = [c for c in rows.columns if c not in ("fingerprint", "even")]
    return rows.withColumn("part", F.explode(F.array(*parts))).select(*kept, "part.block", "part.bits", "part.print")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def needs(bench: DataFrame, weights: DataFrame, similarity: float) -> DataFrame:
    """(m, need): how many shingles of items of m words a window that matches one of them holds at least.

    A window with the plain similarity holds that share of the item's shingles; one with the weighted
    similarity holds that share of its weight, in shingles none of which weighs more than ``top``.
    """
    each = bench.select("item", "copy", "m", F.explode(shingles("w")).alias("h")).join(weights, "h")
    sums = each.groupBy("item", "copy", "m").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max("weight").alias("top"))
    least = F.ceil(similarity * F.least(F.col("n").cast("double"), F.col("weight") / F.col("top")) - 1e-6)
    return sums.groupBy("m").agg(F.greatest(F.lit(1), F.min(least)).cast("int").alias("need"))


def windows_of(docs: DataFrame, bench: DataFrame, need: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, m, start, w): every window that holds the least number of shingles of items of its size.

    Places of item shingles are found without the texts; only texts that have such windows are read again.
    """
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.lit(1), text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    hits = None
    for k in sorted(r.k for r in bench.select("k").distinct().collect()):  # at most five numbers
        own = bench.where(F.col("k") == k).select("m", F.explode(shingles("w")).alias("h")).groupBy("h").agg(F.collect_set("m").alias("ms"))
        split = text.select("doc", "th", words(F.col("text")).alias("w")).where(F.size("w") >= k)
        grams = split.select("doc", "th", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("p")).select("doc", "th", "p", gram("w", F.col("p"), k).alias("h"))
        met = grams.join(bounded(own), "h").select("doc", "th", "p", F.lit(k).alias("k"), F.explode("ms").alias("m"))
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return text.select("doc", F.lit(0).alias("m"), F.lit(0).alias("start"), F.array("text").alias("w")).where("false")
    placed = hits.groupBy("doc", "th", "m", "k").agg(F.array_sort(F.collect_set("p")).alias("ps")).join(need, "m").where(F.size("ps") >= F.col("need"))
    # need hits from the i-th on fit into a window iff it begins in [last of them - reach, first of them]
    first, last, reach = "ps[i]", "ps[i + need - 1]", "(m - k)"
    starts = F.expr(f"array_distinct(flatten(transform(sequence(0, size(ps) - need), i -> if({last} - {reach} <= {first}, sequence({last} - {reach}, {first}), array()))))")
    placed = saved(placed.select("doc", "th", "m", starts.alias("starts")).where(F.size("starts") > 0), "leak-starts")
    again = text.join(bounded(placed.select("th").distinct()), "th", "left_semi").dropDuplicates(["doc", "th"])
    both = again.withColumn("w", words(F.col("text"))).drop("text").alias("x").join(placed.alias("y"), F.expr("x.th = y.th and x.doc <=> y.doc"))
    both = both.select("x.doc", "y.m", "x.w", F.explode("y.starts").alias("start"))
    return both.select("doc", "m", "start", F.slice("w", F.greatest("start", F.lit(0)) + 1, F.col("m") + F.least("start", F.lit(0))).alias("w"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``id_col``, ``item_col``, ``similarity``, ``start_word``, ``n_words``, ``hamming``: the best window
    of each document for each item that it holds (ties: the first). ``similarity`` is the weighted
    one where that is high enough, and such windows go first; else it is the plain one. ``hamming``
    is the smaller distance of those by which the pair was found.

    Null and empty texts and items match nothing; a null document id stays null, and rows with one
    count as one document; repeated rows give one result; an item repeated under one id counts once
    for each different text; empty tables give an empty result; other columns are ignored. A very
    long text costs rows in proportion to its length. Documents shorter than an item, and windows
    cut by a document's ends, are compared as they are.
    """
    bench = items.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0).distinct()
    bench = saved(bench.withColumn("m", F.size("w")).withColumn("k", F.least("m", F.lit(WORDS))).withColumn("copy", F.xxhash64("w")), "leak-items")
    marks = bench.select("item", F.explode(shingles("w")).alias("h")).distinct()
    weights = saved(marks.groupBy("h").agg((1.0 / F.count("*")).alias("weight")), "leak-weights")
    places = windows_of(docs, bench, needs(bench, weights, similarity), id_col, text_col).where(F.size("w") > 0)
    places = saved(places.withColumn("copy", F.xxhash64("w")), "leak-windows")
    # Windows with the same words are looked at once.
    keys = ["m", "copy"]
    windows = saved(fingerprints(places.groupBy(*keys).agg(F.first("w").alias("w")), keys, bounded(weights)), "leak-prints")
    targets = saved(fingerprints(bench, ["item", *keys], bounded(weights)), "leak-targets")
    a = blocks(windows.drop("marks", "weight"), radius)
    b = blocks(targets.drop("marks", "weight"), radius).select("item", "m", F.col("copy").alias("icopy"), F.col("print").alias("target"), "block", "bits")
    near = a.join(b, ["m", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("target"))))
    near = near.where(F.col("hamming") <= radius).groupBy(*keys, "item", "icopy").agg(F.min("hamming").alias("hamming"))
    left = windows.select(*keys, F.col("weight").alias("wa"), F.col("marks").alias("ma"))
    right = targets.select(F.col("item").alias("item2"), F.col("copy").alias("icopy"), F.col("weight").alias("wb"), F.col("marks").alias("mb"))
    both = near.alias("n").join(left, keys).join(right.alias("r"), F.expr("n.icopy = r.icopy and n.item <=> r.item2"))
    both = both.withColumn("common", F.array_intersect("ma", "mb"))
    shared = F.aggregate("common", F.lit(0.0), lambda s, x: s + x["weight"])
    both = both.withColumn("shared", shared).withColumn("weighted", F.col("shared") / (F.col("wa") + F.col("wb") - F.col("shared")))
    both = both.withColumn("plain", F.size("common") / (F.size("ma") + F.size("mb") - F.size("common"))).withColumn("first", F.col("weighted") >= similarity - 1e-12)
    good = both.where(F.col("first") | (F.col("plain") >= similarity - 1e-12)).withColumn("similarity", F.when(F.col("first"), F.col("weighted")).otherwise(F.col("plain")))
    good = saved(good.select(*keys, "item", "first", "similarity", "hamming"), "leak-pairs")
    found = places.select("doc", "start", *keys).join(bounded(good), keys)
    best = F.max(F.struct("first", F.round("similarity", 9).alias("s"), (-F.col("start")).alias("t"), (-F.col("hamming")).alias("d"), F.col("m").alias("m"))).alias("x")
    return found.groupBy("doc", "item").agg(best).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("x.s").alias("similarity"), F.greatest(-F.col("x.t"), F.lit(0)).cast("int").alias("start_word"),
        F.col("x.m").cast("int").alias("n_words"), (-F.col("x.d")).cast("int").alias("hamming"),
    )
