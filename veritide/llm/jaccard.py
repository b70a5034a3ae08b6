"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles. In one order of all shingles, rare before
frequent, two linked documents share a shingle of their prefixes. Documents with equal sets form a
class; classes with the same size and prefix form a group, which enters the prefix index once.
Group pairs that meet there and fit in size are expanded to their classes and verified on whole
sets. Verification goes in rounds: a star in every large list first, then, of the pairs whose ends are
not yet connected, the likeliest that join what is apart, then the others that still do, until none is held back;
so no link between components is lost and no list of copies is expanded into all pairs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.common import emit, forget, saved
from veritide.llm.components import components, follow
from veritide.llm.shingles import lots, mix, shingle_sets
from veritide.session import ship_package

#: Counters that tell frequent shingles from rare ones: a fixed size, whatever the corpus.
COUNTER_BITS = 22
#: Prefix entries of an index bucket, lists up to which all pairs are made at once, bytes of sets in a bin.
BUCKET_ENTRIES, SMALL_LIST, BIN_BYTES = 1_000_000, 12, 12 << 20
#: Members of a block of a long list, rows of a task that compares lists, and members of a list that one salt stands for.
BLOCK_MEMBERS, LIST_ROWS, LIST_SALT = 2_048, 60_000, 512
#: By how much the number of pairs that a round takes of two labels grows from round to round.
GROWTH = 32
#: Pairs that a task keeps besides the likeliest.
ROOM = 1 << 17
#: Bits of the filter that tells which documents' sets are needed.
FILTER_BITS = 1 << 23
SEEN = 1 << 17
#: Prefixes are so long that linked documents share this many of their shingles, if the smaller has TINY or more.
SHARED, TINY = 2, 8


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    return lots(((t.as_py() or "").encode(), k) for batch in batches for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))


def frequent_levels(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """A level for each counter of shingle hashes: 0 for rare ones, else the order of magnitude.

    All documents are counted. It only sets the order of shingles, and any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, kept, held = np.zeros(1 << COUNTER_BITS, np.int32), [], 0
        for lot in _texts(batches):
            for s in shingle_sets([t for t, _ in lot]):
                kept.append(s >> np.uint64(64 - COUNTER_BITS))
                held += len(s)
            if held > 1 << 20:
                np.add.at(counts, np.concatenate(kept).astype(np.int64), 1)
                kept, held = [], 0
        if kept:
            np.add.at(counts, np.concatenate(kept).astype(np.int64), 1)
        often = np.flatnonzero(counts >= max(8, 4 * counts.mean()))
        schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("all", pa.int64())])
        total = int(counts.sum(dtype=np.int64))
        yield from emit(((int(i), int(counts[i]), total if k == 0 else 0) for k, i in enumerate([-1, *often])) if total else iter(()), schema, lambda r: 16)

    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "at int, n long, all long")
    counted = saved(counted.groupBy("at").agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "jaccard-counts")
    total = counted.agg(F.sum("all")).collect()[0][0] or 0
    least = max(32.0, 16.0 * total / (1 << COUNTER_BITS))
    levels = np.zeros(1 << COUNTER_BITS, np.uint8)
    rows = counted.where((F.col("at") >= 0) & (F.col("n") >= least)).select("at", F.floor(F.log2(F.col("n") / least)).cast("int").alias("level"))
    got = rows.toPandas()  # at most a sixteenth of the counters
    levels[got["at"].to_numpy(np.int64)] = 1 + got["level"].to_numpy()
    return levels


def _class(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles' counts over a power of two of places, at least twice their number, as 64-bit words.

    The parities of two sets differ in no more places than the sets do in members.
    """
    places = 1 << max(6, (2 * len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches do not rule out the similarity: none that has it is lost."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("sketch").alias("s" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fold = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    a = F.when(F.size("sa") > F.size("sb"), fold(F.col("sa"))).otherwise(F.col("sa"))
    b = F.when(F.size("sb") > F.size("sa"), fold(F.col("sb"))).otherwise(F.col("sb"))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    # |A and B| <= (|A| + |B| - apart) / 2, and a link needs (100 + percent) * |A and B| >= percent * (|A| + |B|)
    return both.where((100 + percent) * (F.col("na") + F.col("nb") - apart) >= 2 * percent * (F.col("na") + F.col("nb"))).select("a", "b")


def documents_table(docs: DataFrame, levels, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc, n, class, gid, low (the smallest shingle), sketch and, once for each group and task, prefix."""
    fields = [("doc", pa.int64()), ("n", pa.int32()), ("class", pa.binary()), ("gid", pa.int64()), ("low", pa.int64()), ("sketch", pa.list_(pa.int64())), ("prefix", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        level, seen = levels.value, set()

        def rows() -> Iterator[tuple]:
            for lot in _texts(batches):
                for (_, doc), s in zip(lot, shingle_sets([t for t, _ in lot]), strict=True):
                    n = len(s)
                    if not n:
                        yield doc, 0, b"", None, None, None, None
                        continue
                    order = np.argsort(level[s >> np.uint64(64 - COUNTER_BITS)], kind="stable")
                    prefix = s[order[: n - -(-percent * n // 100) + SHARED]].tobytes()
                    gid = int.from_bytes(hashlib.blake2b(prefix + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                    first = gid not in seen
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(gid)
                    yield doc, n, _class(s), gid, int(s[:1].view(np.int64)[0]), sketch(s), prefix if first else None

        return emit(rows(), schema, lambda r: 60 + 2 * r[1] + len(r[6] or b""))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc long, n int, class binary, gid long, low long, sketch array<bigint>, prefix binary"
    )


def index_rows(table: DataFrame, buckets: int) -> DataFrame:
    """Prefix entries packed by bucket of the shingle."""
    schema = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("m", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(hs: list, gs: list, ms: list) -> Iterator[tuple]:
            h, sizes = np.concatenate(hs), [len(x) for x in hs]
            g, m = np.repeat(np.array(gs, np.int64), sizes), np.repeat(np.array(ms, np.int32), sizes)
            bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, h, g, m = bucket[order], h[order].astype(np.uint32), g[order], m[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1)))
            for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
                yield int(bucket[a]), h[a:b].tobytes(), g[a:b].tobytes(), m[a:b].tobytes()

        def rows() -> Iterator[tuple]:
            hs, gs, ms, held = [], [], [], 0
            for batch in batches:
                for gid, n, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    hs.append(np.frombuffer(prefix.as_py(), np.uint64))
                    gs.append(gid)
                    ms.append(n)
                    held += len(hs[-1])
                    if held >= 1 << 20:
                        yield from packed(hs, gs, ms)
                        hs, gs, ms, held = [], [], [], 0
            if hs:
                yield from packed(hs, gs, ms)

        return emit(rows(), schema, lambda r: sum(map(len, r[1:])))

    return table.where("prefix is not null").select("gid", "n", "prefix").mapInArrow(run, "bucket int, h binary, g binary, m binary")


def _unique_pairs(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, the smaller end first, with its summed weight (1 for each time it comes, if none is given)."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    summed = np.bincount(np.cumsum(new) - 1, None if weight is None else weight[order], int(new.sum())).astype(np.int32)
    return a[new], b[new], summed


def candidates(table: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Rows (a, b, run, m): group pairs that share m prefix shingles (run null), and the members
    (group a, of a list of m) of each long list, whose pairs beyond a star are made later.

    A linked pair shares SHARED prefix shingles at least: all in short lists, where they are
    counted, or one in a long list. Pairs of a star and of tiny sets count as SHARED at once.
    Both ways are exact; SMALL_LIST only says where pairs are so few that they are made at once.
    """
    packed = index_rows(table, buckets)

    def lists(rows: pa.Table) -> pa.Table:
        forget()
        h, g, m = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows[c]]) for c, kind in (("h", np.uint32), ("g", np.int64), ("m", np.int32)))
        order = np.lexsort((g, m, h))
        h, g, m = h[order], g[order], m[order]
        del order
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        h, g, m = h[new], g[new], m[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        run = (np.cumsum(first) - 1).astype(np.int32)
        size = np.bincount(run)[run].astype(np.int32) if len(run) else run
        keep = size > 1
        g, m, run, size = g[keep], m[keep], run[keep], size[keep]
        del h, new, first, keep
        fits = lambda x, y: 100 * np.minimum(m[x], m[y]).astype(np.int64) >= percent * np.maximum(m[x], m[y])
        left, right, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        small = size <= SMALL_LIST
        for d in range(1, SMALL_LIST):
            i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:]))
            i = i[fits(i, i + d)]
            left.append(g[i])
            right.append(g[i + d])
            weight.append(np.where(np.minimum(m[i], m[i + d]) < TINY, SHARED, 1))
        big = np.flatnonzero(~small)
        if len(big):
            band = np.floor(np.log(m[big]) / -math.log(percent / 100)).astype(np.int64)
            head = np.ones(len(big), bool)
            head[1:] = (run[big][1:] != run[big][:-1]) | (band[1:] != band[:-1])
            hub = big[np.maximum.accumulate(np.where(head, np.arange(len(big)), 0))]
            ok = fits(hub, big) & (hub != big)
            left.append(g[hub[ok]])
            right.append(g[big[ok]])
            weight.append(np.full(int(ok.sum()), SHARED))
        a, b, times = _unique_pairs(np.concatenate(left), np.concatenate(right), np.concatenate(weight))
        pairs = pa.table({"a": pa.array(a), "b": pa.array(b), "run": pa.nulls(len(a), pa.int64()), "m": pa.array(times)})
        # Lists with the same members get the same key: they are one list.
        at = np.cumsum(np.diff(run[big], prepend=-1) != 0) - 1
        sums = np.zeros(at[-1] + 1 if len(at) else 0, np.uint64)
        np.add.at(sums, at, mix(g[big].astype(np.uint64)))
        key = mix(sums).view(np.int64)[at]
        members = pa.table({"a": pa.array(g[big]), "b": pa.nulls(len(big), pa.int64()), "run": pa.array(key), "m": pa.array(size[big])})
        return pa.concat_tables([pairs, members])

    return packed.groupBy("bucket").applyInArrow(lists, "a long, b long, run long, m int")


def open_lists(runs: DataFrame, known: DataFrame) -> DataFrame:
    """(run, main, members, others, node, label) of the lists of ``runs`` (run, gid, size) whose members have more than one label.

    ``main`` is the label that most members have, ``others`` the number of those that have not. The
    rows of a long list are salted by its size.
    """
    salts = F.ceil(F.col("size") / LIST_SALT).cast("int")
    listed = saved(runs.join(known, "gid").select("run", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), salts.alias("salts"), "node", "label"), "jaccard-listed")
    counts = listed.groupBy("run", "label").agg(F.count("*").alias("c"), F.max("salts").alias("salts"))
    lists = counts.groupBy("run").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("members"), F.max("salts").alias("salts")).where(F.col("members") > F.col("top.c"))
    lists = lists.select("run", F.col("top.label").alias("main"), "members", (F.col("members") - F.col("top.c")).alias("others"), "salts")
    # Lists of one main label mostly hold the same pairs: they are kept together, in parts of bounded size.
    parts = lists.groupBy("main").agg(F.ceil(F.sum("members") / (8 * LIST_ROWS)).alias("parts"))
    lists = lists.join(parts, "main").withColumn("part", F.pmod(F.xxhash64("run"), F.col("parts"))).drop("parts")
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return saved(listed.drop("salts").join(lists, ["run", "salt"]).drop("salt"), "jaccard-open")


def list_members(listed: DataFrame) -> DataFrame:
    """(task, run, i, j, asks, twin, node): the rows of the tasks that compare the members of ``listed``.

    Members of other than the main label are dealt to groups, all members to blocks, and a task
    compares a group (asks) with a block (twin: a member that asks elsewhere), so its rows are bounded.
    """
    blocks, groups = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int"), F.ceil(F.col("others") / BLOCK_MEMBERS).cast("int")
    other = F.col("label") != F.col("main")
    rows = listed.withColumns({"k": blocks, "g": groups, "own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "team": F.pmod(F.xxhash64(F.lit(1), "node"), groups).cast("int"), "twin": other})
    base = ["run", "main", "part", "node", "twin"]
    block_side = rows.select(*base, F.lit(False).alias("asks"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"))
    group_side = rows.where("twin").select(*base, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.col("team").alias("j"))
    task = F.pmod(F.xxhash64("main", "part", "i", "j"), F.lit(max(1, math.ceil(listed.count() / LIST_ROWS)))).cast("int")
    return saved(block_side.union(group_side).select(task.alias("task"), "run", "i", "j", "asks", "twin", "node"), "jaccard-members")


def list_pairs(members: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """(task, a, b, later): pairs of ``members`` that have different labels in ``nodes`` (node, label, n, sketch) and whose
    sketches do not rule out the similarity; a row with nulls tells that the task held some back.

    A task gets each sketch once, and gives the likeliest pairs: those that join all labels of its
    lists which any pairs join, and ``most`` of each pair of labels. Its other pairs come as later ones,
    unless they are so many that some had to be dropped on the way: then the task has to look again.
    """
    sketches = members.select("task", "node").distinct().join(nodes, "node")
    kinds = {"run": "long", "i": "int", "j": "int", "asks": "boolean", "twin": "boolean", "label": "long", "n": "int", "sketch": "array<bigint>"}
    empty = lambda *names: {c: F.lit(None).cast(kinds[c]) for c in names}
    columns = ["task", "run", "i", "j", "asks", "twin", "node", "label", "n", "sketch"]
    both = members.withColumns(empty("label", "n", "sketch")).select(columns).union(sketches.withColumns(empty("run", "i", "j", "asks", "twin")).select(columns))

    def likely(table: pa.Table) -> pa.Table:
        forget()
        is_sketch = pc.is_valid(table["n"])
        task = table["task"][0].as_py()
        held, table = table.filter(is_sketch).combine_chunks().sort_by("node"), table.filter(pc.invert(is_sketch)).drop_columns(["label", "n", "sketch"])
        known, label, n = (held[c].to_numpy() for c in ("node", "label", "n"))
        sketches = held["sketch"].combine_chunks()
        sketches = sketches.chunk(0) if isinstance(sketches, pa.ChunkedArray) else sketches
        flat, offset = sketches.values.to_numpy(zero_copy_only=False).view(np.uint64), sketches.offsets.to_numpy()
        width = np.diff(offset)
        run, i, j = (table[c].to_numpy() for c in ("run", "i", "j"))
        node = np.searchsorted(known, table["node"].to_numpy())
        asks, twin = (table[c].to_numpy().astype(bool) for c in ("asks", "twin"))
        order = np.lexsort((j, i, run))
        cut = np.flatnonzero(np.diff(run[order], prepend=run[order[:1]] - 1) | np.diff(i[order], prepend=-1) | np.diff(j[order], prepend=-1))
        found = Likeliest(most)
        for start, stop in zip(cut, [*cut[1:], len(order)], strict=True):
            group = order[start:stop]
            askers, at_block = node[group[asks[group]]], group[~asks[group]]
            others, doubled = node[at_block], twin[at_block]
            for w in np.unique(width[askers]):
                left = askers[width[askers] == w]
                for v in {w // 2, w, 2 * w} & set(np.unique(width[others]).tolist()):
                    right, once = others[width[others] == v], ~doubled[width[others] == v]
                    a, b = flat[offset[left][:, None] + np.arange(w)], flat[offset[right][:, None] + np.arange(v)]
                    if v > w:
                        b = b[:, :w] ^ b[:, w:]
                    elif w > v:
                        a = a[:, :v] ^ a[:, v:]
                    for at, x in enumerate(left):
                        pick = (label[right] != label[x]) & (100 * np.minimum(n[right], n[x]).astype(np.int64) >= percent * np.maximum(n[right], n[x]))
                        pick &= once | (x < right)  # two that ask meet twice
                        near = np.flatnonzero(pick)
                        if not len(near):
                            continue
                        apart = np.bitwise_count(b[near] ^ a[at]).sum(axis=1, dtype=np.int64)
                        total = n[right[near]].astype(np.int64) + n[x]
                        good = (100 + percent) * (total - apart) >= 2 * percent * total
                        y = right[near[good]]
                        if len(y):
                            found.add(np.full(len(y), known[x]), known[y], np.full(len(y), label[x]), label[y], apart[good] / total[good])
        a, b, later = found.pairs()
        nothing = pa.nulls(int(found.back), pa.int64())
        a, b = pa.concat_arrays([pa.array(a, pa.int64()), nothing]), pa.concat_arrays([pa.array(b, pa.int64()), nothing])
        later = pa.concat_arrays([pa.array(later, pa.bool_()), pa.array([False] * len(nothing), pa.bool_())])
        return pa.table({"task": pa.array(np.full(len(a), task), pa.int32()), "a": a, "b": b, "later": later})

    return both.groupBy("task").applyInArrow(likely, "task int, a long, b long, later boolean")


class Likeliest:
    """The likeliest pairs of those added: a forest over their labels, and ``most`` for each pair of labels.

    The others are kept too while there is room; ``back`` tells that some were dropped.
    """

    def __init__(self, most: int, room: int = ROOM):
        self.most, self.room, self.parts, self.held, self.back = most, room, [], 0, False

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > self.room or len(self.parts) > 4_000:
            columns, take = self._best()
            if 2 * len(take) > self.room:
                self.back |= not take.all()
                columns = tuple(c[take] for c in columns)
            self.parts, self.held = [columns], len(columns[0])
            self.room = max(self.room, 2 * self.held)

    def _best(self) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """All different pairs, and which of them are the likeliest."""
        a, b, x, y, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        swap = a > b
        a, b, x, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x), np.where(swap, x, y)
        order = np.lexsort((b, a))
        keep = np.ones(len(a), bool)
        keep[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        a, b, x, y, score = (c[order][keep] for c in (a, b, x, y, score))
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((b, a, score, high, low))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        take = np.zeros(len(order), bool)
        if self.most > 1:
            take[order] = place < self.most
        best = order[new]
        root: dict[int, int] = {}
        for at in best[np.lexsort((b[best], a[best], score[best]))].tolist():
            u, v = self._root(root, int(low[at])), self._root(root, int(high[at]))
            if u != v:
                root[v] = u
                take[at] = True
        return (a, b, x, y, score), take

    @staticmethod
    def _root(root: dict[int, int], x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ends of the pairs, and whether they are later ones: none, if some were dropped."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        (a, b, *_), take = self._best()
        keep = take if self.back else np.ones(len(take), bool)
        return a[keep], b[keep], ~take[keep]


def needed_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the classes in ``nodes`` (node, class).

    A bit filter of fixed size drops the documents that are not asked for; the join is exact.
    """
    spark = docs.sparkSession
    bits = np.zeros(FILTER_BITS, bool)
    found = nodes.select(F.pmod(F.crc32(F.col("node").cast("string").cast("binary")), F.lit(FILTER_BITS)).alias("bit")).distinct()
    pages = found.groupBy(F.floor(F.col("bit") / 4096).alias("page")).agg(F.collect_list(F.pmod("bit", F.lit(4096)).cast("int")).alias("bits"))
    for row in pages.toLocalIterator():  # at most FILTER_BITS numbers
        bits[row.page * 4096 + np.array(row.bits)] = True
    sent = spark.sparkContext.broadcast(np.packbits(bits))
    schema = pa.schema([("node", pa.int64()), ("class", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(sent.value).astype(bool)

        def asked() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if doc is not None and flags[zlib.crc32(str(doc).encode()) % FILTER_BITS]:
                        yield (text.as_py() or "").encode(), doc

        def rows() -> Iterator[tuple]:
            for lot in lots(asked()):
                for (_, doc), s in zip(lot, shingle_sets([t for t, _ in lot]), strict=True):
                    yield doc, _class(s), s.tobytes()

        return emit(rows(), schema, lambda r: 24 + len(r[2]))

    got = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "node long, class binary, shingles binary")
    # A node has one class, so its sets are equal; by node alone they lie where the next join wants them.
    return got.join(nodes.select("node", "class"), ["node", "class"]).groupBy("node").agg(F.first("shingles").alias("shingles"))


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets reach the similarity.

    Nodes are dealt to bins of bounded volume, those with a common smallest shingle to one bin unless they are a crowd, and a set goes once to
    each pair of bins that needs it.
    """
    asked = saved(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "class", "n", "low"), "node"), "jaccard-asked")
    volume = asked.agg(F.sum(F.col("n") * 8)).collect()[0][0] or 0
    n_bins = max(1, math.ceil(volume / BIN_BYTES))
    crowds = asked.groupBy("low").agg(F.sum(F.col("n") * 8).alias("bytes"))
    place = F.when(F.col("bytes") <= BIN_BYTES // 4, F.xxhash64("low")).otherwise(F.xxhash64("low", "node"))
    bins = saved(asked.join(crowds, "low").select("node", F.pmod(place, F.lit(n_bins)).cast("int").alias("bin")), "jaccard-bins")
    placed = pairs.join(bins.select(F.col("node").alias("a"), F.col("bin").alias("x")), "a").join(bins.select(F.col("node").alias("b"), F.col("bin").alias("y")), "b")
    placed = saved(placed.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "jaccard-pairs")
    wanted = placed.select("x", "y", F.col("a").alias("node")).union(placed.select("x", "y", F.col("b").alias("node"))).distinct()
    sets = needed_sets(docs, asked, id_col, text_col)
    shipped = wanted.join(sets, "node").select("x", "y", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    both = shipped.unionByName(placed.withColumn("shingles", F.lit(None).cast("binary")))

    def check(rows: pa.Table) -> pa.Table:
        forget()
        a, b = rows["a"].to_numpy(), rows["b"]
        is_set = np.array(b.is_null())
        held = {int(k): np.frombuffer(v.as_py(), np.uint64) for k, v, f in zip(a, rows["shingles"], is_set, strict=True) if f}
        out: tuple[list[int], list[int]] = ([], [])
        for left, right in zip(a[~is_set].tolist(), b.filter(pa.array(~is_set)).to_pylist(), strict=True):
            s, t = held[left], held[right]
            if len(s) > len(t):
                s, t = t, s
            if 100 * len(s) < percent * len(t):
                continue
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            both = int((t[at] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                out[0].append(left)
                out[1].append(right)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return both.groupBy("x", "y").applyInArrow(check, "a long, b long")


def join_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` for every row: the smallest id reachable by links.

    Null and empty texts have no shingles and are linked with nothing; rows with a null id link
    nothing and have a null component; repeated rows each get a row; an empty table gives an empty
    result; other columns are ignored. A pair is linked when 100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    ship_package(spark)
    levels = spark.sparkContext.broadcast(frequent_levels(docs, id_col, text_col))
    table = saved(documents_table(docs, levels, percent, id_col, text_col), "jaccard-docs")
    entries = table.where("prefix is not null").agg(F.sum(F.octet_length("prefix") / 8)).collect()[0][0] or 0
    classes = saved(
        table.where("n > 0 and doc is not null").groupBy("class").agg(F.min("doc").alias("node"), F.min("gid").alias("gid"), F.min("n").alias("n"), F.min("low").alias("low"), F.first("sketch").alias("sketch")),
        "jaccard-classes",
    )
    found = saved(candidates(table, max(6, math.ceil(entries / BUCKET_ENTRIES)), percent), "jaccard-candidates")
    group_pairs = saved(found.where("run is null").groupBy("a", "b").agg(F.sum("m").alias("m")).where(F.col("m") >= SHARED).select("a", "b"), "jaccard-group-pairs")
    runs = found.where("run is not null").select("run", F.col("a").alias("gid"), F.col("m").cast("long").alias("size"))

    groups = saved(classes.groupBy("gid").agg(F.min("node").alias("head"), F.count("*").alias("members")), "jaccard-groups")
    # Most classes meet another one, so all of them are nodes: to leave the others out would shuffle every sketch.
    nodes = classes
    head = groups.select("gid", "head")
    stars = nodes.join(head, "gid").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads = group_pairs.join(head.select(F.col("gid").alias("a"), F.col("head").alias("ha")), "a").join(head.select(F.col("gid").alias("b"), F.col("head").alias("hb")), "b")
    first = stars.union(heads.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))).distinct()
    tried = saved(may_link(first, nodes, percent), "jaccard-first")
    labels = components(saved(verify(tried, nodes, docs, percent, id_col, text_col), "jaccard-links"))
    known = saved(nodes.select("gid", "node").join(labels, "node", "left").select("gid", "node", F.coalesce("label", "node").alias("label")), "jaccard-known")

    many = groups.where("members > 1").select("gid", "members")
    wide = group_pairs.join(many.select(F.col("gid").alias("a"), F.col("members").alias("wa")), "a", "left").join(many.select(F.col("gid").alias("b"), F.col("members").alias("wb")), "b", "left")
    wide = wide.where("wa is not null or wb is not null").select(F.xxhash64("a", "b").alias("run"), "a", "b", (F.coalesce("wa", F.lit(1)) + F.coalesce("wb", F.lit(1))).alias("size"))
    # Groups of several classes, and pairs with such groups, are lists too.
    runs = runs.union(many.select(F.col("gid").alias("run"), "gid", F.col("members").alias("size"))).union(wide.select("run", F.col("a").alias("gid"), "size")).union(wide.select("run", "b", "size"))
    runs = saved(runs.groupBy("run", "gid").agg(F.max("size").alias("size")), "jaccard-runs")
    members, most = list_members(open_lists(runs, known)), 1
    while True:
        # A round takes the likeliest pairs of labels that are still apart, then the later ones that still are; tasks that dropped some look again.
        found = saved(list_pairs(members, known.select("node", "label").join(nodes.select("node", "n", "sketch"), "node"), percent, most), "jaccard-round")
        back = found.where("a is null").select("task").distinct()
        for later in (False, True):
            new = found.where(F.col("a").isNotNull() & (F.col("later") == later)).select("a", "b").distinct()
            side = lambda k: known.select(F.col("node").alias(k), F.col("label").alias("l" + k))
            if later:
                new = new.join(side("a"), "a").join(side("b"), "b").where("la <> lb").select("a", "b")
            new = saved(new.join(tried, ["a", "b"], "left_anti"), "jaccard-new")
            if not new.isEmpty():
                tried = tried.union(new)
                links = saved(verify(new, nodes, docs, percent, id_col, text_col), "jaccard-links")
                moved = components(links.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
                known = saved(follow(known, moved), "jaccard-known")
        if back.isEmpty():
            break
        members, most = saved(members.join(back, "task", "left_semi"), "jaccard-members"), most * GROWTH
    labels = known.select("node", "label")

    resolved = classes.select("class", "node").join(labels, "node", "left").select("class", F.coalesce("label", "node").alias("component"))
    component = F.when(F.col("n") == 0, F.col("doc")).when(F.col("doc").isNotNull(), F.col("component"))
    return table.select("doc", "n", "class").join(resolved, "class", "left").select(
        F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")
    )
