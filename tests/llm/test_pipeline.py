import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as copies
from veritide.llm.pii import base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(tmp_path, spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, prose(rng.randint(16, 40))) for k in range(8)]
    docs, labels, toxic = {}, [], set()
    for i in range(400):
        kind, text = i % 10, prose(rng.randint(20, 80))
        if kind in (1, 2):
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["Zwurg!!", "KRELB", "krelb###", "zwurg"])
            text = " ".join(words)
            toxic.add(i)
        elif kind == 3 and i > 10:
            text = docs[i - 3].replace(" ", "\n", 1) + (" tail" if i % 20 == 3 else "")
        elif kind == 4:
            text = f"{text} {items[i % 8][1]} {prose(10)}"
        elif kind == 5:
            text = f"{text} name{i}@mail.example and +1 (555) 010-{1000 + i} end"
        docs[i] = text
        labels.append((i, 1, int(i in toxic)))
    docs[900], docs[901], docs[902] = "", None, "one"
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, items, toxic


def test_stages_are_those_of_a_plain_version(spark, tmp_path):
    docs, items, toxic = planted(tmp_path, spark)
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, stages = dict(docs), [f for _, f in corpus_pipeline.STAGES]
    for k, stage in enumerate(stages):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert at.dtypes == spark.createDataFrame([], SCHEMA).dtypes
        got = {r.doc_id: r for r in at.collect()}
        if k == 0:
            kept = {i: t for i, t in kept.items() if i not in toxic}
        elif k == 1:
            found = copies(list(kept.items()))
            kept = {i: t for i, t in kept.items() if found[i][1] == i}
        elif k == 2:
            gone = {i for i, _ in leaks(list(kept.items()), items)}
            assert gone
            kept = {i: t for i, t in kept.items() if i not in gone}
        assert set(got) == set(kept)
        if k == 3:
            for i, t in kept.items():
                assert not base_spans(got[i].text or "")
                if t is None or not base_spans(t):
                    assert got[i].text == t
                assert got[i].n_chars == (None if t is None else len(got[i].text))
            kept = {i: got[i].text for i in kept}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in at.collect():
        text = kept[r.doc_id] or ""
        assert list(array("I", bytes(r.ids))) == plain.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(r.ids) // 4


def test_an_empty_table_goes_through(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null ids, repeated rows (one stays), nulls in every column, empty texts, and columns named as the operators' own."""
    planted(tmp_path, spark)
    names = ["_id", "_y", "_gone", "gone", "key", "fp", "spans", "id", "again", "component_id", "score", "doc"]
    schema = f"{SCHEMA}, {', '.join(f'{n} string' for n in names)}"
    extra = [n[::-1] for n in names]
    rows = [
        (None, "some plain words here", "en", "s", 1, *extra), (None, "some plain words here", "en", "s", 1, *extra), (5001, "other plain words there", "en", "s", 1, *extra),
        (5001, "other plain words there", "en", "s", 1, *extra), (5002, None, None, None, None, *[None] * len(names)), (5003, "", None, None, None, *extra), (5004, "long words " * 30_000, "en", "s", 2, *extra),
    ]
    odd = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        odd = stage(spark, odd, str(tmp_path))
        got = sorted(str(r.doc_id) for r in odd.collect())
        assert got == ["5001"] * (2 if k == 0 else 1) + ["5002", "5003", "5004", "None", "None"], k
        if k < 4:
            assert odd.columns == spark.createDataFrame([], schema).columns and {r._gone for r in odd.collect()} == {"enog_", None}
