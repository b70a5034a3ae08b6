"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.common import held_out, table


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veritide.llm.bpe import encode_texts

    out = encode_texts(table(spark, sf_dir, "documents"), _public("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.langid import fit, identify, vocabulary

    docs = table(spark, sf_dir, "documents")
    pieces = vocabulary(_public("piece_bpe_32k.model"))
    model = fit(docs.where(~held_out()), pieces)
    return identify(docs, model, pieces).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _public("byte_bpe_50k.json"), 1024)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.secrets import labelled_findings, pieces, scan, train

    judge = train(labelled_findings(), pieces(_public("byte_bpe_50k.tiktoken")))
    return scan(table(spark, sf_dir, "documents"), judge)


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, 10)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.jaccard import join_components

    return join_components(table(spark, sf_dir, "documents"), 75)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.pii import KINDS, find, joined

    found = find(table(spark, sf_dir, "documents"))
    # A lambda's second parameter would be the index of the element, default or not.
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritide.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_language_id, op3_token_counts, op4_secret_scan, op5_nearest_vectors,
        op6_jaccard_join, op7_personal_data, op8_main_text, op9_toxicity, op10_decontamination,
    )
}
#: SQL of what it can say; the others are held against plain versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op6_jaccard_join": r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM t),
 n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, hash(x) AS h, x FROM (SELECT doc_id, unnest(g) AS x FROM s)),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM u a JOIN u b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
 d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), walk(doc_id, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT walk.doc_id, d.b FROM walk JOIN d ON walk.node = d.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(node) AS component_id FROM walk JOIN n ON n.doc_id = walk.doc_id GROUP BY n.doc_id""",
}
