"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmark.llm.common import table

BPE_FILE = "byte_bpe_50k.json"


def bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.html_text import extract_text

    return extract_text(table(spark, folder, "pages"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.secrets import scan_secrets, secret_digest

    return secret_digest(scan_secrets(table(spark, folder, "documents")))


def op3_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.ngram_lm import score_texts

    return score_texts(table(spark, folder, "documents"))


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.mixing import mix_sources

    return mix_sources(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, cap=2)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.token_binary import token_files

    return token_files(table(spark, folder, "documents"), bpe_file(), end_id=2)


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.decontaminate import benchmark_matches

    return benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.token_counts import prefix_token_counts

    return prefix_token_counts(table(spark, folder, "documents"), bpe_file(), limit=1024)


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, folder, "embeddings"), limit=0.95)


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), bpe_file(), size=1024, end_id=2).drop("ids")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), label=label)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from monthmark.llm.merkle import tamper_check

    return tamper_check(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_scores": op3_ngram_scores,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_token_binary": op6_token_binary,
    "op7_near_dedup": op7_near_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _leaf_sql(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# CRC-32 bit by bit: a list of the characters is folded into the register, 3988292384 is the polynomial.
_CRC_SQL = """xor(4294967295, list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda r, c: list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(r, c)),
    CAST(4294967295 AS BIGINT)))"""

_MERKLE_SQL = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, coalesce('v' || lang, 'n') AS g, {_leaf_sql("CAST(n_chars AS VARCHAR)")} AS leaf,
           CASE WHEN {_CRC_SQL} % 7 = 0 AND n_chars IS NOT NULL
                THEN {_leaf_sql("CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)")} END AS changed
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY g) AS m
    FROM hashed),
up AS (
    SELECT g, 0 AS lvl, pos, m, leaf AS h FROM leaves
    UNION ALL
    SELECT g, lvl + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM up WHERE m > 1 GROUP BY g, lvl, pos // 2, m),
subroots AS (
    SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM up WHERE m = 1),
over_groups AS (
    SELECT 0 AS lvl, pos, m, h FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM over_groups WHERE m > 1 GROUP BY lvl, pos // 2, m),
steps AS (
    SELECT l.g, l.pos, u.lvl AS k, (l.pos >> u.lvl) % 2 AS slot, s.h AS sibling
    FROM leaves l JOIN (SELECT DISTINCT g, lvl FROM up WHERE m > 1) u USING (g)
    LEFT JOIN up s ON s.g = l.g AND s.lvl = u.lvl AND s.pos = xor(l.pos >> u.lvl, 1)
    UNION ALL
    SELECT l.g, l.pos, 1000 + u.lvl, (r.pos >> u.lvl) % 2, s.h
    FROM leaves l JOIN subroots r USING (g) CROSS JOIN (SELECT DISTINCT lvl FROM over_groups WHERE m > 1) u
    LEFT JOIN over_groups s ON s.lvl = u.lvl AND s.pos = xor(r.pos >> u.lvl, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY k) - 1 AS n FROM steps),
proofs AS (
    SELECT g, pos, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY k)) AS proof_sha256, count(*) AS n
    FROM steps GROUP BY g, pos),
fold AS (
    SELECT g, pos, CAST(0 AS BIGINT) AS n, coalesce(changed, leaf) AS h FROM leaves
    UNION ALL
    SELECT f.g, f.pos, f.n + 1,
           sha256(CASE WHEN s.slot = 1 THEN coalesce(s.sibling, '') || f.h ELSE f.h || coalesce(s.sibling, '') END)
    FROM fold f JOIN numbered s ON s.g = f.g AND s.pos = f.pos AND s.n = f.n)
SELECT l.doc_id, l.leaf, r.h AS subroot, o.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = o.h AS verified
FROM leaves l JOIN subroots r USING (g) CROSS JOIN (SELECT h FROM over_groups WHERE m = 1) o
LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos
JOIN fold f ON f.g = l.g AND f.pos = l.pos AND f.n = coalesce(p.n, 0)
"""

_NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
    SELECT p.*, s.other AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op12_hard_negatives": _NEGATIVES_SQL, "op13_merkle_manifest": _MERKLE_SQL}
