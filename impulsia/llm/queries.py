"""The corpus operators as named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from impulsia.llm.common import table


def op1_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.licences import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from impulsia.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.quality_rules import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.ctw import scored

    return scored(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.pii import DEMO_KEY, pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.substring_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), digest=True)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.jaccard_join import joined

    return joined(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from impulsia.llm.nbsvm import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from impulsia.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Windows by their text; the smallest id of each; words under windows that a smaller id has.
_OP7 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
d AS (SELECT r, i FROM p JOIN (SELECT g, min(doc_id) AS m FROM p GROUP BY g) USING (g) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, i + k AS pos FROM d, (SELECT unnest(range(13)) AS k)),
k AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
s AS (SELECT k.r, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY k.pos) FILTER (WHERE gone.pos IS NULL) AS kept FROM k LEFT JOIN gone ON gone.r = k.r AND gone.pos = k.pos GROUP BY k.r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (r)"""

#: Distinct sets, pairs of sets by common shingles, and the smallest id that links reach.
_OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS g FROM w),
u AS (SELECT min(doc_id) AS id, md5(array_to_string(list_sort(g), chr(10))) AS h, any_value(g) AS g, any_value(len(g)) AS n FROM s WHERE len(g) > 0 GROUP BY h),
t AS (SELECT id, n, unnest(g) AS x FROM u),
c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (na + nb - k) UNION SELECT b, a FROM c WHERE 100 * k >= 80 * (na + nb - k)),
r(id, root) AS (SELECT id, id FROM u UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN u ON len(s.g) > 0 AND u.h = md5(array_to_string(list_sort(s.g), chr(10))) LEFT JOIN m ON m.id = u.id"""


def oracle_sql() -> dict[str, str]:
    """Of what SQL can express; the others learn, tokenize or are keyed and are tested against brute force."""
    return {"op7_substring_dedup": _OP7, "op8_ngram_jaccard_join": _OP8}
