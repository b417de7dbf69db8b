"""Queries of this subpackage's operators, each over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, fingerprint, htmltext, langid, licenses, linededup, merkle, minhash, packing, toxicity, warc, whitening
from .common import bound_batches, documents, read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), capacity=2048, end_id=0)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=5, percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.with_next(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=32)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_of(documents(spark, sf_dir))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _bounded(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _bounded(f)
    for f in (
        op1_embedding_near_dedup, op2_language_id, op3_bpe_round_trip, op4_html_extraction, op5_best_fit_packing, op6_minhash_near_dedup, op7_line_dedup,
        op8_license_scan, op9_toxicity, op10_document_fingerprints, op11_embedding_whitening, op12_merkle_manifest, op13_warc_round_trip, pipeline,
    )
}

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: Whether the CRC-32 of a decimal number is even: its bits one by one, before the last inversion.
_EVEN = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) & 1 = 1"
#: A step of a proof: what stands left and right of the node with place p in its run.
_STEP = "array_to_string(nodes[p - p % 3 + 1 : p], '') || '|' || array_to_string(nodes[p + 2 : p - p % 3 + 3], '')"
_ABOVE = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], '')))"

#: DuckDB SQL for what SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN links USING (vec_id)
""",
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'i': i})) AS u FROM documents)
), f AS (SELECT k, min(doc_id) AS low FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f.low < doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.low IS NULL OR f.low >= doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE r AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS rid FROM (
    SELECT doc_id, coalesce('=' || source, '') AS g, {_LEAF.format(text="text")} AS leaf,
      CASE WHEN {_EVEN} THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS now FROM documents)
), up(g, l, nodes) AS (
  SELECT g, 0, list(leaf ORDER BY place) FROM r GROUP BY g UNION ALL SELECT g, l + 1, {_ABOVE} FROM up WHERE len(nodes) > 1
), groups AS (
  SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM up WHERE len(nodes) = 1
), top(l, nodes) AS (
  SELECT 0, list(subroot ORDER BY k) FROM groups UNION ALL SELECT l + 1, {_ABOVE} FROM top WHERE len(nodes) > 1
), steps AS (
  SELECT rid, l, {_STEP} AS step FROM (SELECT rid, l, nodes, place // (3 ** l)::BIGINT AS p FROM r JOIN up USING (g) WHERE len(nodes) > 1)
  UNION ALL SELECT rid, 100 + l, {_STEP} FROM (SELECT rid, l, nodes, k // (3 ** l)::BIGINT AS p FROM r JOIN groups USING (g) CROSS JOIN top WHERE len(nodes) > 1)
), ways AS (SELECT rid, list(step ORDER BY l) AS steps FROM steps GROUP BY rid),
f AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(replace(array_to_string(coalesce(steps, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(now, coalesce(steps, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM r JOIN groups USING (g) LEFT JOIN ways USING (rid))
SELECT *, folded_root = root AS verified FROM f
""",
    "op13_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS original, sha1(h) AS s FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to FROM d
""",
}
