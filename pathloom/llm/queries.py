"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.llm import decontam, html_text, lm, merkle, neardup, negatives, packing, pii, quality, simhash, token_output, url_filter, warc
from pathloom.llm.common import materialise

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return neardup.near_duplicates(docs, width=4)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies; the same on the driver and all executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path(), packing.Limits(tokens=4096))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives, index = warc.folders(pages)
    captures = warc.write_archives(pages, archives)
    return warc.read_all(captures, warc.build_index(captures, index), archives, index)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = token_output.write_token_files(docs, tokenizer_path(), token_output.scratch_folder(docs))
    return token_output.read_token_files(manifest)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    measured = materialise(quality.measures(docs), "measures")
    labels = quality.sampled(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rules = quality.learn(*quality.sample(measured, labels))
    return quality.judge(measured, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule_no")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pii.report(pii.find(docs))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", "embedding", label.alias("label")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    longer = F.col("n_chars").cast("decimal(20,0)") + F.when(tampered, 1).otherwise(0)
    checked = merkle.verify(docs, {"n_chars": longer})
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.near_duplicates(docs, width=4, distance=4)


_OP1_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(r_host, r_path, r_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT arg_max(r_host || r_path, length(r_host || r_path)) FROM rules
        WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
       coalesce((SELECT arg_max(r_verdict, length(r_host || r_path)) FROM rules
        WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
FROM parts
"""

_OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike,
         list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "chars", "text")) + ")"
_OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, tree, {_LEAF.replace("chars", "n_chars")} AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN {_LEAF.replace("chars", "(n_chars + 1)")} ELSE {_LEAF.replace("chars", "n_chars")} END AS claimed,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size
  FROM docs),
nodes(tree, level, place, size, hash) AS (
  SELECT tree, 0, place, size, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(hash, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY tree, level, place // 2, size),
subroots AS (SELECT tree, level AS height, hash FROM nodes WHERE size = 1),
over(level, place, size, hash) AS (
  SELECT 0, tree - 1, (SELECT count(*) FROM subroots), hash FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(hash, '' ORDER BY place))
  FROM over WHERE size > 1 GROUP BY level, place // 2, size),
folded(doc_id, tree, place, upper, level, own, siblings) AS (
  SELECT doc_id, tree, place, tree - 1, 0, claimed, '' FROM leaves
  UNION ALL
  SELECT f.doc_id, f.tree, f.place // 2, CASE WHEN f.level < s.height THEN f.upper ELSE f.upper // 2 END, f.level + 1,
         sha256(CASE WHEN (CASE WHEN f.level < s.height THEN f.place ELSE f.upper END) % 2 = 0 THEN f.own || coalesce(n.hash, o.hash, '') ELSE coalesce(n.hash, o.hash, '') || f.own END),
         f.siblings || coalesce(n.hash, o.hash, '')
  FROM folded f JOIN subroots s USING (tree)
  LEFT JOIN nodes n ON f.level < s.height AND n.tree = f.tree AND n.level = f.level AND n.place = xor(f.place, 1)
  LEFT JOIN over o ON f.level >= s.height AND o.level = f.level - s.height AND o.place = xor(f.upper, 1)
  WHERE f.level < s.height + (SELECT max(level) FROM over))
SELECT l.doc_id, l.leaf, s.hash AS subroot, o.hash AS root, sha256(f.siblings) AS proof_sha256, f.own AS folded_root, f.own = o.hash AS verified
FROM folded f JOIN subroots s USING (tree) JOIN leaves l USING (doc_id) JOIN over o ON o.size = 1
WHERE f.level = s.height + (SELECT max(level) FROM over)
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_token_output": op7_token_output,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL = {"op1_url_filter": _OP1_SQL, "op4_warc": _OP4_SQL, "op11_hard_negatives": _OP11_SQL, "op12_merkle_manifest": _OP12_SQL}
