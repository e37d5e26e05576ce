"""The queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, flac, html, langid, licences, lines, manifest, mixing, pieces, quality, secrets, simhash, whitening
from flowlens.llm.common import cut, table


def tokenizer(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.learn())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    family = F.transform("licences", lambda x: x["family"])
    return found.select("doc_id", "n_windows", F.size("licences").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(family)), ",").alias("families"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '/', md5(coalesce(text, '')))) AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM sizes),
weighed AS (SELECT *, (r - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed),
fixed AS (SELECT arg_min(level, {'a': cap / w, 'r': r}) AS level FROM levels WHERE level * w <= cap),
aims AS (SELECT source, source_size, r, least(CAST(cap AS DOUBLE), fixed.level * w) AS target FROM levels, fixed),
placed AS (
  SELECT rows.*, source_size, target, r, CAST(floor(target) AS BIGINT) AS aim,
         CAST(sum(size) OVER (PARTITION BY rows.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS place, row_number() OVER () AS id
  FROM rows JOIN aims ON rows.source IS NOT DISTINCT FROM aims.source),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS n, CAST(ceil(sum(source_size) / 1024) AS BIGINT) AS slots FROM aims),
shares AS (SELECT r, target, sum(target / n) OVER (ORDER BY r) AS hi FROM aims, total WHERE n > 0),
ends AS (SELECT r, coalesce(lag(hi) OVER (ORDER BY r), 0.0) AS lo, CASE WHEN r = max(CASE WHEN target > 0 THEN r END) OVER () THEN 2.0 ELSE hi END AS hi FROM shares),
points AS (SELECT i AS slot, (i + 1) * 0.6180339887498949::DOUBLE - floor((i + 1) * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(0, slots)) AS i FROM total)),
drawn AS (SELECT r, slot, row_number() OVER (PARTITION BY r ORDER BY slot) - 1 AS number FROM points JOIN ends ON u >= lo AND u < hi),
needs AS (SELECT r, unnest(range(0, CAST(ceil(floor(target) / 1024) AS BIGINT))) AS number FROM aims),
slotted AS (SELECT r, number, coalesce(slot, slots) AS slot FROM needs LEFT JOIN drawn USING (r, number), total),
spans AS (SELECT id, r, place + e * source_size AS a, least(place + e * source_size + size, aim) AS z FROM placed, range(0, 3) t(e) WHERE size > 0),
cuts AS (SELECT id, r, a, z, unnest(range(a // 1024, (z - 1) // 1024 + 1)) AS number FROM spans WHERE a < z),
took AS (SELECT id, CAST(sum(least(z, (number + 1) * 1024) - greatest(a, number * 1024)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM cuts JOIN slotted USING (r, number) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM placed LEFT JOIN took USING (id)
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, *langid.learn(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(cut(flac.recorded(table(spark, sf_dir, "documents")), "zstd"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents")).drop("source", "path")


OP12_SQL = r"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS id, *, list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen(CAST(doc_id AS VARCHAR)))),
    lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) // 2,
      CASE WHEN xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)) AS crc FROM documents),
parts AS (SELECT id, doc_id, source, crc, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM rows),
hashed AS (SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS idx, coalesce('1' || source, '0') AS tree FROM hashed),
lists AS (SELECT tree, 0 AS level, list(leaf ORDER BY idx) AS l FROM placed GROUP BY tree
  UNION ALL SELECT tree, level + 1, list_transform(range(0, (len(l) + 2) // 3), lambda i: sha256(array_to_string(l[3 * i + 1:3 * i + 3], ''))) FROM lists WHERE len(l) > 1),
subs AS (SELECT tree, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM lists WHERE len(l) = 1),
tops AS (SELECT 0 AS level, list(subroot ORDER BY place) AS l FROM subs
  UNION ALL SELECT level + 1, list_transform(range(0, (len(l) + 2) // 3), lambda i: sha256(array_to_string(l[3 * i + 1:3 * i + 3], ''))) FROM tops WHERE len(l) > 1),
roots AS (SELECT l[1] AS root FROM tops WHERE len(l) = 1),
steps AS (SELECT id, 0 AS part, level, l, CAST(floor(idx / pow(3, level)) AS BIGINT) AS j FROM placed JOIN lists USING (tree) WHERE len(l) > 1
  UNION ALL SELECT id, 1, level, l, CAST(floor(place / pow(3, level)) AS BIGINT) FROM placed JOIN subs USING (tree), tops WHERE len(l) > 1),
sides AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, level) AS step, array_to_string(l[j - j % 3 + 1:j], '') AS a, array_to_string(l[j + 2:j - j % 3 + 3], '') AS b FROM steps),
proofs AS (SELECT id, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM sides GROUP BY id),
folded AS (SELECT id, 0 AS step, coalesce(tampered, leaf) AS h FROM placed UNION ALL SELECT f.id, f.step + 1, sha256(a || h || b) FROM folded f JOIN sides s ON s.id = f.id AND s.step = f.step + 1),
ends AS (SELECT id, arg_max(h, step) AS h FROM folded GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN subs USING (tree) LEFT JOIN proofs USING (id) JOIN ends USING (id), roots
"""


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.score(docs, lines.learn(docs, table(spark, sf_dir, "labels"))).select("doc_id", lines.held_out().alias("held_out"), F.col("judged.score").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash_near_dup": op4_simhash_near_dup,
    "op5_licence_scan": op5_licence_scan,
    "op6_mixing": op6_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_flac": op10_flac,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op12_merkle_manifest": OP12_SQL}
