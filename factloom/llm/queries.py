"""The op queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import audio, clusters, html_extract, huffman, licenses, mixing, packing, phrases, pieces, quality, simhash, substring, token_counts
from factloom.llm.common import read_table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.stored_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixtures hold no media, so each vector of `embeddings` is heard as a melody (audio.tone_row).

    One row per pair of a query, whose id 20 divides, and a recording that aligns with it.
    """
    prints = audio.audio_fingerprints(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.tone_row)
    return audio.find_recordings(prints)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coded_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.centroid_clusters(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


OP9_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM weighed),
free AS (SELECT *, (SELECT arg_min(level, place) FROM levels WHERE cap > level * weight) AS free_level FROM levels),
targets AS (SELECT source, source_size, round(least(cap, coalesce(free_level * weight, cap)), 6) AS target FROM free),
plan AS (
  SELECT d.doc_id, d.source, d.digest, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         t.target - whole * t.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto,
         rest > 0 AND upto + d.size <= rest AS extra
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
gaps AS (SELECT source, any_value(rest) - sum(CASE WHEN extra THEN size ELSE 0 END) AS free FROM plan WHERE rest > 0 GROUP BY source),
lengths AS (SELECT source, size, count(*) AS docs FROM plan WHERE rest > 0 AND size > 0 AND NOT extra GROUP BY source, size),
-- the longest length that still fits, as many as there are or fit, then the next shorter one
fill(source, size, free, take) AS (
  SELECT source, CAST(9223372036854775807 AS BIGINT), CAST(free AS DOUBLE), CAST(0 AS BIGINT) FROM gaps
  UNION ALL
  SELECT f.source, max(l.size), any_value(f.free) - max(l.size) * least(arg_max(l.docs, l.size), CAST(floor(any_value(f.free) / max(l.size)) AS BIGINT)),
         least(arg_max(l.docs, l.size), CAST(floor(any_value(f.free) / max(l.size)) AS BIGINT))
  FROM fill f JOIN lengths l ON f.source IS NOT DISTINCT FROM l.source AND l.size < f.size AND l.size <= f.free GROUP BY f.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, size, extra ORDER BY digest) AS place FROM plan)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * least(r.whole + CASE WHEN r.extra OR r.place <= coalesce(f.take, 0) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM ranked r LEFT JOIN fill f ON r.source IS NOT DISTINCT FROM f.source AND r.size = f.size AND NOT r.extra
"""


def queries() -> dict:
    return {
        "op1_html": op1_html, "op2_substring": op2_substring, "op3_pack": op3_pack, "op4_huffman": op4_huffman, "op6_token_counts": op6_token_counts, "op5_simhash": op5_simhash,
        "op7_audio": op7_audio, "op8_licenses": op8_licenses, "op9_mix": op9_mix, "op10_quality": op10_quality, "op11_phrases": op11_phrases, "op12_pieces": op12_pieces, "op13_clusters": op13_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_licenses": licenses.oracle(), "op9_mix": OP9_SQL, "op11_phrases": phrases.oracle(), "op13_clusters": clusters.oracle()}
