"""Queries p1, p4, p6, p7 and p8 over the domain tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import forest, language, mixing, ribbon, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.found(table(spark, d, "index_entries"))


def p1_repeats(spark: SparkSession, d: str) -> DataFrame:
    return forest.repeats(table(spark, d, "index_entries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ribbon.known_puts(table(spark, d, "chunk_puts"), table(spark, d, "base_chunks"))


def p4_audit(spark: SparkSession, d: str) -> DataFrame:
    return ribbon.audit(table(spark, d, "chunk_puts"), table(spark, d, "base_chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(language.document_languages(table(spark, d, "documents")))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(table(spark, d, "documents"))


def p8_reliability(spark: SparkSession, d: str) -> DataFrame:
    return language.reliability(p8_segments(spark, d))


def _sql_hash(column: str) -> str:
    plain = f"lower(regexp_replace({column}, '[\\s\\p{{Z}}/]+', '', 'g'))"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{64}}') AND {plain} <> repeat('0', 64) THEN {plain} END"


_P4 = f"""WITH puts AS (SELECT DISTINCT put_id, {_sql_hash("hash")} AS h FROM chunk_puts),
firsts AS (SELECT h, min(put_id) AS first_id FROM puts WHERE h IS NOT NULL GROUP BY h)
SELECT DISTINCT put_id FROM puts JOIN firsts USING (h)
WHERE put_id > first_id OR h IN (SELECT {_sql_hash("hash")} FROM base_chunks)"""

QUERIES = {"p1_found": p1_found, "p1_repeats": p1_repeats, "p4_found": p4_found, "p4_audit": p4_audit, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_segments": p8_segments, "p8_reliability": p8_reliability}
SQL = {"p4_found": _P4}
