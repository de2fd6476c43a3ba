"""Registered queries of the llm operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import confusables, matching, mixing, mojibake, tokens
from touchline.session import cut, read

NAME_TABLES = ("sb_player_match", "fotmob_wc2026")


def _names(spark: SparkSession, d: str) -> DataFrame:
    parts = [read(spark, d, t).select(F.lit(t).alias("source_table"), "row_id", "player") for t in NAME_TABLES]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.inconsistent(_names(spark, d), "player").select("source_table", "row_id")


def p1_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name in its consistent form."""
    rows = _names(spark, d)
    return rows.select("source_table", "row_id", confusables.consistent_column(F.col("player")).alias("player"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_people(read(spark, d, "combined_player_match")).filter("matched").select("player_id_a", "player_id_b")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_people(read(spark, d, "combined_player_match"))


def p4_calibration(spark: SparkSession, d: str) -> DataFrame:
    return matching.calibration(read(spark, d, "combined_player_match"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixed(spark, d), read(spark, d, "mix_targets"))


def p7_marginals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.marginals(_mixed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(read(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_documents(read(spark, d, "documents"))


def p8_mappings(spark: SparkSession, d: str) -> DataFrame:
    words = cut(mojibake.words_of(read(spark, d, "documents")))
    return mojibake.mappings(*mojibake.learn(words, cut(mojibake.vocabulary(words))))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (p1_found, p1_names, p4_found, p4_matches, p4_calibration, p6_ids, p7_mix, p7_shares, p7_marginals, p8_found, p8_restored, p8_mappings)
    }


#: Precomposed letters of one script, ordinary width, plain separators: what DuckDB can say about it.
_P1 = """
SELECT '{t}' AS source_table, row_id FROM {t} WHERE player IS NOT NULL AND (
  player <> nfc_normalize(player) OR player <> trim(player) OR contains(player, '  ')
  OR regexp_matches(player, '[\\x{{00A0}}\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{2000}}-\\x{{200F}}\\x{{2010}}-\\x{{2015}}\\x{{2018}}\\x{{2019}}\\x{{2028}}-\\x{{202F}}\\x{{205F}}-\\x{{206F}}\\x{{3000}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}\\x{{FF00}}-\\x{{FFEF}}\\x{{FB00}}-\\x{{FB06}}\\x{{0132}}\\x{{0133}}\\x{{01C4}}-\\x{{01CC}}\\x{{01F1}}-\\x{{01F3}}\\x{{212A}}\\x{{212B}}]')
  OR (regexp_matches(player, '\\p{{Latin}}') AND regexp_matches(player, '[\\p{{Greek}}\\p{{Cyrillic}}]'))
  OR (regexp_matches(player, '\\p{{Greek}}') AND regexp_matches(player, '\\p{{Cyrillic}}')))
"""


def oracle() -> dict[str, str]:
    return {"p1_found": " UNION ALL ".join(_P1.format(t=t) for t in NAME_TABLES)}
