"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import (
    bpe, compression, conversations, decontaminate, extraction, interaction, language, ppm, quality, sharding, simhash, suffixes, toxicity,
)
from galeframe.llm.common import fold, size_of, table

SHARDS = 8


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), tokenizer_path())


def _held_out(of: int, rest: int):
    """Whether a document is held out; a row without an id never is."""
    return F.coalesce(fold("doc_id", of) == rest, F.lit(False))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), ~_held_out(5, 0))
    return quality.score(docs, model).select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, folder, "documents"))


def op4_ppm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return ppm.scores(docs, ~_held_out(7, 2)).select(
        "doc_id", _held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        (size_of(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        sharding.rendezvous(F.col("doc_id"), dict.fromkeys(range(SHARDS), 1.0)).alias("shard"),
        sharding.rendezvous(F.col("doc_id"), dict.fromkeys(range(SHARDS + 1), 1.0)).alias("grown_shard"),
    )
    return sharding.numbered(rows, "shard", "doc_id")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs, ~_held_out(4, 2)))
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "languages", "shares")


def op7_compression(spark: SparkSession, folder: str) -> DataFrame:
    return compression.compression_rules(table(spark, folder, "documents"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~_held_out(4, 2))
    return toxicity.score(docs, model).select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = extraction.extract(pages, extraction.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    repaired = conversations.repair(conversations.damage(turns), turns)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return conversations.digests(repaired).select(
        F.col("id").alias("conv_id"), *[F.col("counts")[k].alias(c) for k, c in enumerate(counts)],
        "audit", F.col("sha").alias("repaired_sha256"),
    )


def op13_interaction(spark: SparkSession, folder: str) -> DataFrame:
    return interaction.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _crc_sql() -> str:
    """Common tables that end in ``crc(t)``, the table of CRC-32 from its polynomial."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""steps(b, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, {step} FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8
)"""


def _op5_sql() -> str:
    """Rendezvous scores, slots and CRC-32 (its table from the polynomial) in DuckDB."""
    score = "-1.0 / ln((('0x' || substr(md5(k || ':{0}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    scored = ", ".join(f"{score.format(s)} AS s{s}" for s in range(SHARDS + 1))

    def best(n):
        top = f"greatest({', '.join(f's{s}' for s in range(n))})"
        return "CASE " + " ".join(f"WHEN s{s} = {top} THEN {s}" for s in reversed(range(n))) + " END"

    return f"""
WITH RECURSIVE {_crc_sql()}, keyed AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS x FROM documents
), hexed AS (
  SELECT doc_id, k, octet_length(encode(x)) + 1 AS size, hex(encode(x)) AS h FROM keyed
), scored AS (
  SELECT doc_id, k, size,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1]))) AS text_crc32,
    {scored}
  FROM hexed, crc
), placed AS (
  SELECT doc_id, k, size::BIGINT AS size, text_crc32, {best(SHARDS)} AS shard, {best(SHARDS + 1)} AS grown_shard FROM scored
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot
FROM placed"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ppm": op4_ppm,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_compression": op7_compression,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_extraction": op11_extraction,
    "op12_conversations": op12_conversations,
    "op13_interaction": op13_interaction,
}

ORACLE_SQL = {
    "op5_sharding": _op5_sql(),
    "op9_decontamination": decontaminate.oracle_sql(),
    "op12_conversations": conversations.oracle_sql(_crc_sql()),
    "op13_interaction": interaction.oracle_sql(),
}
