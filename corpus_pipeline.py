"""The corpus pipeline: stages over ``documents``, each an operator of ``galeframe.llm``.

Every stage takes what its predecessor kept, and all but the last return the columns it was given.
Documents without an id pass the stages that tell documents apart by id unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import bpe, decontaminate, simhash, suffixes, toxicity
from galeframe.llm.common import fold, small_batches, table
from galeframe.llm.queries import tokenizer_path
from galeframe.session import durable

#: Probability of toxicity from which a document is rejected.
TOXIC = 0.3
#: Words in a generation of the encoder's memo: the stages before leave less memory than a query has.
MEMO = 80_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity classifier, fitted on these documents' labels, finds toxic."""
    train = F.coalesce(fold("doc_id", 4) != 2, F.lit(True))
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), train), TOXIC)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id is not among those ``gone``, which are broadcast if they are few."""
    return docs.join(decontaminate.small(durable(gone, narrow=True)), "doc_id", "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of SimHash near-duplicates (three-word shingles, two bits) the one of smallest id.

    Rows of one id with the same text count as one document; of them the first stays. An id with
    several texts goes if each of them has a smaller id in its group.
    """
    found = simhash.near_duplicates(docs).filter("doc_id IS NOT NULL")
    copies = found.groupBy("doc_id").agg(F.bool_and(F.col("component") != F.col("doc_id")).alias("copy"))
    kept = _without(docs, copies.filter("copy").select("doc_id"))
    again = durable(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"), narrow=True)
    if not again.limit(1).count():
        return kept
    several = decontaminate.small(again.select("doc_id"))
    once = kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(several, "doc_id", "left_anti").unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings that a document of smaller id holds; documents of which no word is left go."""
    names = {c: f"given_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    given = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    cut = suffixes.deduplicate(given, texts=True, carry=tuple(names.values()))
    left = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), **{c: F.col(n) for c, n in names.items()}}
    if "n_chars" in columns:
        changed = F.col("n_removed") > 0
        columns["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(columns["n_chars"])
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of the benchmark, also with other parameters."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path(), words=MEMO).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: Several stages have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage in turn to ``documents``, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
