"""Audit of how filters interact: what each removes in every order, and what it alone would.

A filter that asks for an earlier copy is an existential self-join: a left-semi join on hash, exact
text and smaller id. Its rows are united with the failures of the filters that a text decides for
itself; per document they make one combination of bits. Combinations are counted, and all orders
are read off the counts, so the audit costs one pass whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, pieces
from galeframe.session import durable

#: The filters: under 200 words, few distinct words, many capitals, a symbol, an earlier copy.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS, SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
#: Up to this many hashes held by several ids are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1 << 20
#: Rows of one hash that one task joins; a hash of more rows is split over several.
SPLIT = 1 << 16


def own_failures(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # at ASCII white space, as the words are defined
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * capitals > 2 * len(text),
        len(raw.translate(None, SYMBOLS)) < len(raw),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def earlier_copies(rows: DataFrame) -> DataFrame:
    """The (id, part, h, size) of ``rows`` whose text a row of smaller id holds; NULL ids neither have nor are copies."""
    known = rows.filter("id IS NOT NULL")
    crowds = known.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))
    crowds = durable(crowds.filter("least < most").select("h", F.ceil(F.col("n") / SPLIT).cast("int").alias("splits")))
    if crowds.count() <= BROADCAST_ROWS:
        crowds = F.broadcast(crowds)
    held = known.join(crowds, "h")
    firsts = held.groupBy("h", "text").agg(F.min("id").alias("least"), F.max("splits").alias("splits"))
    firsts = firsts.select("h", "text", "least", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    later = held.withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int"))
    on = [later[c] == firsts[c] for c in ("h", "split", "text")] + [firsts["least"] < later["id"]]
    return later.join(firsts, on, "left_semi").select("id", "part", "h", "size")


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, n, mask): per id, part and text the number of rows and the bits of the filters failed.

    NULL texts count as empty, a NULL part as the empty string; repeated rows count each.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(
        docs[key].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text")).withColumn("size", F.octet_length("text"))

    def judged(batches):
        for batch in pieces(batches):
            bits = pa.array([own_failures(t) for t in column(batch, "text").to_pylist()], pa.int32())
            kept = [column(batch, c) for c in ("id", "part", "h", "size")]
            yield pa.RecordBatch.from_arrays([*kept, bits], ["id", "part", "h", "size", "mask"])

    own = rows.mapInArrow(judged, f"id {kind}, part string, h long, size int, mask int")
    copies = earlier_copies(rows).withColumn("mask", F.lit(COPY)).withColumn("n", F.lit(0))
    united = own.withColumn("n", F.lit(1)).unionByName(copies)
    return united.groupBy("id", "part", "h", "size").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask")).select("id", "part", "n", "mask")


def combinations(failed: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents per combination of failures, and those so labelled.

    An id with several label rows is good, or toxic, if one of them says so.
    """
    marks = labels.groupBy(labels[key].alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    marked = failed.join(marks, "id", "left")
    lost = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost)


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the ``filters`` and step, from the counts of ``combinations``.

    ``kept`` and ``removed`` are after and in this step, ``redundant`` fails its filter but was
    removed before, ``unique_fails`` fails no other. ``shapley`` sums the removals of the filter over
    all orders: of a document with k failures each is the first in one of k orders.
    """
    orders = " ".join("".join(p) for p in permutations(filters))
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # at most one per combination
    steps = per.select("part", "c", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = f"shiftleft(1, instr('{filters}', {{0}}) - 1)"
    steps = steps.withColumn("own", F.expr(bit.format("substr(filter_order, step, 1)"))).withColumn(
        "before", F.expr(f"aggregate(split(substr(filter_order, 1, step - 1), ''), 0, (a, x) -> if(x = '', a, a | {bit.format('x')}))")
    )

    def total(value, condition):
        return F.expr(f"aggregate(filter(c, x -> {condition}), 0L, (a, x) -> a + {value})")

    removed = "(x.mask & own) <> 0 AND (x.mask & before) = 0"
    every = len(orders.split())
    return steps.select(
        "part", "filter_order", "step",
        total("x.n", "(x.mask & (before | own)) = 0").alias("kept"),
        total("x.n", removed).alias("removed"),
        total("x.n", "(x.mask & own) <> 0 AND (x.mask & before) <> 0").alias("redundant"),
        total("x.n", "x.mask = own").alias("unique_fails"),
        total("x.good", removed).alias("good_lost"),
        total("x.toxic", removed).alias("toxic_lost"),
        total(f"x.n * {every} div bit_count(x.mask)", "(x.mask & own) <> 0").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``interactions`` of the five filters on whole texts; an empty table has no part and no row."""
    return interactions(combinations(failures(docs, key, text, part), labels, key))


def oracle_sql() -> str:
    """The same in DuckDB."""
    word = r"[^\x20\x09-\x0D]+"
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    bit = f"(1 << (instr('{FILTERS}', {{0}}) - 1))"
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS x FROM documents
), firsts AS (SELECT x, min(doc_id) AS least FROM rows GROUP BY x
), worded AS (
  SELECT doc_id, part, x, regexp_extract_all(x, '{word}') AS w FROM rows
), masked AS (
  SELECT worded.doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x))::INT
    + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(least < worded.doc_id, false)::INT AS mask
  FROM worded JOIN firsts USING (x)
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masked LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), orders AS (SELECT unnest([{orders}]) AS filter_order
), steps AS (
  SELECT filter_order, step, {bit.format('substr(filter_order, step, 1)')} AS own,
    list_sum(list_transform(range(1, step), lambda k: {bit.format('substr(filter_order, k, 1)')})) AS prior
  FROM orders, range(1, 6) t(step)
), seen AS (
  SELECT part, filter_order, step, mask, own, coalesce(prior, 0)::BIGINT AS prior, n, good, toxic FROM counts, steps
)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (mask & (prior | own) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & prior = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & prior = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM seen GROUP BY part, filter_order, step"""
