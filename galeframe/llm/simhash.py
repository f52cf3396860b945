"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits of each other are found without comparing all: the bits are
split into groups of bits that vary together; two fingerprints that near agree in at least one
group up to that group's threshold, if the thresholds sum to ``radius - groups + 1``. Thresholds
are dealt by dynamic programming on the candidates each is estimated to bring. Every fingerprint
probes the group values within the threshold, and candidates are verified on all bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, pieces
from galeframe.llm.components import components
from galeframe.session import durable

SEED = 42
#: Values held by more fingerprints than this are linked through shared neighbours, not pair by pair.
CROWD = 64
#: Numbers of groups that are weighed against each other.
SPLITS = (2, 3, 4)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words are one shingle, no word none."""
    words = text.encode().lower().split()  # both touch ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(width, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> bytes:
    """The 64 bits set in over half of the hashes, bit 0 first; all zeros for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # 255 rows fit the sums of single bytes
        flat = np.unpackbits(h[at : at + 255, None].view(np.uint8), axis=1, bitorder="little")
        counts += flat.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key`` and the 64-bit fingerprint of every whole text, as a signed long; NULL counts as empty."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in pieces(batches):
            raw = b"".join(majority(shingle_hashes(t or "", shingle)) for t in column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(np.frombuffer(raw, np.int64))], [key, "fp"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, fp long")


def _correlations(prints: DataFrame) -> np.ndarray:
    """Absolute correlations of the 64 bits over all fingerprints, from sums made in every task."""

    def sums(batches):
        both, ones, n = np.zeros((64, 64)), np.zeros(64), 0
        for batch in batches:
            v = np.ascontiguousarray(column(batch, "fp").to_numpy())
            x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            ones += x.sum(axis=0)
            n += len(x)
        flat = np.concatenate([both.ravel(), ones, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    got = prints.select("fp").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(64 * 64 + 65)
    for row in got:
        flat[row["i"]] = row["v"]
    n = max(1.0, flat[-1])
    mean = flat[4096:4160] / n
    cov = flat[:4096].reshape(64, 64) / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(dev, dev))


def grouped_bits(corr: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` groups of like size; each grows by the bit most correlated with it."""
    free, out = set(range(len(corr))), []
    for g in range(groups):
        size = len(free) // (groups - g)
        first = max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())
        own = [first]
        free.remove(first)
        while len(own) < size:
            best = max(sorted(free), key=lambda b: corr[b, own].sum())
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def ball(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1)) if t >= 0 else 0


def dealt_thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one per group and with the given sum, of least summed cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in options.items():
                if s + t not in new or cost + c < new[s + t][0]:
                    new[s + t] = (cost + c, [*chosen, t])
        best = new
    return best[total]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def plan(prints: DataFrame, radius: int) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each group that is probed, for the cheapest split.

    The cost of a threshold is the number of probes plus the candidates expected from them: the
    pairs that agree in the group, counted over all fingerprints, times the values in reach.
    """
    corr = _correlations(prints)
    n = prints.count()
    splits = {m: grouped_bits(corr, m) for m in SPLITS}
    masks = {(m, g): _signed(sum(1 << b for b in bits)) for m, groups in splits.items() for g, bits in enumerate(groups)}
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(g).alias("g"), F.lit(mask).alias("mask")) for (m, g), mask in masks.items()])
    values = prints.select("fp", F.explode(keys).alias("k")).select("k.m", "k.g", F.col("fp").bitwiseAND(F.col("k.mask")).alias("value"))
    agree = {
        (r["m"], r["g"]): r["pairs"]
        for r in values.groupBy("m", "g", "value").agg(F.count("*").cast("double").alias("n"))
        .groupBy("m", "g").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()
    }
    best = None
    for m, groups in splits.items():
        costs = []
        for g, bits in enumerate(groups):
            costs.append({t: ball(len(bits), t) * (n + agree.get((m, g), 0.0)) if t >= 0 else 0.0 for t in range(-1, radius + 1)})
        cost, chosen = dealt_thresholds(costs, radius - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(masks[m, g], bits, t) for g, (bits, t) in enumerate(zip(groups, chosen)) if t >= 0])
    return best[1]


def _flips(bits, most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose closure joins all within ``radius`` bits.

    A group value with over CROWD fingerprints is not paired out. Its fingerprints, and those that
    probe it, name all values within radius / 2 bits of themselves: two of them are within
    ``radius`` exactly if they share one, and all that share one are linked to the least of them.
    The work is in proportion to the fingerprints, however many are alike. ``radius`` is even.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius is an even number of bits")
    prints = prints.select("fp")
    found = None
    probing = plan(prints, radius)
    keys = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(mask).alias("mask")) for g, (mask, _, _) in enumerate(probing)])
    index = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.g", F.col("fp").bitwiseAND(F.col("k.mask")).alias("value"))
    index = durable(index, narrow=True)
    probes = None
    for g, (mask, bits, t) in enumerate(probing):
        flips = F.array(*[F.lit(x) for x in _flips(bits, t)])
        own = prints.select("fp", F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v"), F.explode(flips).alias("x"))
        own = own.select("fp", "g", F.col("v").bitwiseXOR(F.col("x")).alias("value"))
        probes = own if probes is None else probes.unionByName(own)
    crowded = durable(index.groupBy("g", "value").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("g", "value"), narrow=True)
    calm = index.join(crowded, ["g", "value"], "left_anti")
    pairs = calm.withColumnRenamed("fp", "a").join(probes.withColumnRenamed("fp", "b"), ["g", "value"]).filter("a < b")
    found = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    near = F.array(*[F.lit(x) for x in _flips(range(64), radius // 2)])
    members = probes.join(crowded, ["g", "value"], "left_semi").select("fp").distinct()
    reach = members.select("fp", F.explode(near).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("at"))
    least = reach.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("at", "a")
    stars = reach.join(least, "at").filter("a < fp").select("a", F.col("fp").alias("b"))
    return found.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per document row: ``key``, ``fp`` and ``component``, the smallest key reachable over links.

    Equal fingerprints are one; links join fingerprints that differ in ``radius`` bits or fewer.
    Rows without a key take part and get the smallest key of their component; it is NULL if no
    member has one. Repeated rows are copies of one another.
    """
    own = durable(fingerprints(docs, key, text, shingle))
    prints = durable(own.groupBy("fp").agg(F.min(key).alias("least")), narrow=True)
    joined = components(links(prints, radius), "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = prints.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = durable(
        rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component"),
        narrow=True,
    )
    return own.join(classes, "fp").select(key, "fp", "component")
