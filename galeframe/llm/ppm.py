"""Code lengths by prediction by partial matching, over the bytes of words joined by one blank.

A trie of byte contexts is counted over all training documents. A byte is predicted in its longest
context that training has seen; a context that never saw the byte escapes to the next shorter one,
with the probability that a part of a count of each of its symbols makes up, and the symbols it did
see are excluded there. A text ends with an end symbol in place of a byte, so the probabilities of all
texts sum to one.

The trie is never gathered. It is dealt by the last two bytes of the contexts: all contexts of two
bytes or more that one prediction passes through meet in one part. Documents are dealt to buckets;
a bucket asks for the distinct grams its texts hold, is sent their log probabilities, and sums them
by document. Word counts for the base model go the same way.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import size_of
from galeframe.llm.suffixes import _by_part, _pack, _pack_sorted, _table, _unpack, _unpack_sorted

#: Length of the longest contexts, and the part of every symbol's first count that goes to its escape.
ORDER, ESCAPE = 5, 0.3
#: Ends a text and stands for what is before it; no UTF-8 text holds this byte.
END = 0xFF
BUCKET_BYTES, PART_BYTES = 6 << 20, 12 << 20
#: Buckets whose questions are merged first.
MERGED = 256
GRAMS, WORDS, PAIRS = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # both touch ASCII alone


def grams_of(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every byte and end, where each text starts among them)."""
    pad, end = bytes([END]) * order, bytes([END])
    parts = [b" ".join(w) for w in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    raw = np.frombuffer(b"".join([x for p in parts for x in (pad, p, end)]), np.uint8)
    starts = np.cumsum(sizes) - sizes
    if not len(parts):
        return np.zeros(0, np.uint64), starts
    n = len(raw) - order
    full = np.zeros(n, np.uint64)
    for k in range(order + 1):
        full <<= np.uint64(8)
        full |= raw[k : k + n]
    keep = np.ones(n, bool)  # all but the grams that end in a later text's padding
    for i in range(1, len(parts)):
        at = int(starts[i]) + i * order
        keep[at - order : at] = False
    return full[keep], starts


def word_ids(words) -> np.ndarray:
    """64-bit identifiers; the end token is the empty word."""
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[head], (np.add.reduceat(n[order], head) if len(k) else n)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each wanted key, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _looked_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, all of which are there, by a hash table that colliding keys fall out of."""
    bits = max(10, (4 * len(keys)).bit_length())
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    slots = np.zeros(1 << bits, np.int32)
    slots[(keys * mix) >> shift] = np.arange(len(keys), dtype=np.int32)
    at = slots[(wanted * mix) >> shift]
    lost = np.flatnonzero(keys[at] != wanted)
    at[lost] = np.searchsorted(keys, wanted[lost])
    return at


class Level:
    """The contexts of one length: their symbols and counts, totals, and numbers of symbols."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        context = grams >> np.uint64(8)
        head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.zeros(0, np.int64)
        self.contexts = context[head]
        self.totals = np.add.reduceat(counts, head) if len(grams) else counts
        self.symbols = np.diff(np.append(head, len(grams)))
        self.head = head

    def shared_with(self, shorter: Level) -> np.ndarray:
        """Per context, the count in the shorter context of all symbols seen here."""
        if not len(self.grams):
            return self.totals
        at, _ = _at(shorter.grams, self.grams & shorter.mask)
        return np.add.reduceat(shorter.counts[at], self.head)


def levels(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> list[Level]:
    """Levels 0 to ``order``. grams: sorted, of the longest contexts; pairs: 256 x 256 counts of all bytes."""
    out: list[Level] = []
    zero = pairs.sum(axis=0)
    some = np.flatnonzero(zero)
    out.append(Level(some.astype(np.uint64), zero[some]))
    flat = pairs.ravel()
    some = np.flatnonzero(flat)
    out.append(Level(some.astype(np.uint64), flat[some]))
    for k in range(2, order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        out.append(Level(*_summed(grams & mask, counts)))
    for k, level in enumerate(out):
        level.mask = np.uint64((1 << 8 * (k + 1)) - 1)
    return out


def log_probabilities(wanted: np.ndarray, trie: list[Level]) -> np.ndarray:
    """Natural logarithms of the probability of each gram's symbol after its context."""
    out = np.zeros(len(wanted))
    open_ = np.ones(len(wanted), bool)
    order = len(trie) - 1
    above = np.zeros(len(wanted), bool)  # a longer context was seen
    gone_n = np.zeros(len(wanted))
    gone_d = np.zeros(len(wanted))
    for k in range(order, -1, -1):
        level = trie[k]
        gram = wanted & level.mask
        c, seen = _at(level.contexts, gram >> np.uint64(8))
        g, known = _at(level.grams, gram)
        if not len(level.contexts):
            continue
        total = level.totals[c] - gone_n
        symbols = level.symbols[c] - gone_d
        live = open_ & seen & (total > 0)
        hit = live & known
        out[hit] += np.log((level.counts[g[hit]] - ESCAPE) / total[hit])
        miss = live & ~known
        out[miss] += np.log(ESCAPE * symbols[miss] / total[miss])
        open_ &= ~hit
        if k:
            shorter = level.shared_with(trie[k - 1])
            gone_n = np.where(seen, shorter[c], gone_n * above)
            gone_d = np.where(seen, level.symbols[c], gone_d * above)
            above |= seen
    out[open_] -= np.log(max(1, 256 - len(trie[0].grams)))
    return out


def scores(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER
) -> DataFrame:
    """Scores all whole texts by a trie and word counts of those for which ``train`` holds.

    One row per document row: ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``, log10 probabilities. Only A-Z are lower-cased; NULL counts as empty, whose score is
    that of the end alone. Rows without an id take part like others. Without training documents
    every byte costs the same, 1 / 256.
    """
    total = docs.agg(F.sum(size_of(docs[text]))).first()[0] or 0
    buckets, parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // PART_BYTES))
    kind = dict(docs.dtypes)[key]
    dealt = docs.select(docs[key].alias("id"), docs[text].alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int"))

    def asks(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        words = [words_of(t) for t in group.column("text").to_pylist()]
        train_ = group.column("train").to_pylist()
        full, starts = grams_of(words, order)
        flags = np.repeat(np.array(train_, np.uint64), np.diff(np.append(starts, len(full))))
        sorted_ = np.sort((full << np.uint64(1)) | flags)
        head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        n = np.diff(np.append(head, len(sorted_)))
        keys, n = _summed(sorted_[head] >> np.uint64(1), n * (sorted_[head] & np.uint64(1)).astype(np.int64))
        rows = []
        home = _home(keys)
        for part, i in _by_part(home, parts):
            i = np.sort(i)
            rows.append((GRAMS, part, bucket // MERGED, bucket, _pack_sorted(keys[i]), _pack(n[i])))
        pairs = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), n, 65536).astype(np.int64)
        rows.append((PAIRS, 0, bucket // MERGED, bucket, b"", _pack(pairs)))
        seen, known = Counter(), Counter()
        for w, t in zip(words, train_):
            (known if t else seen).update(w)
            (known if t else seen)[b""] += 1
        names = list(known) + [w for w in seen if w not in known]
        ids = word_ids(names)
        counts = np.array([known[w] for w in names], np.int64)
        ids, counts = _summed(ids, counts)
        for part, i in _by_part(ids, parts):
            rows.append((WORDS, part, bucket // MERGED, bucket, _pack_sorted(ids[i]), _pack(counts[i])))
        kinds = [*[pa.int32()] * 4, pa.binary(), pa.binary()]
        return _table(rows, ["kind", "part", "salt", "bucket", "keys", "n"], kinds)

    def merged(group: pa.Table) -> pa.Table:
        kind_, part, salt = (group.column(c)[0].as_py() for c in ("kind", "part", "salt"))
        n = [_unpack(b, np.int64) for b in group.column("n").to_pylist()]
        if kind_ == PAIRS:
            keys, n = b"", np.sum(n, axis=0)
        else:
            keys, n = _summed(np.concatenate([_unpack_sorted(b) for b in group.column("keys").to_pylist()]), np.concatenate(n))
            keys = _pack_sorted(keys)
        names = ["kind", "part", "salt", "keys", "n"]
        return _table([(kind_, part, salt, keys, _pack(n))], names, [*[pa.int32()] * 3, pa.binary(), pa.binary()])

    def priced(group: pa.Table) -> pa.Table:
        kind_, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        own = [_unpack_sorted(b) for b in group.column("keys").to_pylist()]
        n = np.concatenate([_unpack(b, np.int64) for b in group.column("n").to_pylist()])
        keys, n = _summed(np.concatenate(own), n)
        if kind_ == GRAMS:
            pairs = _unpack(group.column("pairs")[0].as_py(), np.int64).reshape(256, 256)
            value = log_probabilities(keys, levels(keys[n > 0], n[n > 0], pairs, order)).astype(np.float32)
        else:
            value = n
        rows = []
        for salt, k in zip(group.column("salt").to_pylist(), own):
            at, _ = _at(keys, k)
            rows.append((kind_, part, salt, _pack_sorted(k), _pack(value[at])))
        names = ["kind", "part", "salt", "keys", "value"]
        return _table(rows, names, [*[pa.int32()] * 3, pa.binary(), pa.binary()])

    def answered(group: pa.Table, prices: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows and prices.num_rows:
            kind_ = group.column("kind")[0].as_py()
            keys = _unpack_sorted(prices.column("keys")[0].as_py())
            value = _unpack(prices.column("value")[0].as_py(), np.float32 if kind_ == GRAMS else np.int64)
            for bucket, b in zip(group.column("bucket").to_pylist(), group.column("keys").to_pylist()):
                at, _ = _at(keys, _unpack_sorted(b))
                rows.append((kind_, bucket, b, _pack(value[at])))
        return _table(rows, ["kind", "bucket", "keys", "value"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def told(replies: pa.Table, kind_: int, number) -> tuple[np.ndarray, np.ndarray]:
        rows = [
            (_unpack_sorted(k), _unpack(v, number))
            for c, k, v in zip(*(replies.column(x).to_pylist() for x in ("kind", "keys", "value"))) if c == kind_
        ]
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(0, number)
        keys, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        at = np.argsort(keys)
        return keys[at], value[at]

    def summed(group: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows:
            words = [words_of(t) for t in group.column("text").to_pylist()]
            keys, value = told(replies, GRAMS, np.float32)
            full, starts = grams_of(words, order)
            model = np.add.reduceat(value[_looked_up(keys, full)], starts, dtype=np.float64) / np.log(10)
            ids, counts = told(replies, WORDS, np.int64)
            names = list({w for own in words for w in own} | {b""})
            at, _ = _at(ids, word_ids(names))
            count = dict(zip(names, counts[at].tolist()))
            size = np.array([len(own) + 1 for own in words])
            tokens = chain.from_iterable(chain(own, (b"",)) for own in words)
            c = np.fromiter(map(count.__getitem__, tokens), np.int64, int(size.sum()))
            head = np.cumsum(size) - size
            known, logs = np.add.reduceat((c > 0).astype(np.int64), head), np.add.reduceat(np.log10(c + 1), head)
            rows = list(zip(group.column("id").to_pylist(), *(x.tolist() for x in (size, known, logs, model))))
        return _table(rows, [key, "n_tokens", "n_known", "logs", "score"], [group.schema.field("id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64()])

    # The texts are shuffled once for both passes, and the questions once for all that follows.
    by_bucket = dealt.groupBy("bucket")
    asked = by_bucket.applyInArrow(asks, "kind int, part int, salt int, bucket int, keys binary, n binary")
    by_salt = asked.groupBy("kind", "part", "salt")
    some = by_salt.applyInArrow(merged, "kind int, part int, salt int, keys binary, n binary")
    trie = some.filter(F.col("kind") != PAIRS)

    def total_pairs(group: pa.Table) -> pa.Table:
        return _table([(_pack(np.sum([_unpack(b, np.int64) for b in group.column("n").to_pylist()], axis=0)),)], ["pairs"], [pa.binary()])

    # One row of 256 x 256 counts, whatever the input.
    pairs = some.filter(F.col("kind") == PAIRS).groupBy("part").applyInArrow(total_pairs, "pairs binary")
    pairs = pairs.withColumn("every", F.lit(1))
    with_pairs = trie.withColumn("every", F.lit(1)).join(F.broadcast(pairs), "every").drop("every")
    prices = with_pairs.groupBy("kind", "part").applyInArrow(priced, "kind int, part int, salt int, keys binary, value binary")
    answers = by_salt.cogroup(prices.groupBy("kind", "part", "salt")).applyInArrow(
        answered, "kind int, bucket int, keys binary, value binary"
    )
    found = by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(
        summed, f"`{key}` {kind}, n_tokens long, n_known long, logs double, score double"
    )

    def sizes(group: pa.Table) -> pa.Table:
        n = np.concatenate([_unpack(b, np.int64) for b in group.column("n").to_pylist()])
        keys = np.concatenate([_unpack_sorted(b) for b in group.column("keys").to_pylist()])
        _, n = _summed(keys, n)
        return _table([(int(n.sum()), int((n > 0).sum()))], ["tokens", "kinds"], [pa.int64(), pa.int64()])

    counts = some.filter(F.col("kind") == WORDS).groupBy("part").applyInArrow(sizes, "tokens long, kinds long")
    whole = counts.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")
    ).withColumn("every", F.lit(1))
    return (
        found.withColumn("every", F.lit(1)).join(F.broadcast(whole), "every")  # one row
        .withColumn("base_score", F.col("logs") - F.col("n_tokens") * F.log10((F.col("train_tokens") + F.col("kinds") + 1).cast("double")))
        .select(key, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )


def _home(grams: np.ndarray) -> np.ndarray:
    """Mixes the last two context bytes, so that all contexts that end with them have one home."""
    z = ((grams >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(32))
