"""Removal of repeated 50-byte strings by bucket-pointer refinement of anchored suffixes.

The suffixes of all documents fall into buckets by their first 16 bytes. Only anchors are
bucketed: of the 35 grams inside a 50-byte string the one of least hash, the first of several.
Equal strings have equal anchors at equal offsets, so no repeat is lost. A bucket that one document
alone holds is settled. The others are refined by what lies at later and earlier offsets: the
strings around an anchor are told apart by their own identifiers, which are made of those of their
parts, and every string learns the least document that holds it.

Refinement doubles: a bucket of 16 bytes at i and that at i + 16 make a bucket of 32 bytes, which
sorting numbers anew; the numbers at i and at i + 18 then make the bucket of the 50 bytes. The
second step reuses what the first one refined, also for offsets at which no string in question
starts, and a string with a bucket of its own takes no further part. Where buckets must have the same name
in several tasks, they are named by mixing the names of their halves in the same two steps.

Documents are dealt to buckets of a few megabytes of text; one shuffle of the texts serves the
three passes over them. Between the passes go packed identifiers: of a bucket to the part that
owns an identifier, and what was found back to the bucket. A gram, string or context that many
documents of a bucket share is sent once with their least id, so the part that owns it receives
one row a bucket at most. Grams of very many documents are refined string by string, which
spreads them over all parts.
"""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, size_of

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1
#: Offset at which the second 32 bytes of a string begin; they overlap the first.
LATE = LENGTH - 2 * GRAM
STRIDE = 1 << 18
#: A part settles its contexts in so many slices, one after the other, by the upper bits of their 48-bit grams.
SLICES = 16
#: Salt of names that only one process uses.
SALT = secrets.randbits(64)
# A string's gram is the least of 35, so the slices hold about as many strings each if cut at quantiles of that least.
_SLICE_BOUNDS = ((1 - (1 - np.arange(SLICES + 1) / SLICES) ** (1 / REACH)) * (1 << 48)).astype(np.uint64)


@dataclass(frozen=True)
class Settings:
    """Bytes of text a bucket and a part are meant for; documents from which a gram counts as crowded."""

    bucket_bytes: int = 6 << 20
    part_bytes: int = 6 << 20
    crowded: int = 5000


def _u64(value: int) -> np.uint64:
    return np.uint64(value)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _u64(27))) * _u64(0x94D049BB133111EB)
    return z ^ (z >> _u64(31))


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, for all but the last 7."""
    return np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Names of the buckets whose halves have these names.

    The salt is drawn anew for every job and mixed into all bits of the first half before the second
    one meets it, so that no texts can be made, nor happen by their pattern, to get one name.
    """
    z = _mixed(a ^ _u64(salt))
    z ^= b
    z *= _u64(0x9E3779B97F4A7C15)
    return _mixed(z ^ (z >> _u64(32)))


def _doubled(raw: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """Names of the 32-byte buckets at each place, of those of 16 bytes there and 16 bytes later."""
    words = _words(raw)
    first = _pair(words[at], words[8:][at], salt)
    return _pair(first, _pair(words[GRAM:][at], words[GRAM + 8 :][at], salt), salt)


def string_ids(raw: np.ndarray, at: np.ndarray, salt: int = SALT) -> np.ndarray:
    """Names of the 50-byte strings that start at each place, of those of 32 bytes there and 18 bytes later."""
    return _pair(_doubled(raw, at, salt), _doubled(raw, at + LATE, salt), salt)


def _numbered(names: np.ndarray) -> np.ndarray:
    """The rank of each name among the distinct ones."""
    order = np.argsort(names)
    ranked = names[order]
    out = np.empty(len(names), np.uint32)
    out[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])) if len(names) else 0
    return out


def repeated(raw: np.ndarray, at: np.ndarray, docs: np.ndarray, salt: int = SALT) -> np.ndarray:
    """Whether the 50-byte string at each place is also that of a smaller document, by refinement of buckets."""
    wanted = np.zeros(len(raw), bool)
    wanted[at] = wanted[at + LATE] = True
    places = np.flatnonzero(wanted)
    bucket = np.zeros(len(raw), np.uint32)
    bucket[places] = _numbered(_doubled(raw, places, salt))
    several = np.bincount(bucket[places]) > 1
    left = np.flatnonzero(several[bucket[at]] & several[bucket[at + LATE]]) if len(at) else np.zeros(0, np.int64)
    here = at[left]
    _, least, where = _least((bucket[here].astype(np.uint64) << _u64(32)) | bucket[here + LATE], docs[left])
    out = np.zeros(len(at), bool)
    out[left] = least[where] < docs[left]
    return out


def _masks(raw: np.ndarray, size: np.ndarray, ids: np.ndarray, salt: int) -> np.ndarray:
    """Of each context, the strings (as bits) that a smaller document holds; ``raw`` has the contexts in a row."""
    start = np.cumsum(size) - size
    count = size - LENGTH + 1
    head = np.cumsum(count) - count
    at = np.repeat(start - head, count) + np.arange(count.sum())
    found = repeated(raw, at, np.repeat(ids, count), salt)
    bits = found.astype(np.uint64) << (np.arange(len(at)) - np.repeat(head, count)).astype(np.uint64)
    return np.bitwise_or.reduceat(bits, head)


def covered(found: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a string that starts at one of the places found."""
    edge = np.zeros(n + 1, np.int8)
    if len(found):
        found = np.unique(found)
        apart = np.diff(found) > LENGTH
        edge[found[np.append(True, apart)]] = 1
        edge[found[np.append(apart, True)] + LENGTH] = -1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def _named_contexts(raw: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
    return _pair(string_ids(raw, first, salt), string_ids(raw, last, salt) + (last - first).astype(np.uint64), salt)


class Texts:
    """The texts of a bucket as one padded byte array."""

    def __init__(self, ids: list, raws: list[bytes]):
        self.ids = np.array(ids, np.int64)
        sizes = np.array([len(r) for r in raws], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = np.frombuffer(b"".join([*raws, bytes(128)]), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, document, first string, last string) of every run of strings with one anchor."""
        n = int(self.ends[-1]) if len(self.ends) else 0
        words = _words(self.raw)
        out = []
        for s in range(0, n, STRIDE):
            e = min(n, s + STRIDE)
            width = e - s + REACH
            h = np.full(width, 0x13198A2E03707344, np.uint64)
            for k in range(0, GRAM, 8):
                h ^= words[s + k : s + k + width]
                h *= _u64(0x9E3779B97F4A7C15)
                h ^= h >> _u64(29)
            h = _mixed(h)
            # The hash's upper bits, and the place below them: the least is the first of its kind.
            least = h & ~_u64(2 * STRIDE - 1)
            least |= np.arange(width, dtype=np.uint64)
            reach = 1
            while reach < REACH:
                step = min(reach, REACH - reach)
                least = np.minimum(least[step:], least[:-step])
                reach += step
            place = (least[: e - s] & _u64(2 * STRIDE - 1)).astype(np.int64)
            first = np.searchsorted(self.ends, s, side="right")
            last = np.searchsorted(self.ends, e - 1, side="right")
            valid = np.zeros(e - s, bool)
            doc = np.zeros(e - s, np.int32)
            for d in range(first, last + 1):
                a, b = max(s, self.starts[d]) - s, min(e, self.ends[d] - LENGTH + 1) - s
                if b > a:
                    valid[a:b] = True
                    doc[a:b] = d
            i = np.flatnonzero(valid)
            if not len(i):
                continue
            new = np.ones(len(i), bool)
            new[1:] = (place[i[1:]] != place[i[:-1]]) | (doc[i[1:]] != doc[i[:-1]]) | (i[1:] != i[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(i)) - 1
            out.append((h[place[i[head]]], doc[i[head]].astype(np.int64), i[head] + s, i[tail] + s, place[i[head]] + s))
        if not out:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
        grams, docs, firsts, lasts, places = (np.concatenate(x) for x in zip(*out))
        # A run that a stride cut apart is one again: passes may meet the texts of a bucket in another order.
        new = np.ones(len(grams), bool)
        new[1:] = (places[1:] != places[:-1]) | (docs[1:] != docs[:-1]) | (firsts[1:] != lasts[:-1] + 1)
        head = np.flatnonzero(new)
        return grams[head], docs[head], firsts[head], lasts[np.append(head[1:], len(grams)) - 1]

    def contexts(self, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
        """Identifiers of the bytes from each first string to the end of its last one."""
        return _named_contexts(self.raw, lo, hi, salt)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, their bytes in planes, which compress well."""
    d = np.diff(a, prepend=_u64(0))
    return _pack(d.view(np.uint8).reshape(-1, 8).T) if len(a) else b""


def _unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.ascontiguousarray(_unpack(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _held(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted wanted ones."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, least document of each, index of each key among them)."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    where = np.empty(len(k), np.int64)
    where[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(docs[order], np.flatnonzero(new)) if len(k) else docs
    return k[new], least, where


def _by_part(keys: np.ndarray, parts: int):
    """(part, indexes of its keys in ascending order of the keys), for every part that has some."""
    part = (keys % _u64(parts)).astype(np.int64)
    order = np.argsort(keys)
    order = order[np.argsort(part[order].astype(np.int16 if parts < 1 << 15 else np.int64), kind="stable")]
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(part[own[0]]), own


def _texts(docs: pa.Table) -> Texts:
    ids = docs.column("id").to_pylist()
    raws = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
    live = [i for i, d in enumerate(ids) if d is not None]
    return Texts([ids[i] for i in live], [raws[i] for i in live])


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _dealt(docs: DataFrame, key: str, text: str, carry: list[str], settings: Settings) -> tuple[DataFrame, int]:
    """Documents dealt to buckets, and the number of parts, both by their summed size."""
    total = docs.agg(F.sum(size_of(docs[text]))).first()[0] or 0
    buckets, parts = max(1, -(-total // settings.bucket_bytes)), max(1, -(-total // settings.part_bytes))
    own = [docs[c].alias(f"carried_{i}") for i, c in enumerate(carry)]
    dealt = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"), *own)
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int")), parts


def deduplicate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    settings: Settings = Settings(),
    texts: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Removes every byte inside a 50-byte string that also starts in a document of smaller id.

    One row per document row: ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and the digest of the
    bytes left, or, with ``texts``, the text left, where a character cut apart is left out whole.
    The columns named in ``carry`` come along.
    NULL texts count as empty. Rows without an id neither lose nor cost bytes, and rows of one id
    don't cost each other any. Strings are told apart by 64-bit names of their halves or, if a gram
    of theirs is crowded, of the whole; the names hang on a salt that every call draws.
    """
    dealt, parts = _dealt(docs, key, text, list(carry), settings)
    crowd = settings.crowded
    # Drawn here and carried by the tasks, so that all of them, and a task run again, use the same names.
    salt = secrets.randbits(64)

    def asks(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        own = _texts(group)
        h, doc, _, _ = own.anchors()
        h = h >> _u64(16)
        # Anchors come document by document, so a stable order shows a document once for each gram.
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        keys, n = np.unique(h[new], return_counts=True)
        rows = [
            (part, bucket, _pack_sorted(keys[i]), _pack(n[i].astype(np.int32))) for part, i in _by_part(keys, parts)
        ]
        return _table(rows, ["part", "bucket", "keys", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def shared(group: pa.Table) -> pa.Table:
        keys = [_unpack_sorted(b) for b in group.column("keys").to_pylist()]
        n = np.concatenate([_unpack(b, np.int32) for b in group.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(flat := np.concatenate(keys), kind="stable")
        head = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
        total = np.empty(len(flat), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], head), np.diff(np.append(head, len(flat))))
        rows, at = [], 0
        for bucket, k in zip(group.column("bucket").to_pylist(), keys):
            t = total[at : at + len(k)]
            at += len(k)
            if (t > 1).any():
                rows.append((bucket, _pack_sorted(k[(t > 1) & (t <= crowd)]), _pack_sorted(k[t > crowd])))
        return _table(rows, ["bucket", "calm", "crowded"], [pa.int32(), pa.binary(), pa.binary()])

    def keys_of(replies: pa.Table, name: str) -> np.ndarray:
        got = [_unpack_sorted(b) for b in replies.column(name).to_pylist() if b]
        return np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)

    def refined(group: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows and replies.num_rows:
            bucket = group.column("bucket")[0].as_py()
            own = _texts(group)
            h, doc, lo, hi = own.anchors()
            h = h >> _u64(16)
            calm = _held(h, keys_of(replies, "calm"))
            lo_, hi_, ids = lo[calm], hi[calm], own.ids[doc[calm]]
            names, least, where = _least(own.contexts(lo_, hi_, salt), ids)
            first = np.full(len(names), -1, np.int64)
            first[where[::-1]] = np.arange(len(where))[::-1]  # a place that shows each context
            grams, lo_, size = h[calm][first], lo_[first], hi_[first] - lo_[first] + LENGTH
            for part, i in _by_part(grams, parts):
                at = np.repeat(lo_[i] - (np.cumsum(size[i]) - size[i]), size[i]) + np.arange(size[i].sum())
                cuts = np.searchsorted(grams[i], _SLICE_BOUNDS).astype(np.int32)
                rows.append((0, part, bucket, _pack(least[i]), _pack(size[i].astype(np.uint8)), _pack(own.raw[at]), _pack(cuts)))
            hot = np.flatnonzero(_held(h, keys_of(replies, "crowded")))
            if len(hot):
                count = hi[hot] - lo[hot] + 1
                at = np.repeat(lo[hot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                names, least, _ = _least(string_ids(own.raw, at, salt), np.repeat(own.ids[doc[hot]], count))
                for part, i in _by_part(names, parts):
                    rows.append((1, part, bucket, _pack(least[i]), b"", _pack_sorted(names[i]), b""))
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return _table(rows, ["kind", "part", "bucket", "ids", "sizes", "data", "cuts"], kinds)

    def settled(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        ids = [_unpack(b, np.int64) for b in group.column("ids").to_pylist()]
        buckets = group.column("bucket").to_pylist()
        data = group.column("data").to_pylist()
        rows = []
        if kind == 1:
            names = [_unpack_sorted(b) for b in data]
            _, least, where = _least(np.concatenate(names), flat := np.concatenate(ids))
            repeat, at = least[where] < flat, 0
            for bucket, own in zip(buckets, names):
                found = repeat[at : at + len(own)]
                at += len(own)
                if found.any():
                    rows.append((bucket, b"", b"", _pack_sorted(own[found])))
        else:
            sizes = [_unpack(b, np.uint8).astype(np.int64) for b in group.column("sizes").to_pylist()]
            texts_of = [_unpack(b, np.uint8) for b in data]
            cuts = [_unpack(b, np.int32) for b in group.column("cuts").to_pylist()]
            ends = [np.append(0, np.cumsum(n)) for n in sizes]
            found = [([], []) for _ in buckets]
            # Equal strings have one gram, so every slice is settled by itself, in a fraction of the memory.
            for k in range(SLICES):
                at = [(c[k], c[k + 1]) for c in cuts]
                size = np.concatenate([n[a:b] for n, (a, b) in zip(sizes, at)])
                if not len(size):
                    continue
                raw = np.concatenate([*(t[e[a] : e[b]] for t, e, (a, b) in zip(texts_of, ends, at)), np.zeros(128, np.uint8)])
                mask = _masks(raw, size, np.concatenate([i[a:b] for i, (a, b) in zip(ids, at)]), salt)
                start = np.cumsum(size) - size
                done = 0
                for (a, b), (contexts, masks) in zip(at, found):
                    i = np.flatnonzero(mask[done : done + b - a]) + done
                    done += b - a
                    if len(i):
                        contexts.append(_named_contexts(raw, start[i], start[i] + size[i] - LENGTH, salt))
                        masks.append(mask[i])
            for bucket, (contexts, masks) in zip(buckets, found):
                if contexts:
                    context, mask = np.concatenate(contexts), np.concatenate(masks)
                    i = np.argsort(context)
                    rows.append((bucket, _pack_sorted(context[i]), _pack(mask[i]), b""))
        return _table(rows, ["bucket", "contexts", "masks", "strings"], [pa.int32(), *[pa.binary()] * 3])

    def repeats(own: Texts, replies: pa.Table) -> np.ndarray:
        """Places of the strings that a smaller document holds."""
        h, doc, lo, hi = own.anchors()
        if not len(h):
            return np.zeros(0, np.int64)
        names, least, where = _least(own.contexts(lo, hi, salt), own.ids[doc])
        mask = np.zeros(len(names), np.uint64)
        for c, m in zip(replies.column("contexts").to_pylist(), replies.column("masks").to_pylist()):
            if c:
                mask[np.searchsorted(names, _unpack_sorted(c))] |= _unpack(m, np.uint64)
        own_mask = mask[where]
        own_mask[least[where] < own.ids[doc]] = _u64(0xFFFFFFFFFFFFFFFF)  # a smaller document of this bucket
        some = np.flatnonzero(own_mask)
        count = hi[some] - lo[some] + 1
        head = np.cumsum(count) - count
        step = np.arange(count.sum()) - np.repeat(head, count)
        on = (np.repeat(own_mask[some], count) >> step.astype(np.uint64)) & _u64(1) == 1
        out = [(np.repeat(lo[some], count) + step)[on]]
        hot = np.flatnonzero(_held(h >> _u64(16), keys_of(replies, "crowded")))
        if len(hot):
            count = hi[hot] - lo[hot] + 1
            at = np.repeat(lo[hot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            ids = np.repeat(own.ids[doc[hot]], count)
            strings = string_ids(own.raw, at, salt)
            _, least, where = _least(strings, ids)
            out.append(at[(least[where] < ids) | _held(strings, keys_of(replies, "strings"))])
        return np.concatenate(out)

    def kept(group: pa.Table, replies: pa.Table) -> pa.Table:
        ids, given = group.column("id").to_pylist(), group.column("text").cast(pa.binary()).to_pylist()
        own = _texts(group)
        gone = covered(repeats(own, replies), len(own.raw))
        rows, live = [], 0
        for d, t in zip(ids, given):
            raw = t or b""
            if d is None:
                rows.append((d, len(raw), 0, 0, raw.decode() if texts else hashlib.sha256(raw).hexdigest()))
                continue
            a, b = own.starts[live], own.ends[live]
            live += 1
            out = gone[a:b]
            n = int(out.sum())
            left = own.raw[a:b][~out].tobytes() if n else raw
            runs = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if n else 0
            if texts:
                last = raw.decode() if not n else "".join(p.decode(errors="ignore") for p in _pieces(own.raw[a:b], out))
            else:
                last = hashlib.sha256(left).hexdigest()
            rows.append((d, len(raw), n, runs, last))
        names = [key, "n_bytes", "n_removed", "n_spans", last_name]
        out = _table(rows, names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])
        for i, c in enumerate(carry):
            out = out.append_column(c, group.column(f"carried_{i}"))
        return out

    last_name = text if texts else "kept_sha256"
    # The texts are shuffled once: the three passes have this exchange in common.
    by_bucket = dealt.groupBy("bucket")
    asked = by_bucket.applyInArrow(asks, "part int, bucket int, keys binary, n binary")
    first = asked.groupBy("part").applyInArrow(shared, "bucket int, calm binary, crowded binary")
    contexts = by_bucket.cogroup(first.groupBy("bucket")).applyInArrow(
        refined, "kind int, part int, bucket int, ids binary, sizes binary, data binary, cuts binary"
    )
    second = contexts.groupBy("kind", "part").applyInArrow(settled, "bucket int, contexts binary, masks binary, strings binary")
    crowded = first.filter("length(crowded) > 0").select("bucket", "crowded")
    answers = second.withColumn("crowded", F.lit(b"")).unionByName(
        crowded.select("bucket", *[F.lit(b"").alias(c) for c in ("contexts", "masks", "strings")], "crowded")
    )
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(
        kept,
        f"`{key}` long, n_bytes long, n_removed long, n_spans long, `{last_name}` string"
        + "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carry),
    )


def _pieces(raw: np.ndarray, out: np.ndarray):
    """The runs of bytes left."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]])))
    for a, b in zip(edges[::2], edges[1::2]):
        yield raw[a:b].tobytes()
