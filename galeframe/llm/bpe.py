"""Word-BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts every text where its content says so: the same passage is
cut alike in every document that holds it. A chunk is encoded once per worker process and found
again by its bytes. Only its inner part, between its first and last blank, can be encoded without
its neighbours; what is left and right of a cut is joined to one text and encoded anew. A blank
ends every pre-token of the tokenizers meant here, so the encoding of a joined text agrees with
that of the whole at both of its ends. The repaired joints therefore leave nothing to change, and
``agrees`` shows this by encoding again with wider and wider surroundings of a joint.

Inside a new chunk the same is done once more with cuts at every blank, so that a word that any
chunk has held before is not encoded again either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from galeframe.llm.common import column, pieces

BLANKS = b" \t\n\v\f\r"
#: Bytes the rolling hash sees, and mean chunk length.
SEEN, MEAN = 16, 512
#: Words and chunks of one generation of the memos, about 120 MB in all.
WORDS, CHUNKS = 400_000, 8_000
#: Bytes of text encoded at once.
PIECE = 1 << 20


def cuts(raw: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Ends of the content-defined chunks of a byte array, its length last.

    The hash at a byte is a weighted sum of it and the SEEN - 1 bytes before; a cut follows every
    byte at which the low bits of the mixed hash are zero, one in ``mean`` of them.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < 2 * SEEN:
        return np.array([n])
    # h[i] = sum of raw[i - k] * M ** k over k < SEEN, by doubling: 4 passes for 16 bytes.
    h = raw.astype(np.uint32)
    step, power = 1, 2654435761
    while step < SEEN:
        h[step:] += h[:-step].copy() * np.uint32(power)
        power = power * power % (1 << 32)
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    found = np.flatnonzero((h >> np.uint32(13)) % np.uint32(mean) == 0) + 1
    found = found[(found >= SEEN) & (found < n)]
    return np.append(found, n)


class Memo:
    """A dictionary of bounded size: what was not asked for in two generations is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and self.old:
            found = self.old.get(key)
            if found is not None:
                self[key] = found
        return found

    def __setitem__(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def __len__(self) -> int:
        return len(self.young)


class Encoder:
    """Encodes and decodes texts by reused chunks; one per worker process and tokenizer file."""

    def __init__(self, path: str, mean: int = MEAN, words: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mean = mean
        self.chunks, self.words = Memo(max(1, words * CHUNKS // WORDS)), Memo(words)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(vocab.values(), default=-1) + 1)
        for name, token in vocab.items():
            self.names[token] = name
        self.encoded = self.reused = 0

    def direct(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids, decoded text, number of ids) of each text, without any reuse."""
        name = self.names.__getitem__
        out = []
        for one in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            ids = one.ids
            out.append((" ".join(map(str, ids)), " ".join(map(name, ids)), len(ids)))
        return out

    def learn(self, words: Iterable[bytes]) -> None:
        """Encodes the words that the memo doesn't hold, all at once."""
        get = self.words.get
        new = [w for w in dict.fromkeys(words) if get(w) is None]
        for word, got in zip(new, self.direct([w.decode() for w in new]) if new else ()):
            self.words[word] = got

    def _joined(self, words: list[bytes]) -> tuple[str, str, int]:
        got = list(map(self.words.young.get, words))
        if None in got:
            got = [self.words.get(w) or self.direct([w.decode()])[0] for w in words]
        got = [g for g in got if g[2]]
        return " ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got])

    def _chunk(self, chunk: bytes) -> tuple:
        """(left of the first blank, encoded inner part, right of the last blank).

        Without a blank the chunk is all left, and its inner part is None.
        """
        found = self.chunks.get(chunk)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        parts = chunk.split()
        if not parts:
            found = (b"", ("", "", 0), b"")
        else:
            left = b"" if chunk[0] in BLANKS else parts[0]
            right = b"" if chunk[-1] in BLANKS else parts[-1]
            if left and right and len(parts) == 1:
                found = (left, None, b"")
            else:
                found = (left, self._joined(parts[bool(left) : len(parts) - bool(right)]), right)
        self.chunks[chunk] = found
        return found

    def _text(self, chunks: list[bytes]) -> tuple[int, str, str]:
        out = []
        open_word = b""
        for chunk in chunks:
            left, inner, right = self._chunk(chunk)
            open_word += left
            if inner is None:
                continue
            if open_word:  # the joint: what the cut took apart, encoded as one
                out.append(self._joined([open_word]))
            out.append(inner)
            open_word = right
        if open_word:
            out.append(self._joined([open_word]))
        out = [x for x in out if x[2]]
        return sum([x[2] for x in out]), " ".join([x[0] for x in out]), " ".join([x[1] for x in out])

    def digests(self, raws: list[bytes]) -> list[tuple[int, str, str]]:
        """Of each whole text: number of tokens, ids joined by blanks, decoded text."""
        cut = []
        for raw in raws:
            ends = cuts(np.frombuffer(raw, np.uint8), self.mean).tolist()
            cut.append([raw[a:b] for a, b in zip([0, *ends], ends)])
        held = self.chunks.get
        fresh = (raw for raw, own in zip(raws, cut) if any(held(c) is None for c in own))
        self.learn(word for raw in fresh for word in raw.split())
        return [self._text(own) for own in cut]

    def digest(self, raw: bytes) -> tuple[int, str, str]:
        return self.digests([raw])[0]


def agrees(encoder: Encoder, raw: bytes) -> bool:
    """Whether every joint, encoded again with ever more of its surroundings, keeps its ids.

    Widens each joint to both sides, twice as far each time, up to the whole text.
    """
    whole = encoder.digest(raw)[1]
    for end in cuts(np.frombuffer(raw, np.uint8), encoder.mean)[:-1].tolist():
        reach = 8
        while reach < 2 * len(raw):
            a = max(0, end - reach)
            while a > 0 and raw[a - 1] not in BLANKS:
                a -= 1
            b = min(len(raw), end + reach)
            while b < len(raw) and raw[b] not in BLANKS:
                b += 1
            ids = encoder.direct([raw[a:b].decode()])[0][0]
            if f" {ids} " not in f" {whole} " and ids:
                return False
            reach *= 2
    return True


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(*settings) -> Encoder:
    """The encoder of this process with these settings; others are given up for it."""
    if settings not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[settings] = Encoder(*settings)
    return _ENCODERS[settings]


def encode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", mean: int = MEAN, words: int = WORDS
) -> DataFrame:
    """Token ids and decoded text of every whole document: ``key``, ``n_tokens``, ``ids``, ``decoded``.

    ``path`` names a tokenizers file whose pre-tokens end at blanks, and is read on the executors.
    NULL counts as empty and gives no ids and an empty decoded text. Rows keep their number and
    order; other columns are ignored. Memory per worker is one piece of texts and the two memos,
    which forget what they have not met for long; ``words`` is their size.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches):
        coder = encoder_of(path, mean, words)
        for batch in pieces(batches, limit=PIECE):
            got = coder.digests([(t or "").encode() for t in column(batch, "text").to_pylist()])
            ids = [np.fromstring(g[1], np.int32, sep=" ") if g[1] else np.zeros(0, np.int32) for g in got]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "key"),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.ListArray.from_arrays(ends, flat),
                    pa.array([g[2] for g in got], pa.string()),
                ],
                [key, "n_tokens", "ids", "decoded"],
            )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, decoded string")


def encode_digests(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", mean: int = MEAN
) -> DataFrame:
    """As ``encode``, with SHA-256 digests of the ids (decimal, one blank between) and the decoded text."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        coder = encoder_of(path, mean, WORDS)
        for batch in pieces(batches, limit=PIECE):
            got = coder.digests([(t or "").encode() for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "key"),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]),
                    pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got]),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
