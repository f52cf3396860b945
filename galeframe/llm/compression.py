"""Quality rules on zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from galeframe.llm.common import column, pieces

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Bands:
    """Ratios (compressed over raw bytes) that pass, by length in bytes.

    ``limits`` has (below this length, least ratio, largest ratio); short texts compress badly, so
    their bands lie higher. A document fails if its own ratio is outside its band, or if more than
    ``bad_share`` of its chunks of ``chunk`` bytes are outside ``chunk_band``; the last chunk ends
    with the text, so all bytes of a text of a chunk or more are in one. Below ``least`` bytes a
    ratio says nothing and passes.
    """

    limits: tuple = field(
        default=(
            (256, 0.35, 1.30),
            (512, 0.45, 0.95),
            (1024, 0.40, 0.85),
            (2048, 0.36, 0.78),
            (4096, 0.32, 0.72),
            (8192, 0.28, 0.68),
            (16384, 0.25, 0.68),
            (float("inf"), 0.18, 0.68),
        )
    )
    least: int = 64
    chunk: int = 4096
    chunk_band: tuple = (0.25, 0.72)
    bad_share: float = 0.25
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    upto = total = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def judged(raw: bytes, bands: Bands, packer) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of chunks, of those outside their band, and the verdict."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(packer.compress(raw)) / len(raw)
    low, high = next((lo, hi) for below, lo, hi in bands.limits if len(raw) < below)
    starts = list(range(0, len(raw) - bands.chunk + 1, bands.chunk))
    if starts and len(raw) % bands.chunk:
        starts.append(len(raw) - bands.chunk)
    bad = 0
    for at in starts:
        part = raw[at : at + bands.chunk]
        bad += not bands.chunk_band[0] <= len(packer.compress(part)) / len(part) <= bands.chunk_band[1]
    fits = len(raw) < bands.least or low <= ratio <= high
    return ratio, len(starts), bad, fits and bad <= bands.bad_share * len(starts)


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


def compression_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: base counts, ratios and whether it is kept.

    Every whole text is read; NULL counts as empty, which has no word and fails the base rule.
    Equal rows give equal results; other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]

    def rules(batches):
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in pieces(batches):
            rows = []
            for t in column(batch, "text").to_pylist():
                t = t or ""
                raw = t.encode()
                words = raw.split()
                repeats = repeated_words(words)
                failed = len(words) < 50 or 100 * repeats > 50 * len(words)
                ratio, chunks, bad, fits = judged(raw, bands, packer)
                rows.append(
                    (
                        len(words),
                        len(t) - sum(map(t.count, SPACES)),
                        len(raw) - len(raw.translate(None, SYMBOLS)),
                        repeated_lines(raw),
                        repeats,
                        failed,
                        ratio,
                        chunks,
                        bad,
                        fits and not failed,
                    )
                )
            cols = list(zip(*rows)) if rows else [[]] * 10
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), *(pa.array(c, t) for c, t in zip(cols, types))],
                [key, *(f.split()[0] for f in FIELDS.split(", "))],
            )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(rules, f"`{key}` {kind}, {FIELDS}")
