import base64
import random
import re
from collections import Counter

from galeframe.llm import compression


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    marked = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def test_base_equals_brute_force(docs, corpus):
    got = compression.compression_rules(docs).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, *r[1:7]) for r in got)
    assert found == sorted((i is None, i or 0, *brute(t or "")) for i, t in corpus)
    assert not any(r.kept for r in got if r.base_failed)


def test_random_lines(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a b", "a", "\n", " ", "c d e", "\x0b", "# x|", "é"]) for _ in range(80))) for i in range(60)]
    got = compression.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, *r[1:7]) for r in got) == sorted((i, *brute(t)) for i, t in rows)


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = " ".join(rng.choice(words) for _ in range(1500))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(40)) for _ in range(300))
    few = ["".join(rng.choice("ab") for _ in range(3)) for _ in range(3)]
    lines = [" ".join(rng.sample(few, 3)) + f" {i % 7}" for i in range(2000)]
    rows = [(1, prose), (2, noise), (3, "\n".join(lines)), (4, ""), (5, None)]
    got = {r.doc_id: r for r in compression.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert got[2].ratio > 0.7 and got[3].ratio < 0.2


def test_junk_is_found_wherever_it_stands(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    good = " ".join(rng.choice(words) for _ in range(1500))
    junk = base64.b64encode(rng.randbytes(3000)).decode()[:3900]
    rows = [(1, good[:4096] + junk), (2, junk + good[:4096]), (3, good[: 4096 + 3900]), (4, good[:4096])]
    got = {r.doc_id: r for r in compression.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert [got[i].n_chunks for i in (1, 2, 3, 4)] == [2, 2, 2, 1]


def test_empty_table(nothing):
    assert compression.compression_rules(nothing).count() == 0
