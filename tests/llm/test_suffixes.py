import hashlib

import numpy as np
import pytest

from galeframe.llm import suffixes


def brute(rows):
    """Per (id, text): what the contract says, string by string."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            if i is not None and i < least.get(s, 1 << 62):
                least[s] = i
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if i is not None and least[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i is None, i or 0, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


SMALL = suffixes.Settings(bucket_bytes=20_000, part_bytes=30_000, crowded=3)


@pytest.mark.parametrize("settings", [suffixes.Settings(), SMALL], ids=["usual", "many buckets, crowded grams"])
def test_equals_brute_force(docs, corpus, settings):
    got = suffixes.deduplicate(docs, settings=settings).collect()
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert rows == brute(corpus)


def test_one_passage_in_most_documents(spark):
    passage = "the very same sixty or so bytes that a third of all rows hold, word"
    rows = [(i, f"{i * 7919} begins {passage} ends {i * 104729}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.deduplicate(frame, settings=suffixes.Settings(bucket_bytes=2000, part_bytes=4000, crowded=10))
    assert sorted((False, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute(rows)


def test_texts_left_and_carried_columns(docs):
    got = {r.doc_id: r for r in suffixes.deduplicate(docs, texts=True, carry=("lang", "key")).filter("doc_id > 7").collect()}
    assert got[408].text == "" or got[408].n_removed == 0
    assert got[409].text == "" and got[409].n_removed == 50
    assert got[100].text == "" and got[100].key == "k"


def test_a_character_cut_apart_is_left_out(spark):
    shared = "s" * 60
    frame = spark.createDataFrame([(1, shared + "é"), (2, shared + "è")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.deduplicate(frame, texts=True).collect()}
    assert got[2].n_removed == 61 and got[2].text == ""  # both letters begin with the same byte


@pytest.mark.parametrize("same", [16, 32, 48, 49, 50])
def test_refinement_tells_strings_apart_to_their_last_byte(same):
    """Strings that agree in their first bytes only: each step of refinement too few would join them."""
    texts = [b"a" * 50, b"a" * same + b"b" * (50 - same), b"b" * (50 - same) + b"a" * same, b"a" * 50]
    raw = np.frombuffer(b"".join([*texts, bytes(128)]), np.uint8)
    at, docs = np.arange(4) * 50, np.array([5, 6, 7, 8])
    assert list(suffixes.repeated(raw, at, docs)) == [False, same == 50, same == 50, True]


def test_refinement_equals_grouping_by_bytes():
    """Texts of two letters, so that nearly all buckets are shared and the last step decides."""
    draw = np.random.default_rng(3)
    base = draw.integers(97, 99, 400, dtype=np.uint8)
    texts = []
    for _ in range(60):
        text = base.copy()
        text[draw.integers(0, 400, 6)] ^= 3
        texts.append(text)
    raw = np.concatenate([*texts, np.zeros(128, np.uint8)])
    at = np.concatenate([d * 400 + np.arange(351) for d in range(60)])
    docs = np.repeat(draw.permutation(60), 351)
    least = {}
    strings = [raw[i : i + 50].tobytes() for i in at]
    for string, doc in zip(strings, docs):
        least[string] = min(doc, least.get(string, doc))
    want = [least[string] < doc for string, doc in zip(strings, docs)]
    assert list(suffixes.repeated(raw, at, docs)) == want
    assert len(set(suffixes.string_ids(raw, at))) == len(least)


def test_strings_made_to_get_one_name_stay_apart(spark):
    """The halves of these differ by what the names without a salt lost."""
    same = "x" * 34
    made = ["jntxbqdv@OO``OOO" + same, "cnjwdctq#@RO'ZTP" + same]
    rows = [(i, t) for i, t in enumerate(made)]
    got = suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((False, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    raw = np.frombuffer("".join(made).encode() + bytes(128), np.uint8)
    assert list(suffixes.repeated(raw, np.array([0, 50]), np.array([1, 2]))) == [False, False]


def test_contexts_hang_on_no_order_of_the_texts():
    """Passes may meet the texts of a bucket in another order, and so cut elsewhere into strides."""
    draw = np.random.default_rng(8)
    texts = [bytes(draw.integers(97, 123, n, dtype=np.uint8)) for n in (900_000, 700_001, 800_003, 600_007)]

    def contexts(order):
        own = suffixes.Texts(list(order), [texts[k] for k in order])
        _, doc, lo, hi = own.anchors()
        return sorted(zip(own.ids[doc].tolist(), own.contexts(lo, hi, 5).tolist()))

    assert contexts([0, 1, 2, 3]) == contexts([2, 0, 3, 1])


def test_slices_of_a_part_are_about_even():
    own = suffixes.Texts([1], [bytes(np.random.default_rng(4).integers(97, 123, 300_000, dtype=np.uint8))])
    gram, _, lo, hi = own.anchors()
    part = np.searchsorted(suffixes._SLICE_BOUNDS, gram >> np.uint64(16), side="right") - 1
    strings = np.bincount(part, hi - lo + 1, suffixes.SLICES)
    assert len(strings) == suffixes.SLICES and strings.sum() == 299_951
    assert strings.max() < 2 * strings.mean() < 4 * strings.min()


def test_covered_bytes_equal_those_of_every_string():
    draw = np.random.default_rng(6)
    for found in ([], [0], [350], [10, 60, 110, 161], draw.integers(0, 351, 6).tolist() * 2):
        want = np.zeros(400, bool)
        for k in found:
            want[k : k + 50] = True
        assert (suffixes.covered(np.array(found, np.int64), 400) == want).all()


def test_empty_table(nothing):
    assert suffixes.deduplicate(nothing).count() == 0
