import hashlib
import random

import pytest

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from galeframe.llm import bpe  # noqa: E402

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(PATH)
    got.no_truncation()
    got.no_padding()
    return got


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_every_row(docs, corpus, library):
    got = bpe.encode(docs, PATH, mean=64).collect()
    assert len(got) == len(corpus)
    left = sorted((i is None, i or 0, *map(repr, expected(library, t))) for i, t in corpus)
    right = sorted((r.doc_id is None, r.doc_id or 0, repr(list(r.ids)), repr(r.decoded)) for r in got)
    assert left == right
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_digests(docs, corpus, library):
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, PATH).collect()}
    for i, t in corpus:
        ids, decoded = expected(library, t)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert (i, *sha) in got


@pytest.mark.parametrize("mean", [4, 32, 512])
def test_random_texts_and_joints(library, mean):
    rng = random.Random(mean)
    signs = [" ", "\n", "a", "B", "é", "é", "́", "1", "'s", "<|endoftext|>", "日", "😀", "Σ", "İ", "\x85", "\x0b", "ᄒ", "ᅡ", "#"]
    coder = bpe.Encoder(PATH, mean)
    for _ in range(120):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 300)))
        ids, decoded = expected(library, text)
        assert coder.digest(text.encode()) == (len(ids), " ".join(map(str, ids)), decoded)
        assert bpe.agrees(coder, text.encode())


def test_shared_passages_are_encoded_once():
    coder = bpe.Encoder(PATH, 32)
    passage = " ".join(f"w{i}" for i in range(3000))
    coder.digest(passage.encode())
    encoded = coder.encoded
    coder.digest(b"something before it " + passage.encode())
    assert coder.encoded - encoded < encoded / 10


def test_the_memo_forgets_but_stays_right():
    memo = bpe.Memo(3)
    for i in range(20):
        memo[i] = i * i
        assert memo.get(i) == i * i
    assert len(memo.young) <= 3 and len(memo.old) <= 3 and memo.get(0) is None


def test_empty_table(nothing):
    assert bpe.encode(nothing, PATH).count() == 0
