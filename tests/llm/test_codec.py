"""Backtracking encoder against the library, over odd and random text and the corpus."""

import hashlib
import random

import pytest
import sentencepiece

from dosewise.llm import piece_codec
from dosewise.llm.common import read
from dosewise.llm.queries import piece_digest, piece_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def codec():
    with open(piece_model(), "rb") as f:
        return piece_codec.PieceCodec(f.read())


def check(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text), text[:80]
    assert codec.decode(ids) == library.decode(ids), text[:80]
    fast = codec.decode_valid(ids)
    assert fast is None or fast == library.decode(ids)


def test_odd_texts(codec, library):
    for text in ["", " ", "   ", "a", " a", "a ", "▁", "▁▁a", "\x00", "\n\n\n", "é́", "日本語", "\U0001f600", "<s></s><unk><0x0A>", "　x", "a" * 3000, "ab" * 2000,
                 *(" " * n + "x" for n in range(1, 70)), "\n".join(["x"] * 400), "x" + " " * 50 + "\n" + " " * 31]:
        check(codec, library, text)


@pytest.mark.parametrize("alphabet", ["ab ", "the in\n", "  ▁abcdefghe thingtion\n\té日😀\x00́<s>0123.!", "aeiouxyz", "=-*/ ()"])
def test_random_texts(codec, library, alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        check(codec, library, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))))


def test_any_ids_decode_like_the_library(codec, library):
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(0, 300), rng.randrange(32000)]) for _ in range(20)]
        assert codec.decode(ids) == library.decode(ids), ids


def test_compatibility_is_re_merging(codec):
    rng = random.Random(9)
    tokens = list(codec.right_edges)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    words = [rng.choice(tokens) for _ in range(3000)]
    pairs += [(w[:k], w[k:]) for w in words for k in range(1, len(w)) if w[:k] in codec.right_edges and w[k:] in codec.right_edges]
    for a, b in pairs:
        if "▁▁" not in a + b and "▁" not in b:
            assert codec.compatible((a, b)) == (codec.merge(a + b) == [a, b]), (a, b)


def check_rows(docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in piece_digest(docs, piece_model()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_corpus_and_odd_documents(spark, sf, odd_docs, no_docs, library):
    check_rows(read(spark, sf, "documents"), library)
    check_rows(odd_docs, library)
    assert piece_digest(no_docs, piece_model()).count() == 0
    coded = piece_codec.encode(odd_docs, piece_model())  # has a column named ids already
    assert set(coded.columns) == set(odd_docs.columns) and dict(coded.dtypes)["ids"] == "array<int>"
