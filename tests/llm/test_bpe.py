import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

from . import awkward

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codecs():
    with open(PATH, "rb") as file:
        ranks = bpe.read_ranks(file.read())
    return bpe.Codec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_match_the_library(codecs):
    ours, theirs = codecs
    rng = random.Random(2)
    alphabet = "aab e'stre  \n\t\x1c\x85 é漢字😀12٣ĠIt's\u2003\u3000ſK"
    for k in range(2000):
        text = "".join(rng.choice(alphabet if k % 2 else alphabet[:18]) for _ in range(rng.randint(0, 50)))
        assert ids(ours.encode(text)) == theirs.encode_ordinary(text)
        assert ours.decode(ours.encode(text)) == text.encode()


@pytest.mark.parametrize("piece", ["ab" * 30_000, "a" * 50_000, "<|endoftext|>", "zqxj" * 5_000])
def test_long_pretokens(codecs, piece):
    ours, theirs = codecs
    assert ids(ours.encode(piece)) == theirs.encode_ordinary(piece)


def test_bitmap_is_clear_between_pretokens(codecs):
    ours, _ = codecs
    ours.encode("unlikelihoodish")
    assert not any(ours.fine)


def test_awkward_documents(spark, codecs):
    _, theirs = codecs
    found = bpe.round_trip(awkward.frame(spark), PATH, PATTERN).collect()
    wanted = []
    for doc_id, text, *_ in awkward.documents():
        tokens = theirs.encode_ordinary(text or "")
        wanted.append((doc_id, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert bpe.round_trip(awkward.frame(spark, []), PATH, PATTERN).count() == 0


def test_encoding_and_decoding_apart(spark, codecs, monkeypatch):
    _, theirs = codecs
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 4)
    encoded = bpe.encode_documents(awkward.frame(spark), PATH, PATTERN)
    decoded = bpe.decode_documents(encoded, PATH).collect()
    texts = sorted((d[1] or "" for d in awkward.documents()), key=str)
    assert sorted(bytes(r.decoded).decode() for r in decoded) == texts
    assert sorted(len(r.ids) // 4 for r in decoded) == sorted(len(theirs.encode_ordinary(t)) for t in texts)


def test_a_full_cache_keeps_its_early_half(codecs, monkeypatch):
    ours, theirs = codecs
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    ours.packed.clear()
    text = " ".join(f"w{k}ord" for k in range(40))
    assert ids(ours.encode(text)) == theirs.encode_ordinary(text) and len(ours.packed) <= 11 and "w" in ours.packed
