from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")
regex = pytest.importorskip("regex")
tiktoken = pytest.importorskip("tiktoken")

from segue.llm import bpe  # noqa: E402

PATH = pt.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.model_proto(bpe.read_ranks(PATH)))


@pytest.fixture(scope="module")
def truth():
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(codec, texts):
    out = []
    for ids, counts in codec.encode(texts):
        out += [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_random_texts_give_the_ids_and_bytes_of_the_tokenizer(codec, truth):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab'stredvlm  \n\t é1९,.!日''　 \x1c\x85\U0001f600") for _ in range(rng.randrange(16))) for _ in range(5000)]
    assert [bpe.pretokens(t) for t in texts] == [regex.findall(pt.PATTERN, t) for t in texts]
    found = ids_of(codec, texts)
    assert found == [truth.encode_ordinary(t) for t in texts]
    for t, ids in zip(texts, found):
        assert bytes(next(codec.decode(np.array(ids, np.int64), np.array([len(ids)])))) == t.encode()


def test_every_token_is_reached(codec):
    assert not codec.whole


def test_forgetting_changes_nothing(codec, monkeypatch):
    texts = ["one two three", "four five " * 50, "", "six"]
    before = ids_of(codec, texts)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 8)
    codec.forget()
    assert ids_of(codec, texts) == before


def test_odd_rows(spark, odd, none, truth):
    rows = bpe.digests(odd, PATH).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert len(rows) == odd.count()
    expect = sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in [r["text"] for r in odd.collect()])
    assert sorted(r["decoded_sha256"] for r in rows) == expect
    sizes = {r["doc_id"]: r["n_tokens"] for r in rows}
    for i, t in texts:
        if i not in (None, 6):
            assert sizes[i] == len(truth.encode_ordinary(t or ""))
    assert bpe.digests(none, PATH).count() == 0


def test_encode_then_decode(spark, odd):
    back = bpe.decode(bpe.encode(odd.where("doc_id is not null"), PATH), PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all(bytes(r["bytes"]).decode() == (texts[r["doc_id"]] or "") for r in back)
