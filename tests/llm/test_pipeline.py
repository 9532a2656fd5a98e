from __future__ import annotations

import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402

from segue.llm.common import written  # noqa: E402


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), "test-stage")
        assert out.columns == docs.columns, name
        assert {r["doc_id"] for r in out.collect()} <= ids
        if name == "language ID":
            assert out.count() == docs.count()
        if name == "line dedup":
            assert out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0
        if name == "near-duplicates":
            assert out.groupBy("text").count().where("count > 1").count() == 0
        docs = out
    last = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.columns[:2] == ["doc_id", "n_tokens"]


def test_odd_rows(spark, odd, none):
    for rows in (odd.drop("n_chars").withColumn("n_chars", odd.doc_id), none):
        docs = rows
        for _, stage in cp.STAGES:
            docs = written(stage(spark, docs, ""), "test-odd")
        assert docs.columns[0] == "doc_id"


def test_stages_are_brute_force(spark):
    """Lines, near-duplicates, mixing and tokens of a small table, each against a plain loop over what the stage before kept."""
    import hashlib
    import random

    import public_tokenizers
    import tiktoken
    from test_minhash import brute
    from texts import prose, without_later_windows

    from segue.llm import bpe, mixing

    rng = random.Random(12)
    passage = [prose(rng, 12) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [prose(rng, 15) for _ in range(rng.randrange(2, 7))]
        if i % 4 == 0:
            lines[1:1] = passage
        if i % 5 == 1 and rows:
            lines = rows[-1][1].split("\n")
            lines[-1] = " ".join([*lines[-1].split()[:-1], "other"])
        rows.append((i, "\n".join(lines), "en", ["a", "b", "c", "d"][i % 7 % 4], 0))
    rows += [(90, "", "en", "a", 0), (91, None, None, None, None), (92, rows[3][1], "en", "b", 0), (None, rows[3][1], "en", "b", 0), (None, prose(rng, 30), "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    lines = written(cp.lines(spark, docs, ""), "test-lines")
    after = {(r["doc_id"], r["n_chars"]): r["text"] for r in lines.collect()}
    left = without_later_windows([r[:2] for r in rows])
    want = {(i, None): None for i, text, *_ in rows if text is None} | {(i, len(found)): found for (i, _), (found, _) in left.items()}
    assert after == want

    kept = written(cp.near_duplicates(spark, lines, ""), "test-near")
    named = [(k[0], t) for k, t in after.items() if k[0] is not None]
    classes = brute(named)
    stay = {i for i in classes if classes[i] == i}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(stay)
    texts = {t or "" for _, t in named}
    assert sum(r["doc_id"] is None for r in kept.collect()) == len({t for k, t in after.items() if k[0] is None} - texts)

    taken = {}
    mix = written(cp.mix(spark, kept, ""), "test-mix")
    for r in mix.collect():
        taken[(r["doc_id"], r["text"])] = taken.get((r["doc_id"], r["text"]), 0) + 1
    assert max(taken.values()) <= 2 and set(taken) <= {(r["doc_id"], r["text"]) for r in kept.collect()}
    goal = {r["source"]: r["target"] for r in mixing.targets(kept.select("source", mixing.words().alias("size"))).collect()}
    for source, target in goal.items():
        own = [r for r in kept.collect() if r["source"] == source]
        words = sum(taken.get((r["doc_id"], r["text"]), 0) * len((r["text"] or "").split()) for r in own)
        assert abs(words - target) <= max(len((r["text"] or "").split()) for r in own)

    name = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(name), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expect = []
    for r in mix.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        expect.append((str(r["doc_id"]), len(ids), digest(" ".join(map(str, ids)).encode()), digest((r["text"] or "").encode())))
    assert sorted(expect) == sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.tokens(spark, mix, "").collect())


def test_language_drops_gibberish_and_unseen_languages(spark, sf_dir):
    import base64
    import random

    rng = random.Random(6)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    planted = [polish, polish * 9, finnish, finnish * 9, "Все люди", "Все люди рождаются свободными и равными " * 30, "日本"]
    for n in (64, 256, 4000):
        planted += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)), base64.b64encode(rng.randbytes(n)).decode(), rng.randbytes(n).hex()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = 10_000_000  # no language: none is learned from them
    rows = spark.createDataFrame([(first + i, t, None, "x", len(t)) for i, t in enumerate(planted)], docs.schema)
    kept = {r["doc_id"] for r in cp.language(spark, docs.unionByName(rows), sf_dir).collect()}
    assert [t[:40] for i, t in enumerate(planted) if first + i in kept] == [] and kept == {r["doc_id"] for r in docs.collect()}
