from __future__ import annotations

import random

from compare import rows_of
from texts import prose, without_later_windows

from segue.llm import line_dedup as ld


def run(spark, rows):
    import duckdb
    import pandas as pd

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.without_repeats(docs, removed_col="chunks_removed").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "object"}))
    return rows_of(got), rows_of(con.execute(ld.ORACLE_MODULUS).fetch_df())


def test_shared_blocks_go_and_all_else_stays(spark):
    rng = random.Random(2)
    block = [prose(rng, 8) for _ in range(12)]
    rows = []
    for i in range(30):
        own = [prose(rng, 8) for _ in range(rng.randrange(1, 10))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (block if i % 2 else []) + own[at:])))
    got, want = run(spark, rows)
    assert got == want
    removed = {int(float(r[1])): int(float(r[0])) for r in got}
    assert removed[1] == 0 and all(removed[i] > 0 for i in range(3, 30, 2)) and not any(removed[i] for i in range(0, 30, 2))


def test_order_and_bytes_of_what_stays(spark):
    text = "a\n\nb  \n\tc\nd\n"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x"), (4, ""), (5, None), (5, "\n\n\n")], "doc_id long, text string")
    found = [(r["doc_id"], r["text"]) for r in ld.without_repeats(docs).collect()]
    assert dict(found[:4])[1] == text and (4, "") in found and (5, None) in found and (5, "\n\n\n") in found and (3, "x") in found


def test_odd_rows(spark, odd, none):
    found = ld.without_repeats(odd)
    assert found.columns == odd.columns and found.count() == odd.count()
    assert ld.without_repeats(none).count() == 0


def test_no_line_of_a_repeated_passage_escapes(spark):
    rng = random.Random(3)
    rows, keep = [], {}
    for n in range(2, 13):
        for _ in range(4):
            lines = [prose(rng, 8) for _ in range(n)]
            if n > 4:
                lines[2] = lines[3] = ""
            for copy in range(3):
                own = [prose(rng, 8) for _ in range(rng.randrange(2, 7))]
                at = rng.randrange(len(own) + 1)
                i = len(rows)
                rows.append((i, "\n".join(own[:at] + lines + own[at:])))
                keep[i] = "\n".join(own) if copy else rows[-1][1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in ld.without_passages(docs).collect()} == keep
    assert any(len(r["text"]) > len(keep[r["doc_id"]]) for r in ld.without_repeats(docs).collect())  # as chunks do


def test_what_goes_stands_somewhere_whole(spark):
    """Every run of lines that is removed is left line for line in some text."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        lines = []
        while len(lines) < 12:
            at = rng.randrange(60)
            lines += [f"line {n}" for n in range(at, at + rng.randrange(1, 6))] if rng.random() < 0.7 else [f"own {rng.random()}"]
        rows.append((i, "\n".join(lines)))
    rows += [(200, "X\nA"), (201, "X\nA\nB"), (202, "A\nB")]
    left = {r["doc_id"]: r["text"] for r in ld.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (left[200], left[201], left[202]) == ("X\nA", "A\nB", "")
    kept = ["\n" + t + "\n" for t in left.values()]
    runs = 0
    for i, text in rows:
        lines, rest = text.split("\n"), left[i].split("\n")
        pairs = set(zip(rest, rest[1:]))
        for pair in zip(lines, lines[1:]):
            if pair not in pairs:
                runs += 1
                assert any(f"\n{pair[0]}\n{pair[1]}\n" in k for k in kept) or sum(f"\n{pair[0]}\n{pair[1]}\n" in f"\n{t}\n" for _, t in rows) == 1
    assert runs > 300


def test_texts_of_one_id_are_ordered_alike(spark):
    import duckdb
    import pandas as pd

    rows = [(1, f"c{i}\nsame a\nsame b\nd{i}") for i in range(8)]
    got = ld.without_passages(spark.createDataFrame(rows, "doc_id long, text string"), removed_col="lines_removed").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert rows_of(got) == rows_of(con.execute(ld.ORACLE).fetch_df()) and (got["lines_removed"] == 0).sum() == 1


def test_passages_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["a", "b", "c", "d", "e", "f", " "]) for _ in range(rng.randrange(1, 7))) for _ in range(40)] + ["t\nt\nt\nt", "\n\n\n", "x\n"]
    want = {i: found for (i, _), found in without_later_windows(list(enumerate(texts))).items()}
    got = ld.without_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), removed_col="n").collect()
    assert {r["doc_id"]: (r["text"], r["n"]) for r in got} == want
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))
    assert {i: (t, n) for i, t, n in con.execute(ld.ORACLE).fetchall()} == want


def test_odd_rows_of_passages(spark, odd, none):
    found = ld.without_passages(odd)
    assert found.columns == odd.columns and found.count() == odd.count()
    # null ids come first, rows of one id and text are one document, of one id's texts one comes first
    rows = [(3, "a\nb\nc"), (None, "x\na\nb"), (3, "a\nb\nc"), (4, "p\nq"), (4, "q\n\np\nq"), (None, None), (5, None)]
    got = sorted((str(r["doc_id"]), r["text"], r["n"]) for r in ld.without_passages(spark.createDataFrame(rows, "doc_id long, text string"), removed_col="n").collect() if r["text"] is not None)
    assert got[:2] == [("3", "c", 2), ("3", "c", 2)] and got[4] == ("None", "x\na\nb", 0)
    assert [n for i, _, n in got if i == "4"] in ([0, 2], [2, 0])
    assert ld.without_passages(none).count() == 0
