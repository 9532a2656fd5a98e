from __future__ import annotations

import numpy as np
import pytest

from segue.sources import npy


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2", "<f2"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_rows_in_many_tasks(spark, tmp_path, dtype, order):
    matrix = np.asarray(np.arange(7001 * 6).reshape(7001, 6) % 997, dtype=dtype, order=order)
    np.save(f"{tmp_path}/m.npy", matrix)
    rows = npy.read_matrix(spark, f"{tmp_path}/m.npy", task_bytes=10_000)
    assert rows.rdd.getNumPartitions() > 8
    got = rows.orderBy("idx").toPandas()
    assert got["idx"].tolist() == list(range(7001)) and np.array_equal(np.stack(got["embedding"]), matrix.astype(np.float64))


def test_a_large_matrix_is_read_by_many_tasks(spark, tmp_path):
    np.save(f"{tmp_path}/m.npy", np.ones((1_200_000, 16), np.float32))
    rows = npy.read_matrix(spark, f"{tmp_path}/m.npy", task_bytes=4 << 20)
    assert rows.rdd.getNumPartitions() == 19 and rows.selectExpr("count(*) n", "sum(embedding[3]) s", "max(idx) m").first() == (1_200_000, 1_200_000.0, 1_199_999)


def test_second_matrix_and_bad_files(spark, tmp_path):
    one = np.arange(20, dtype=np.float32).reshape(10, 2)
    np.save(f"{tmp_path}/a.npy", one)
    np.save(f"{tmp_path}/b.npy", one * 2)
    np.save(f"{tmp_path}/c.npy", one[:9])
    np.save(f"{tmp_path}/d.npy", one.ravel())
    np.save(f"{tmp_path}/e.npy", np.zeros((0, 3)))
    (tmp_path / "f.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-4])
    (tmp_path / "g.npy").write_bytes(b"no matrix")
    both = npy.read_matrix(spark, f"file:{tmp_path}/a.npy", f"{tmp_path}/b.npy").orderBy("idx").collect()
    assert [(r["embedding"], r["embedding_norm"]) for r in both] == [(x.tolist(), (2 * x).tolist()) for x in one]
    with pytest.raises(ValueError, match="do not belong"):
        npy.read_matrix(spark, f"{tmp_path}/a.npy", f"{tmp_path}/c.npy")
    for name, what in (("d", "not a matrix"), ("f", "ends before"), ("g", "g.npy")):
        with pytest.raises(ValueError, match=what):
            npy.Header(f"{tmp_path}/{name}.npy")
    assert npy.read_matrix(spark, f"{tmp_path}/e.npy").count() == 0
