"""Arrays by ranges of bytes against NumPy and against the reader of whole files."""

from __future__ import annotations

import numpy as np
import pytest

from flowloom.sources import arrays, files


def test_a_large_array_is_many_tasks_work(spark, tmp_path):
    rng = np.random.default_rng(0)
    big = rng.normal(size=(200_000, 7)).astype("f4")
    np.save(tmp_path / "big.npy", big)
    np.save(tmp_path / "cube.npy", rng.integers(0, 9, (5, 2, 3)).astype(">i2"))
    np.save(tmp_path / "line.npy", np.arange(4.0))
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    np.save(tmp_path / "number.npy", np.float64(7))
    df = arrays.read_arrays(spark, str(tmp_path), part_bytes=1 << 20)
    assert df.rdd.getNumPartitions() >= 6
    name = lambda p: p.rsplit("/", 1)[-1]
    got = {(name(r.path), r.row): list(r["values"]) for r in df.collect()}
    want = {(name(r.path), r.row): list(r["values"]) for r in files.read_npy(spark, f"file://{tmp_path}").collect()}
    assert got == want and len(got) == 200_000 + 5 + 4 + 1
    assert np.allclose(got["big.npy", 123_456], big[123_456])


def test_what_cannot_be_read_in_ranges_is_told(tmp_path):
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(ValueError, match="stored by columns"):
        arrays.ArrayReader(str(tmp_path), ".npy", 1 << 20).partitions()
    np.save(tmp_path / "cut.npy", np.ones((100, 4)))
    whole = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-8])
    with pytest.raises(ValueError, match="shorter"):
        arrays.ArrayReader(str(tmp_path / "cut.npy"), ".npy", 1 << 20).partitions()
    parts = arrays.ArrayReader(str(tmp_path / "ok.npy"), ".npy", 64)
    np.save(tmp_path / "ok.npy", np.arange(100.0).reshape(50, 2))
    assert [(p.first, p.end) for p in parts.partitions()] == [(4 * i, min(4 * i + 4, 50)) for i in range(13)]
