import numpy as np
import pytest

from hitlake.sources import cubes


class Broken:
    """A cube whose rows from 30 to 44, and row 71, can't be read."""

    def __init__(self, n=100):
        self.rows = np.arange(n * 6.0).reshape(n, 1, 2, 3)

    def __len__(self):
        return len(self.rows)

    def __getitem__(self, at):
        rows = range(*at.indices(len(self.rows))) if isinstance(at, slice) else np.atleast_1d(at).tolist()
        if any(30 <= r <= 44 or r == 71 for r in rows):
            raise OSError("bad region")
        return self.rows[at]


def test_regions_are_probed_by_blocks():
    ok, bad = cubes.scan_bad_regions(Broken(), 100, 10)
    assert bad == 2 and np.flatnonzero(~ok).tolist() == list(range(30, 50)), "blocks are left out whole; row 71 lies inside one"
    assert cubes.scan_bad_regions(Broken(), 100, 1)[1] == 16
    assert cubes.scan_bad_regions(Broken(0), 0)[1] == 0


@pytest.mark.parametrize("rows", [list(range(60, 80)), [0, 5, 71, 99], [50]])
def test_rows_come_one_by_one_where_a_batch_fails(rows):
    cube = Broken()
    got = dict(cubes.read_rows(cube, np.array(rows), 8))
    assert list(got) == rows
    assert all((got[r] is None) == (r == 71) and (r == 71 or (got[r] == cube.rows[r]).all()) for r in rows)


def test_a_slice_is_read_where_rows_lie_close():
    assert cubes.contiguous(np.array([3, 5, 9])) and not cubes.contiguous(np.array([0, 500])) and not cubes.contiguous(np.array([]))


def test_source(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/one.npy"
    np.save(path, np.arange(5 * 6.0).reshape(5, 1, 2, 3))
    spark.dataSource.register(cubes.CubeSource)
    rows = spark.read.format("cubes").option("rows", 2).load(path).orderBy("row").collect()
    assert [(r.file, r.row, r.stamp_ok) for r in rows] == [("one", k, True) for k in range(5)]
    assert rows[1].img == [[6.0, 7.0, 8.0], [9.0, 10.0, 11.0]]
    monkeypatch.setattr(cubes, "opened", lambda path, name="data": Broken())
    reader = cubes.CubeReader("/x/broken.npy", 10, 40)
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(got) == 100 and sorted(r[1] for r in got if not r[2]) == [*range(30, 50), 71]
    assert all(r[3] is None for r in got if not r[2])
