"""Cubes of cutouts on disk: which rows can be read, reading them, and a Spark data source over them.

A cube is anything that has a length and gives a row for a number and rows for a slice: a mapped .npy
file, or a dataset of an HDF5 file (h5py, which isn't installed where this is tested). Broken regions raise when they
are read. So blocks are probed at both ends first, a batch that fails is read row by row, and a row
that can't be read comes out with stamp_ok false, never as an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PROBE, BATCH, SPREAD = 2000, 4096, 4


def scan_bad_regions(data, n: int, probe: int = PROBE) -> tuple[np.ndarray, int]:
    """Rows expected to be readable, and how many blocks aren't: those whose first or last row can't be read, as a whole."""
    ok, bad = np.ones(n, bool), 0
    for start in range(0, n, probe):
        end = min(start + probe, n)
        if not (_read(data, start) and _read(data, end - 1)):
            ok[start:end] = False
            bad += 1
    return ok, bad


def _read(data, row: int) -> list:
    """The row in a list, or an empty list."""
    try:
        return [np.asarray(data[row])]
    except (OSError, ValueError, RuntimeError):
        return []


def contiguous(rows: np.ndarray) -> bool:
    """Whether one slice is the cheaper read: sorted rows that span SPREAD times their number at most."""
    return len(rows) > 0 and int(rows[-1]) - int(rows[0]) + 1 <= SPREAD * len(rows)


def read_rows(data, rows: np.ndarray, batch: int = BATCH):
    """(row, cutout or None) for each of the sorted rows, in batches: a slice or the rows named; one by one where that fails."""
    for at in range(0, len(rows), batch):
        some = np.asarray(rows[at : at + batch])
        try:
            if contiguous(some):
                start = int(some[0])
                got = np.asarray(data[start : int(some[-1]) + 1])[some - start]
            else:
                got = np.asarray(data[some])
            yield from zip(some.tolist(), got, strict=True)
        except (OSError, ValueError, RuntimeError):
            for row in some.tolist():
                yield row, next(iter(_read(data, row)), None)


def opened(path: str, name: str = "data"):
    """The cube of a .npy file, or of an HDF5 file's dataset."""
    if path.endswith(".npy"):
        return np.load(path, mmap_mode="r")
    import h5py

    return h5py.File(path)[name]


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class CubeReader(DataSourceReader):
    def __init__(self, path: str, probe: int, rows: int):
        self.path, self.probe, self.rows = path, probe, rows

    def partitions(self) -> list[Rows]:
        n = len(opened(self.path))
        return [Rows(a, min(a + self.rows, n)) for a in range(0, n, self.rows)]

    def read(self, part: Rows):
        data, file = opened(self.path), self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        n = part.stop - part.start

        class Part:
            def __getitem__(self, row: int):
                return data[part.start + row]

        ok, _ = scan_bad_regions(Part(), n, self.probe)
        for row in (np.flatnonzero(~ok) + part.start).tolist():
            yield file, row, False, None
        for row, cutout in read_rows(data, np.flatnonzero(ok) + part.start):
            image = None if cutout is None else cutout.reshape(cutout.shape[-2:]).astype(float).tolist()
            yield file, row, image is not None, image


class CubeSource(DataSource):
    """spark.read.format("cubes").load(path): (file, row, stamp_ok, img). Options: probe, and rows of a partition.

    Cutouts of (1, time, channel) lose their first axis. The file must be one that executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "cubes"

    def schema(self) -> str:
        return "file string, row long, stamp_ok boolean, img array<array<double>>"

    def reader(self, schema) -> CubeReader:
        return CubeReader(self.options["path"], int(self.options.get("probe", PROBE)), int(self.options.get("rows", 25 * BATCH)))
