"""Raw hit files (HDF5, one dataset a column, one cube) as a Spark data source.

Needs h5py on the executors, which this repository's tests don't have: the Parquet path is the
tested one. Convert once with spark.read.format("hits_hdf5").load(path).write.parquet(...).
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import HITS

ROWS = 100_000


class Block(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class HitsReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Block]:
        import h5py

        out = []
        for path in self.paths:
            with h5py.File(path) as f:
                n = len(f["id"])
            out += [Block(path, a, min(a + ROWS, n)) for a in range(0, n, ROWS)]
        return out

    def read(self, part: Block):
        import h5py

        with h5py.File(part.path) as f:
            names = [c.name for c in HITS if c.name in f]
            values = {n: f[n][part.start : part.stop] for n in names}
        file = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        plain = lambda v: v.decode() if isinstance(v, bytes) else v.item() if hasattr(v, "item") else v
        for i in range(part.stop - part.start):
            row = {n: plain(v[i]) for n, v in values.items()} | {"row": part.start + i, "file": file}
            yield tuple(row.get(c.name) for c in HITS)


class HitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hits_hdf5"

    def schema(self):
        return HITS

    def reader(self, schema) -> HitsReader:
        return HitsReader([self.options["path"]])
