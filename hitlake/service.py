"""What an interactive front end asks for: data sets, embeddings, clusterings and single hits, as callables.

Data sets are loaded once, clusterings are kept by a signature of their parameters, and the last ones
form the history. Nothing here renders or serves anything.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.registry import all_columns, column_kinds
from .operators import clusters as C
from .operators import quality as Q
from .operators import transforms as T
from .operators.dedupe import sample as some
from .operators.explore import clean_stamp, norm_stamp
from .schema import finite
from .shared import saved
from .sources import files

#: Clusterings that are kept; colours of their own for so many clusters.
HISTORY, COLOURED = 12, 12


def signature(*parts) -> str:
    """Twelve hexadecimal digits that stand for parameters; the order of a mapping's keys plays no part."""
    return hashlib.sha1(json.dumps(list(parts), sort_keys=True).encode()).hexdigest()[:12]


@dataclass
class Dataset:
    key: str
    name: str
    df: DataFrame
    columns: list[str]
    stats: dict[str, tuple[float, float]]
    weights: dict[tuple, dict[str, float]] = field(default_factory=dict)


@dataclass
class Run:
    signature: str
    params: dict
    labels: DataFrame
    summary: DataFrame
    stats: dict
    match: dict


def dataset(name: str, df: DataFrame, sample: int = 0, seed: int = 0, columns: list[str] | None = None) -> Dataset:
    """Hits with usable features and finite values; scaling is fitted on all of them, and a seeded sample is drawn after."""
    columns = columns or [c for c in (f"{c}_n" for c in all_columns() if not c.startswith("f08_") and not c.endswith("_saturated")) if c in df.columns]
    good = F.coalesce(F.col("feature_ok"), F.lit(False)) if "feature_ok" in df.columns else F.lit(True)
    for c in columns:
        good = good & finite(c)
    whole = saved(df.where(good), "dataset")
    stats = T.robust_stats(whole, columns)
    drawn = saved(some(whole, sample, "id", seed), "sample") if sample and whole.count() > sample else whole
    return Dataset(f"{name}:{sample}:{seed}", name, drawn, columns, stats)


class Bench:
    """Data sets and clusterings of one session."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.datasets: dict[str, Dataset] = {}
        self.runs: OrderedDict[str, Run] = OrderedDict()

    def load(self, name: str, sample: int = 35_000, seed: int = 0, df: DataFrame | None = None, columns: list[str] | None = None) -> Dataset:
        """The data set of a name, from the folder of feature tables or from a table given; loaded once for each sample and seed."""
        key = f"{name}:{sample}:{seed}"
        if key not in self.datasets:
            table = df if df is not None else files.read(self.spark, files.find(self.spark, self.folder, name))
            self.datasets[key] = dataset(name, table, sample, seed, columns)
        return self.datasets[key]

    def _used(self, key: str, columns: list[str] | None) -> tuple[Dataset, list[str]]:
        if key not in self.datasets:
            raise KeyError(f"no data set {key!r}: load it")
        data = self.datasets[key]
        used = [c for c in data.columns if c in (columns or data.columns)]
        if len(used) < 2:
            raise ValueError("two columns at least: distance needs something to compare")
        return data, used

    def weights(self, key: str, scaling: str, columns: list[str] | None = None) -> dict[str, float]:
        """Weights of the columns in use, from statistics of the whole population; kept for each scaling and choice of columns."""
        data, used = self._used(key, columns)
        at = (scaling, tuple(used))
        if at not in data.weights:
            kinds = {f"{c}_n": k for c, k in column_kinds().items()}
            base = T.scale(data.df, used, "robust", stats=data.stats)
            even = T.equalising_weights(base, [f"{c}_s" for c in used], {f"{c}_s": kinds.get(c) for c in used}) if scaling == "robust-equalised" else {}
            data.weights[at] = {f"{c}_s": even.get(f"{c}_s", 1.0) for c in used}
        return data.weights[at]

    def scaled(self, key: str, scaling: str = "robust", columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
        """The data set with the scaled columns, and their names."""
        data, used = self._used(key, columns)
        df = T.scale(data.df, used, scaling, stats=data.stats if scaling.startswith("robust") else None, weights=self.weights(key, scaling, used))
        return df, [f"{c}_s" for c in used]

    def embedding(self, key: str, scaling: str = "robust", columns: list[str] | None = None) -> tuple[str, DataFrame]:
        """Signature and (id, x, y): two principal components, each from 0 to 1 as float."""
        data, used = self._used(key, columns)
        df, space = self.scaled(key, scaling, used)
        got = T.principal_components(df, space).select("id", F.col("pc1").cast("float").alias("x"), F.col("pc2").cast("float").alias("y"))
        return signature(data.key, "pca", scaling, sorted(used)), got

    def cluster(self, key: str, columns: list[str] | None = None, *, scaling: str = "robust", mode: str = "epochs", csm: str = "eom", match: bool = False, match_pct: int = 50, mcs: int = 4, ms: int = 8, epochs: int = 8, batch: int = 3000, seed: int = 0) -> Run:
        """A clustering by its parameters, computed once; (id, cluster, epoch, batch, and family where matched)."""
        data, used = self._used(key, columns)
        params = {"scaling": scaling, "mode": mode, "csm": csm, "match": match, "match_pct": match_pct, "mcs": mcs, "ms": ms, "epochs": epochs, "batch": batch, "seed": seed}
        sign = signature(data.key, sorted(used), params)
        if sign in self.runs:
            self.runs.move_to_end(sign)
            return self.runs[sign]
        df, space = self.scaled(key, scaling, used)
        options = {"min_cluster_size": mcs, "min_samples": ms, "cluster_selection_method": csm, "seed": seed}
        if mode not in ("epochs", "single"):
            raise ValueError(f"unknown mode {mode!r}")
        labels, trace = (C.cluster_single(df, space, **options), []) if mode == "single" else C.cluster_epochs(df, space, epochs=epochs, batch=batch, **options)
        info: dict = {}
        if match:
            matched, info = C.match(df.select("id", *space).join(labels, "id"), space, pct=match_pct)
            labels = matched.drop(*space)
        labels = saved(labels, "labels")
        known = data.df.join(labels, "id")
        summary = saved(C.size_rank(C.run_summary(known), COLOURED), "summary")
        stats = Q.quality(known.select("id", "frequency", "weak_label", "cluster")) | {
            "noise": labels.where("cluster = -1").count(), "confined": known.where("cluster = -1 and n_beams <= 4").count(), "n_features": len(used),
            "trace": Q.epoch_trace(trace, data.df.count()), "warning": C.warning_of(scaling, csm),
        }
        self.runs[sign] = Run(sign, params, labels, summary, stats, info)
        while len(self.runs) > HISTORY:
            self.runs.popitem(last=False)
        return self.runs[sign]

    def history(self) -> list[dict]:
        """The kept clusterings, newest first."""
        return [{"signature": r.signature, **r.params, "n_clusters": r.stats["n_clusters"], "noise": r.stats["noise"]} for r in reversed(self.runs.values())]

    def run(self, sign: str) -> Run:
        if sign not in self.runs:
            raise KeyError(f"no clustering {sign!r}")
        return self.runs[sign]

    def labels(self, sign: str, by: str = "cluster") -> DataFrame:
        """(id, label, rank): what to colour a point by; the largest clusters have ranks from 0, others null."""
        run = self.run(sign)
        if by == "family":
            if "family" not in run.labels.columns:
                raise ValueError("this clustering was not matched")
            sizes = C.size_rank(C.sizes(run.labels, "family"), COLOURED, "family")
        else:
            sizes = run.summary.select("cluster", "rank", "coloured")
        ranks = sizes.where("coloured").select(F.col(by).alias("label"), "rank")
        return run.labels.select("id", F.col(by).alias("label")).join(F.broadcast(ranks), "label", "left").select("id", "label", "rank")  # COLOURED rows

    def values(self, key: str, column: str) -> DataFrame:
        """(id, value): a column of the data set to colour points by."""
        if key not in self.datasets or column not in self.datasets[key].df.columns:
            raise KeyError(f"no column {column!r} of {key!r}")
        return self.datasets[key].df.select("id", F.col(column).alias("value"))

    def hit(self, key: str, hit: int, sign: str | None = None) -> dict:
        """All that is known of one hit, and its cluster in a clustering."""
        rows = self.datasets[key].df.where(F.col("id") == hit).limit(1).collect()
        if not rows:
            raise KeyError(f"no hit {hit}")
        found = rows[0].asDict()
        if sign is not None:
            found |= next((r.asDict() for r in self.run(sign).labels.where(F.col("id") == hit).limit(1).collect()), {})
        return files.strict(found)

    def stability(self, key: str, seeds: tuple[int, ...] = (0, 1, 2), by: str = "cluster", **options) -> dict:
        """Agreement of clusterings that differ in their seed alone."""
        runs = [self.cluster(key, seed=s, **options) for s in seeds]
        return Q.stability([r.labels.select("id", F.col(by).alias("cluster")) for r in runs])


def stamp(cutouts: DataFrame, file: str, row: int) -> list | None:
    """One cutout, made ready for display: without padding, over its median. None where it can't be read."""
    found = cutouts.where((F.col("file") == file) & (F.col("row") == row) & F.col("img").isNotNull())
    found = found.withColumn("img", clean_stamp(F.col("img"))["img"]).select(norm_stamp(F.col("img")).alias("img")).limit(1).collect()
    return found[0]["img"] if found else None
