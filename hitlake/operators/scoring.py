"""Weakly supervised scores: out-of-group cross-validation, exact ranking metrics, catalogues, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import all_columns
from ..functions.running import running_sums
from ..functions.scalars import binned, half_even, half_even_at
from ..schema import FLAGS, finite
from ..shared import saved
from . import boosting
from .ranks import quantiles

#: Right-closed bins of the beam count, with an edge where labels begin.
BEAM_EDGES = [0, 1, 2, 3, 5, 9, 17, 31, 32, 49, 65]
#: Fixed value: files whose hits were selected before they were delivered; their labels don't mean what they mean elsewhere.
PREFILTERED = ("mk_sample_hits",)
THRESHOLDS = (0.02, 0.05, 0.10, 0.20, 0.30, 0.50, 0.70, 0.90)


def feature_sets() -> dict[str, list[str]]:
    """Columns by name of the set; none of them is part of a label."""
    stamp = [f"{c}_n" for c in all_columns("cutout") if not c.endswith("_saturated")]
    meta = [f"{c}_n" for c in all_columns("catalogue")]
    return {"stamp": stamp, "meta": meta, "all": stamp + meta, "flags": [f for f in FLAGS if f not in ("flag_multibeam", "flag_incoherent")]}


def feature_columns(name: str) -> list[str]:
    sets = feature_sets()
    if name not in sets:
        raise ValueError(f"unknown feature set {name!r}; one of {sorted(sets)}")
    return sets[name]


def roc_auc(df: DataFrame, y: str = "y", s: str = "s", by: list[str] = ()) -> DataFrame:
    """auc by group, from tie-averaged ranks; null without both classes.

    Rows are first condensed to one a score, so ranks are running sums over distinct scores.
    """
    per = df.groupBy(*by, s).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) != 1).cast("long")).alias("n"))
    got = running_sums(per, s, ["n"], list(by)).withColumn("_won", F.col("p") * (F.col("before_n") + F.col("n") / 2))
    auc = (F.sum("_won") / F.when(F.sum("p") * F.sum("n") > 0, F.sum("p") * F.sum("n"))).alias("auc")
    return got.groupBy(*by).agg(auc) if by else got.agg(auc)


def average_precision(df: DataFrame, y: str = "y", s: str = "s", by: list[str] = ()) -> DataFrame:
    """ap by group: precision at each distinct score, weighted by the recall it adds."""
    per = df.groupBy(*by, s).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.count("*").alias("k"))
    got = running_sums(per, s, ["p", "k"], list(by), descending=True)
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_k") + F.col("k"))
    ap = (F.sum(F.col("p") * precision) / F.when(F.sum("p") > 0, F.sum("p"))).alias("ap")
    return got.groupBy(*by).agg(ap) if by else got.agg(ap)


def group_metrics(df: DataFrame, by: list[str], y: str = "y", s: str = "s") -> DataFrame:
    """(by, n, base_rate, auc): of files, of bands."""
    facts = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(y) == 1).cast("double")).alias("base_rate"))
    auc = roc_auc(df, y, s, by)
    return facts.join(auc.select(*(F.col(c).alias(f"_{c}") for c in by), "auc"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*(f"_{c}" for c in by))


def ablation(df: DataFrame, scores: dict[str, str], y: str = "y") -> DataFrame:
    """(features, n, roc_auc, pr_auc): what each set of features is worth, from the columns that hold its scores."""
    rows = df.select(y, F.inline(F.array(*(F.struct(F.lit(name).alias("features"), F.col(c).cast("double").alias("s")) for name, c in scores.items()))))
    n = rows.groupBy("features").agg(F.count("*").alias("n"))
    return n.join(roc_auc(rows, y, "s", ["features"]), "features").join(average_precision(rows, y, "s", ["features"]), "features").select("features", "n", F.col("auc").alias("roc_auc"), F.col("ap").alias("pr_auc"))


def _in_files(files: tuple[str, ...], df: DataFrame) -> Column:
    return F.coalesce(F.col("file").isin(*files), F.lit(False)) if files and "file" in df.columns else F.lit(False)


def evaluation_rows(df: DataFrame, prefiltered: tuple[str, ...] = PREFILTERED) -> DataFrame:
    """The rows that a reported figure may be computed over: labelled, and of a file that may be trained on."""
    return df.where((F.col("weak_label") >= 0) & ~_in_files(prefiltered, df))


def ood_block(df: DataFrame, score: str = "rfi_score", prefiltered: tuple[str, ...] = PREFILTERED) -> DataFrame:
    """One row: what becomes of labelled hits of files that were selected beforehand, and AUC with them."""
    known = df.where("weak_label >= 0").withColumns({"y": F.col("weak_label").cast("int"), "s": F.col(score)})
    out = known.where(_in_files(prefiltered, df)).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_positive"), F.avg("s").alias("mean_score"), F.avg((F.col("s") > 0.5).cast("double")).alias("frac_scored_rfi"))
    return out.crossJoin(roc_auc(known).withColumnRenamed("auc", "auc_including_it"))  # single rows


def quantile_bins(df: DataFrame, column: str, q: int = 10) -> tuple[Column, list[float]]:
    """Right-closed bins at quantiles, repeated edges dropped; the first holds its lower edge."""
    edges = sorted(set(quantiles(df, {column: column}, [k / q for k in range(q + 1)])[column] or [0.0, 1.0]))
    return F.when(F.col(column) == edges[0], 0).otherwise(binned(F.col(column), edges)), edges


def deciles(df: DataFrame, column: str, y: str = "y", s: str = "s", q: int = 10) -> DataFrame:
    """(bin, n, low, high, base_rate, auc) by quantile of a column."""
    bins, _ = quantile_bins(df, column, q)
    df = df.withColumn("bin", bins)
    facts = df.groupBy("bin").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg((F.col(y) == 1).cast("double")).alias("base_rate"))
    return facts.join(roc_auc(df, y, s, ["bin"]), "bin")


def beam_bins(df: DataFrame, s: str = "s", edges: list[int] = BEAM_EDGES) -> DataFrame:
    """(bin, low, high, n, mean, median) of the score by beam count, and whether means grow from bin to bin."""
    got = df.withColumn("bin", binned(F.col("n_beams"), edges)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"))
    ends = lambda k: F.array(*map(F.lit, edges))[F.col("bin") + k]
    return got.select("bin", ends(0).alias("low"), ends(1).alias("high"), "n", "mean", "median", (F.col("mean") > F.lag("mean").over(Window.orderBy("bin"))).alias("grows"))


def signal_level(df: DataFrame, y: str = "y", s: str = "s", group: str = "group_id") -> DataFrame:
    """Hits of one signal as one row: the same group, coarse channel, frequency to 1 Hz and drift to 4 places."""
    keys = [F.col(group), F.col("coarseChannel"), half_even(F.col("frequency") * 1e6).alias("f_hz"), half_even_at(F.col("driftRate"), 4).alias("drift")]
    return df.groupBy(*keys).agg(F.max(y).alias("y"), F.median(s).alias("s"), F.count("*").alias("n_hits"))


def catalogues(df: DataFrame, score: str = "rfi_score", shortlist_below: float = 0.1, pruned_above: float = 0.9) -> dict[str, DataFrame]:
    """Candidates with their verdicts, hits that contradict their label, and ambiguous ones; lowest score first."""
    verdict = F.when(F.col(score) < shortlist_below, "shortlist").when(F.col(score) > pruned_above, "pruned").otherwise("uncertain")
    df = df.withColumn("verdict", verdict)
    order = (score, "id")
    return {
        "candidates": df.where("pass_all").orderBy(*order), "contrarian": df.where((F.col("n_beams") >= 32) & (F.col(score) < shortlist_below)).orderBy(*order),
        "ambiguous": df.where((F.col("n_beams") > 2) & (F.col("n_beams") < 32)).orderBy(*order),
    }


def threshold_sweep(scored: DataFrame, real: DataFrame, score: str = "rfi_score", thresholds: tuple[float, ...] = THRESHOLDS, keep_below: bool = True) -> DataFrame:
    """(threshold, retained, n_shortlist, shortlist_frac, retained_per_admitted); one pass over each side."""
    kept = (lambda t: F.col(score) < t) if keep_below else (lambda t: F.col(score) > t)
    a = scored.agg(*(F.avg(kept(t).cast("double")).alias(f"r{k}") for k, t in enumerate(thresholds)))
    b = real.agg(F.count("*").alias("n"), *(F.count_if(kept(t)).alias(f"n{k}") for k, t in enumerate(thresholds)))
    rows = []
    for k, t in enumerate(thresholds):
        share = F.col(f"n{k}") / F.greatest(F.col("n"), F.lit(1))
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{k}").alias("retained"), F.col(f"n{k}").alias("n_shortlist"), share.alias("shortlist_frac"), (F.col(f"r{k}") / F.greatest(share, F.lit(1e-9))).alias("retained_per_admitted")))
    return a.crossJoin(b).select(F.inline(F.array(*rows)))  # single rows


def group_folds(df: DataFrame, group: str = "group_id", n_splits: int = 5, most: int = 1_000_000) -> dict:
    """Fold of each group: the largest group goes to the lightest fold, ties to the first by name. One row a group on the driver."""
    rows = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    if len(rows) < n_splits:
        raise ValueError(f"{len(rows)} groups can't make {n_splits} folds")
    weight, fold = [0] * n_splits, {}
    for r in rows:
        k = weight.index(min(weight))
        fold[r[group]] = k
        weight[k] += r["n"]
    return fold


def _with_fold(df: DataFrame, folds: dict, group: str) -> DataFrame:
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(list(folds.items()), f"{group} {kind}, fold int")
    return df.join(table, group, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def fold_models(df: DataFrame, features: list[str], *, n_splits: int = 5, seed: int = 0, n_seeds: int = 3, max_iter: int = 300, group: str = "group_id", prefiltered: tuple[str, ...] = PREFILTERED) -> tuple[dict[int, list], dict]:
    """Boosted trees for each fold, trained on evaluation rows of the other folds; and the fold of each group."""
    if n_seeds < 1:
        raise ValueError("n_seeds must be 1 or more")
    if {"weak_label", "n_beams_n", "beam_frac_n"} & set(features):
        raise ValueError("a feature gives the label away")
    known = evaluation_rows(df, prefiltered)
    if known.select("weak_label").distinct().count() < 2:
        raise ValueError("labels of both classes are needed")
    folds = group_folds(known, group, n_splits)
    ready = _with_fold(known, folds, group).withColumn("label", F.col("weak_label"))
    return boosting.fit(ready, features, n_splits, list(range(seed, seed + n_seeds)), max_iter), folds


def predict_held_out(models: dict[int, list], folds: dict, df: DataFrame, features: list[str], group: str = "group_id", default_fold: int = 0) -> DataFrame:
    """rfi_score of each row by the models that haven't seen its group; fold_used is negative where no fold has the group."""
    names, none = df.columns, F.col("fold") == -1
    df = _with_fold(df, folds, group)
    used = F.when(none, default_fold).otherwise(F.col("fold"))
    return df.select(*names, boosting.score(df, models, features, used).alias("rfi_score"), F.when(none, -1 - default_fold).otherwise(F.col("fold")).alias("fold_used"))


def fit_score(df: DataFrame, features: list[str], *, n_splits: int = 5, seed: int = 0, n_seeds: int = 3, max_iter: int = 300, group: str = "group_id", prefiltered: tuple[str, ...] = PREFILTERED) -> DataFrame:
    """rfi_score: evaluation rows by the models that haven't seen their group, all others by the mean of all models."""
    df = _spread(saved(df, "scored"))
    names, features = df.columns, _present(df, features)
    if not features:
        raise ValueError("no feature has a finite value")
    models, folds = fold_models(df, features, n_splits=n_splits, seed=seed, n_seeds=n_seeds, max_iter=max_iter, group=group, prefiltered=prefiltered)
    own = F.coalesce((F.col("weak_label") >= 0) & ~_in_files(prefiltered, df), F.lit(False))
    df = _with_fold(df, folds, group)
    return df.select(*names, boosting.score(df, models, features, F.when(own, F.col("fold"))).alias("rfi_score"))


def band_holdout(df: DataFrame, features: list[str], band: Column, *, seed: int = 0, n_seeds: int = 1, max_iter: int = 300, prefiltered: tuple[str, ...] = PREFILTERED, most: int = 64) -> DataFrame:
    """Evaluation rows with `band` and rfi_score by models that were trained on the other bands alone.

    Bands without labels of both classes among the others are left out; rows without a band take no part.
    """
    known = saved(evaluation_rows(df, prefiltered).withColumn("band", band).where("band is not null"), "bands")
    counts = known.groupBy("band").agg(F.count_if(F.col("weak_label") == 1).alias("p"), F.count_if(F.col("weak_label") != 1).alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} bands")
    p, n = sum(r.p for r in counts), sum(r.n for r in counts)
    bands = sorted(r.band for r in counts if p > r.p and n > r.n)
    if not bands:
        return known.where("false").withColumn("rfi_score", F.lit(None).cast("double"))
    number = F.lit(len(bands))  # bands that aren't held out teach all models
    for k, b in enumerate(bands):
        number = F.when(F.col("band") == b, k).otherwise(number)
    models = boosting.fit(known.withColumns({"label": F.col("weak_label"), "fold": number}), features, len(bands), list(range(seed, seed + n_seeds)), max_iter)
    held = known.where(F.col("band").isin(bands))
    return held.withColumn("rfi_score", boosting.score(held, models, features, number))


def _spread(stored: DataFrame) -> DataFrame:
    """A stored table in as many partitions as there are cores at least: a small file is one, and scoring is all computation."""
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored if stored.rdd.getNumPartitions() >= cores else stored.repartition(cores)


def _present(df: DataFrame, features: list[str]) -> list[str]:
    """Features with any finite value."""
    row = df.agg(*(F.count_if(finite(c)).alias(c) for c in features)).first()
    return [c for c in features if row[c]]


def permutation_importance(models: dict[int, list], folds: dict, df: DataFrame, features: list[str], repeats: int = 3, sample: int = 20_000, seed: int = 0) -> list[tuple[str, float]]:
    """How much AUC falls when a feature is dealt anew over a bounded sample of one fold."""
    from .dedupe import sample as some
    from .quality import shuffled

    part = some(_with_fold(df.where("weak_label >= 0"), folds, "group_id").where("fold = 0").select("id", "group_id", "weak_label", *features), sample, "id", seed)
    part = saved(part, "importance")
    auc = lambda d: roc_auc(predict_held_out(models, folds, d, features), "weak_label", "rfi_score").first()[0] or 0.0
    base, out = auc(part), []
    for c in features:
        falls = [base - auc(shuffled(part, c, seed + 1 + r)) for r in range(repeats)]
        out.append((c, sum(falls) / len(falls)))
    return out


def validate(df: DataFrame, score: str = "rfi_score", *, sets: dict[str, str] | None = None, band: Column | None = None, features: list[str] | None = None, prefiltered: tuple[str, ...] = PREFILTERED, **options) -> dict:
    """The report of a score over evaluation rows: each block rules out one dull reason for a good figure.

    sets: columns that hold the scores of feature sets, for the ablation. With a band and features, models are
    trained anew with each band held out. Files that were selected beforehand appear in `ood` alone.
    """
    known = evaluation_rows(df, prefiltered).select("*", F.col("weak_label").cast("int").alias("y"), F.col(score).alias("s"))
    one = lambda d: d.first()[0]
    rows = lambda d: [r.asDict() for r in d.collect()]
    parts = deciles(known, "snr").collect()
    fair = [r for r in parts if r.auc is not None]
    drifting, signals = known.where("driftRate != 0"), signal_level(known)
    of_signals = signals.agg(F.count("*").alias("n"), F.avg("n_hits").alias("rows"), F.count_if(F.col("n_hits") == 1).alias("single")).first()
    report = {
        "n_rows": df.count(), "n_evaluated": known.count(), "prefiltered": list(prefiltered), "base_rate": one(known.agg(F.avg("y"))),
        "roc_auc": one(roc_auc(known)), "pr_auc": one(average_precision(known)), "roc_auc_nonzero_drift": one(roc_auc(drifting)),
        "ablation": {r.features: {"roc_auc": r.roc_auc, "pr_auc": r.pr_auc} for r in ablation(known, sets).collect()} if sets else {},
        "nonzero_drift": {"n": drifting.count()} | {name: one(roc_auc(drifting, "y", c)) for name, c in (sets or {"score": "s"}).items()},
        "within_snr": {"bins": [r.asDict() for r in parts], "weighted_auc": sum(r.n * r.auc for r in fair) / sum(r.n for r in fair) if fair else float("nan")},
        "signal_level_auc": one(roc_auc(signals)),
        "signal_level": {"n_signals": of_signals.n, "rows_per_signal": of_signals.rows, "n_singletons": of_signals.single, "singleton_auc": one(roc_auc(signals.where("n_hits = 1")))},
        "per_file": {r["file"]: r["auc"] for r in roc_auc(known, by=["file"]).collect()} if "file" in df.columns else {},
        "files": rows(group_metrics(known, ["file"])) if "file" in df.columns else [],
        "n_beams": rows(beam_bins(df.withColumn("s", F.col(score))).orderBy("bin")),
    }
    ood = ood_block(df, score, prefiltered).first()
    if ood.n:
        report["ood"] = ood.asDict()
    if band is not None:
        held = band_holdout(df, features, band, prefiltered=prefiltered, **options).withColumn("y", F.col("weak_label").cast("int"))
        report["cross_band"] = {r.band: {"n_test": r.n, "base_rate": r.base_rate, "auc": r.auc} for r in group_metrics(held, ["band"], "y", "rfi_score").collect()}
    return report
