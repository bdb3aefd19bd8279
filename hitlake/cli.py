"""Commands over Parquet tables of hits: python -m hitlake.cli COMMAND --help.

Each is a thin cover of the operators, with their parameters and defaults.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import masks as M
from .functions import registry as R
from .functions.arrays import crop_fill
from .operators import clusters as C
from .operators import dedupe as D
from .operators import flags as O
from .operators import injection as I
from .operators import quality as Q
from .operators import scoring as S
from .operators.tables import combined_summary
from .operators import transforms as T
from .sources import files
from .workspace import resolve, resolve_files, stage_folder


def _options(p: argparse.ArgumentParser, defaults: dict) -> None:
    for name, value in defaults.items():
        flag = "--" + name.replace("_", "-")
        if isinstance(value, bool):
            p.add_argument(flag, action="store_true")
        else:
            p.add_argument(flag, type=type(value), default=value)


#: Defaults of the commands.
FLAGS = {"snr_min": 10.0, "snr_min_short": 15.0, "short_timesteps": 16, "snr_max": 1e6, "tol_hz": 0.0, "tol_steps": 1, "max_drift_coeff": 0.0, "max_beams": 4, "n_ants": 62, "coh_ratio_tol": 2.0, "min_obs": 5, "repeat_tol_hz": 10.0, "repeat_tol_steps": 1}
MASKS = {"no_itu": False, "dtv": False, "mask_bin_hz": 100.0, "mask_min_beams": 32, "mask_min_obs": 3}
CLUSTER = {"epochs": 8, "batch": 3000, "min_cluster_size": 4, "min_samples": 8, "cluster_selection_method": "eom", "seed": 0}
SCORE = {"folds": 5, "seed": 0, "seeds": 3, "max_iter": 300, "shortlist_below": 0.1, "pruned_above": 0.9}


def tolerance(df: DataFrame) -> float:
    """One channel of the catalogue in Hz; 1 where it doesn't say."""
    if "foff" not in df.columns:
        return 1.0
    row = df.where("foff is not null").select(F.abs("foff") * 1e6).first()
    return row[0] if row else 1.0


def flag(spark: SparkSession, args: argparse.Namespace, out) -> None:
    for path in resolve_files(args.files, args.root):
        df, name = spark.read.parquet(str(path)), path.stem
        if args.incoherent_power:
            df = O.external_incoherent(df, files.read_any(spark, args.incoherent_power))
        masks = M.mask_table(itu=not args.no_itu, tv=args.dtv)
        if args.derive_mask:
            found = O.derive_mask(df, args.mask_bin_hz, args.mask_min_beams, args.mask_min_obs)
            files.write_csv(found, f"{out}/{name}_mask.csv")
            masks = [*masks, *M.read_masks(spark, f"{out}/{name}_mask.csv")]
        options = {k: getattr(args, k) for k in FLAGS}
        options["tol_hz"] = options["tol_hz"] or tolerance(df)
        O.flag_all(df, masks, **options).write.mode("overwrite").parquet(f"{out}/{name}_cat.parquet")
        flagged = spark.read.parquet(f"{out}/{name}_cat.parquet")
        files.write_csv(O.cutflow(flagged).drop("step"), f"{out}/{name}_cutflow.csv")
        files.write_csv(O.survivors(flagged), f"{out}/{name}_survivors.csv")
        O.cutflow(flagged).show(truncate=False)
        O.survivors(flagged).show(args.show)


def features(spark: SparkSession, args: argparse.Namespace, out) -> None:
    """Catalogues with a column img of cutouts; and the combined table of what this call was given."""
    made = []
    for path in resolve_files(args.files, args.root):
        df = spark.read.parquet(str(path))
        if "img" in df.columns:
            df = df.withColumn("img", crop_fill(F.col("img"), F.col("numChannels"), args.crop))
            readable = F.col("img").isNotNull()  # a region that can't be read has no cutout
            df = df.withColumn("stamp_ok", F.coalesce("stamp_ok", F.lit(False)) & readable if "stamp_ok" in df.columns else readable)
            df = R.with_cutout_features(R.with_catalogue_features(df), args.crop, tolerance(df)).drop("img")
        else:
            df = R.with_catalogue_features(df).withColumns({"stamp_ok": F.lit(False), "feature_ok": F.lit(False)})
        df = O.weak_labels(T.normalise(df)[0], args.rfi_beams, args.clean_beams, args.require_pass_all)
        to = f"{out}/{files.filename(path.stem.removesuffix('_cat'), args.method)}"
        files.write(D.deduplicate(df, ["id"]), to)
        made.append(spark.read.parquet(to))
    whole = D.combine(made)
    files.write(whole, f"{out}/{files.filename('all', args.method)}")
    combined_summary(whole, [c for c in R.all_columns() if c in whole.columns], "group_id" if "group_id" in whole.columns else "file").show(60, truncate=False)


def cluster(spark: SparkSession, args: argparse.Namespace, out) -> None:
    df = spark.read.parquet(str(resolve_files([args.file], args.root)[0])).where("feature_ok")
    columns = [c for c in (f"{c}_n" for c in R.all_columns() if not c.startswith("f08_") and not c.endswith("_saturated")) if c in df.columns]
    kinds = {f"{c}_n": k for c, k in R.column_kinds().items()}
    if args.report:
        Q.column_audit(df, columns, kinds, args.scaling, args.min_samples).show(50, truncate=False)
        return
    if said := C.warning_of(args.scaling, args.cluster_selection_method):
        print(f"warning: {said}")
    scaled = T.scale(df, columns, args.scaling, kinds=kinds)
    space = [f"{c}_s" for c in columns]
    labels, trace = C.cluster_epochs(scaled, space, **{k: getattr(args, k) for k in CLUSTER})
    got = scaled.join(labels, "id")
    report = {"trace": Q.epoch_trace(trace, scaled.count())}
    if args.match:
        got, info = C.match(got, space, cut=args.match_cut, pct=args.match_pct, n_families=args.match_families)
        report["match"] = info
        named = C.name_families(got, M.band_of(F.col("frequency")))
        files.write_csv(named, f"{out}/{args.tag}_families.csv")
        files.write_csv(C.candidate_hits(got, named).select("id", "family", "frequency", "snr").orderBy(F.desc("snr"), "id"), f"{out}/{args.tag}_candidates.csv")
    got.drop(*space).write.mode("overwrite").parquet(f"{out}/{args.tag}_clusters.parquet")
    got = spark.read.parquet(f"{out}/{args.tag}_clusters.parquet")
    files.write_csv(C.cluster_summary(got), f"{out}/{args.tag}_summary.csv")
    files.write_csv(C.interesting(got).select("id", "frequency", "driftRate", "snr", "n_beams"), f"{out}/{args.tag}_interesting.csv")
    files.write_json(report | {"quality": Q.quality(got)}, f"{out}/{args.tag}_metrics.json")


def score(spark: SparkSession, args: argparse.Namespace, out) -> None:
    df = spark.read.parquet(str(resolve_files([args.file], args.root)[0]))
    wanted = [c for c in S.feature_columns(args.features) if c in df.columns]
    got = S.fit_score(df, wanted, n_splits=args.folds, seed=args.seed, n_seeds=args.seeds, max_iter=args.max_iter)
    got.write.mode("overwrite").parquet(f"{out}/{args.tag}all_scores.parquet")
    got = spark.read.parquet(f"{out}/{args.tag}all_scores.parquet")
    for name, part in S.catalogues(got, shortlist_below=args.shortlist_below, pruned_above=args.pruned_above).items():
        files.write_csv(part.select("id", "obsid", "frequency", "driftRate", "snr", "n_beams", "rfi_score", "verdict"), f"{out}/{args.tag}{name}.csv")
    sets = {}
    for name in S.feature_sets() if args.ablation else ():
        part = [c for c in S.feature_columns(name) if c in df.columns]
        if part and name != args.features:
            own = S.fit_score(df, part, n_splits=args.folds, seed=args.seed, n_seeds=args.seeds, max_iter=args.max_iter).select("id", F.col("rfi_score").alias(f"score_{name}"))
            got, sets = got.join(own, "id"), sets | {name: f"score_{name}"}
    sets |= {args.features: "rfi_score"}
    held = {"band": M.band_of(F.col("frequency")), "features": wanted, "seed": args.seed, "n_seeds": args.seeds, "max_iter": args.max_iter} if args.ablation else {}
    files.write_json({"validation": S.validate(got, sets=sets, **held)}, f"{out}/{args.tag}report.json")


def inject(spark: SparkSession, args: argparse.Namespace, out) -> None:
    """Catalogues with a column img, and the feature table they belong to: signals of known strength, scored."""
    table = spark.read.parquet(str(resolve_files([args.table or str(stage_folder(args.root, "features") / files.filename("all"))], args.root)[0]))
    raw = [c for c in R.all_columns("cutout") if f"{c}_n" in table.columns and not c.endswith("_saturated")]
    models, folds = S.fold_models(table, [f"{c}_n" for c in raw], n_splits=args.folds, seed=args.seed, n_seeds=args.seeds, max_iter=args.max_iter)
    made = None
    for path in resolve_files(args.files, args.root):
        df = spark.read.parquet(str(path))
        shape = df.where("img is not null").select(F.size("img").alias("steps"), F.abs("foff").alias("foff"), "tsamp").first()
        df = df.withColumns({"img": crop_fill(F.col("img"), F.col("numChannels"), args.crop), "group_id": F.col("obsid")})
        part = I.run(df, table, models, folds, raw, steps=shape.steps, channels=args.crop, df_hz=shape.foff * 1e6, dt_s=shape.tsamp, n_per_class=args.n, max_snr=args.max_snr, fluctuate=args.fluctuate, seed=args.seed)
        made = part if made is None else made.unionByName(part, allowMissingColumns=True)
    made.write.mode("overwrite").parquet(f"{out}/injections.parquet")
    made = spark.read.parquet(f"{out}/injections.parquet")
    told = I.injected_vs_real(made.where("kind = 'injected'"), table, [f"{c}_n" for c in raw], seed=args.seed, max_iter=args.max_iter)
    files.write_json({"cells": I.report(made), "injected_vs_real": told}, f"{out}/injections_report.json")


def info(spark: SparkSession, args: argparse.Namespace, out) -> None:
    for path in resolve_files(args.files, args.root):
        D.file_info(spark.read.parquet(str(path))).show(truncate=False, vertical=True)


COMMANDS = {"flag": (flag, "flags"), "features": (features, "features"), "cluster": (cluster, "clusters"), "score": (score, "scores"), "inject": (inject, "scores"), "info": (info, "flags")}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name) for name in COMMANDS}
    for p in made.values():
        _options(p, {"workspace": "", "outdir": ""})
    for name in ("flag", "features", "info", "inject"):
        made[name].add_argument("files", nargs="*")
    for name in ("cluster", "score"):
        made[name].add_argument("file", nargs="?", default="all")
        _options(made[name], {"tag": "" if name == "score" else "clusters"})
    _options(made["flag"], FLAGS | MASKS | {"derive_mask": False, "incoherent_power": "", "show": 15})
    _options(made["features"], {"crop": 60, "rfi_beams": 32, "clean_beams": 2, "require_pass_all": False, "method": "globular"})
    _options(made["cluster"], CLUSTER | {"scaling": "robust", "match": False, "match_pct": 50.0, "report": False})
    made["cluster"].add_argument("--match-cut", type=float)
    made["cluster"].add_argument("--match-families", type=int)
    _options(made["score"], SCORE | {"features": "stamp", "ablation": False})
    _options(made["inject"], {"table": "", "crop": 60, "n": 150, "max_snr": 8.0, "fluctuate": False, "folds": 5, "seed": 0, "seeds": 3, "max_iter": 300})
    return top


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(given)
    args.root = resolve(args.workspace or None)
    run, stage = COMMANDS[args.command]
    if args.command in ("cluster", "score") and args.file == "all":
        args.file = str(stage_folder(args.root, "features") / files.filename("all"))
    run(spark or SparkSession.builder.getOrCreate(), args, args.outdir or stage_folder(args.root, stage))


if __name__ == "__main__":
    main()
