import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake import cli, workspace
from hitlake.sources import files
from hitlake.sources.adapters import hits


def test_workspaces(tmp_path, monkeypatch):
    monkeypatch.delenv(workspace.VARIABLE, raising=False)
    inner = tmp_path / "w" / "deep" / "er"
    inner.mkdir(parents=True)
    (tmp_path / "w" / "data").mkdir()
    assert workspace.resolve(start=str(inner)) == tmp_path / "w"
    assert workspace.resolve(start=str(tmp_path)) == tmp_path / "w", "an only child"
    assert "the only one below" in workspace.banner(start=str(tmp_path)) and "found above" in workspace.banner(start=str(inner))
    # Above a project's uppermost folder nothing is taken, nor the root.
    project = tmp_path / "w" / "project" / "src"
    project.mkdir(parents=True)
    (tmp_path / "w" / "project" / ".git").mkdir()
    assert workspace.resolve(start=str(project)) == project
    assert "is no workspace" in workspace.banner(start=str(project))
    (tmp_path / "w" / "project" / "features").mkdir()
    assert workspace.resolve(start=str(project)) == tmp_path / "w" / "project"
    assert all(f != f.parent for f in workspace._climbed(tmp_path))
    monkeypatch.setenv(workspace.VARIABLE, str(inner))
    assert workspace.resolve() == inner and workspace.resolve(str(tmp_path)) == tmp_path
    with pytest.raises(FileNotFoundError):
        workspace.resolve(str(tmp_path / "none"))
    (tmp_path / "w" / "data" / "a.parquet").write_text("")
    assert workspace.resolve_files(["a"], tmp_path / "w") == workspace.resolve_files([], tmp_path / "w") == [tmp_path / "w" / "data" / "a.parquet"]
    with pytest.raises(FileNotFoundError):
        workspace.resolve_files(["b"], tmp_path / "w")
    with pytest.raises(ValueError, match="unknown stage"):
        workspace.stage_folder(tmp_path, "x")


def test_from_hits_to_scores(spark, tmp_path, capsys):
    os.makedirs(tmp_path / "data")
    rng = np.random.default_rng(0)
    cube = [(k, rng.gamma(15, size=(14, 24)).tolist()) for k in range(1000)]
    img = spark.createDataFrame(cube, "id long, img array<array<double>>")
    hits(spark, "/root/testdata/sf0.001").where("file in ('click', 'view')").drop("file").withColumns({"file": F.lit("one"), "numChannels": F.lit(24), "foff": F.lit(1e-6), "tsamp": F.lit(18.0)}).join(img, "id").write.parquet(f"{tmp_path}/data/one.parquet")
    run = lambda *a: cli.main([*a, "--workspace", str(tmp_path)], spark)
    run("info")
    run("flag", "--tol-hz", "5e6", "--max-beams", "2", "--derive-mask", "--mask-bin-hz", "1e8", "--mask-min-beams", "90")
    run("features", f"{tmp_path}/flags/one_cat.parquet", "--crop", "12", "--rfi-beams", "2", "--clean-beams", "1")
    run("cluster", "--epochs", "1", "--match", "--min-samples", "4")
    run("cluster", "--report")
    run("score", "--folds", "3", "--max-iter", "2", "--features", "meta", "--ablation")
    run("inject", f"{tmp_path}/flags/one_cat.parquet", "--crop", "12", "--n", "3", "--max-snr", "1e3", "--folds", "3", "--max-iter", "2")
    assert {c["kind"] for c in json.load(open(tmp_path / "scores" / "injections_report.json"))["cells"]} == {"control", "injected"}
    assert set(files.read_report(f"{tmp_path}/scores/report.json")["validation"]["ablation"]) >= {"meta", "stamp"}
    made = {p.name for stage in workspace.STAGES if (tmp_path / stage).exists() for p in (tmp_path / stage).iterdir()}
    assert {"one_cat.parquet", "one_cutflow.csv", "one_survivors.csv", "one_globular.parquet", "all_globular.parquet", "clusters_clusters.parquet", "clusters_summary.csv", "clusters_families.csv", "clusters_candidates.csv", "clusters_interesting.csv", "clusters_metrics.json", "all_scores.parquet", "candidates.csv", "contrarian.csv", "ambiguous.csv", "report.json"} <= made
    report = json.load(open(tmp_path / "scores" / "report.json"))
    assert set(report["validation"]) >= {"roc_auc", "pr_auc", "within_snr", "n_beams"}
    assert spark.read.parquet(f"{tmp_path}/features/all_globular.parquet").where("feature_ok").count() > 100
