"""Where a command finds its data: a folder with a `data` or `features` folder in it."""

from __future__ import annotations

import os
from pathlib import Path

VARIABLE, DATA, STAGES = "HITLAKE_WORKSPACE", "data", ("flags", "features", "clusters", "scores", "plots")
#: What lies in the uppermost folder of a project: nothing above it is taken for its data.
BOUNDARY = (".git", "pyproject.toml")


def is_workspace(folder: Path) -> bool:
    return any((folder / name).is_dir() for name in (DATA, "features"))


def _climbed(here: Path) -> list[Path]:
    """Folders from here upwards that may be a workspace: up to a project's uppermost folder or home, never the root."""
    out = []
    for folder in (here, *here.parents):
        if folder == folder.parent:
            break
        out.append(folder)
        if folder == Path.home() or any((folder / name).exists() for name in BOUNDARY):
            break
    return out


def resolve(given: str | None = None, start: str | None = None) -> Path:
    """The folder given, else that of the environment, else the nearest upwards, else an only child, else where we are."""
    for named in (given, os.environ.get(VARIABLE)):
        if named:
            if not Path(named).is_dir():
                raise FileNotFoundError(f"no folder {named}")
            return Path(named).resolve()
    here = Path(start or os.getcwd()).resolve()
    for folder in _climbed(here):
        if is_workspace(folder):
            return folder
    children = nearby(here, 2)
    return children[0] if len(children) == 1 else here


def nearby(folder: Path, most: int = 5) -> list[Path]:
    """Workspaces one level below."""
    return [c for c in sorted(folder.iterdir()) if not c.name.startswith(".") and c.is_dir() and is_workspace(c)][:most]


def banner(given: str | None = None, start: str | None = None) -> str:
    """Which workspace it is and how it was found; where there is none, what would help."""
    found, here = resolve(given, start), Path(start or os.getcwd()).resolve()
    how = "as given" if given else f"from {VARIABLE}" if os.environ.get(VARIABLE) else "found here" if found == here else "found above" if found in here.parents else "the only one below"
    if is_workspace(found):
        return f"workspace {found} ({how})"
    names = ", ".join(c.name for c in nearby(here))
    return f"{found} is no workspace: name one with --workspace or {VARIABLE}" + (f"; below are {names}" if names else "")


def stage_folder(workspace: Path, stage: str) -> Path:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; one of {STAGES}")
    return workspace / stage


def resolve_files(given: list[str], workspace: Path, suffix: str = ".parquet") -> list[Path]:
    """Paths, all files of a folder, or bare names in the workspace's data; nothing given means all of it."""
    out: list[Path] = []
    for name in given or [str(workspace / DATA)]:
        for path in (Path(name), workspace / DATA / name, workspace / DATA / f"{name}{suffix}"):
            if path.is_dir() and path.suffix != suffix:
                out += sorted(path.glob(f"*{suffix}"))
                break
            if path.exists():
                out.append(path)
                break
        else:
            raise FileNotFoundError(f"no file, folder or data set {name!r} in {workspace}")
    return list(dict.fromkeys(out))
