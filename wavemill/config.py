"""Configuration on the driver: YAML files, merging, checks, logging and folders."""

from __future__ import annotations

import logging
import re
import shutil
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:  # reading YAML files then isn't possible, all else is
    yaml = None

_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)[eE][-+]?\d+")
FOLDERS = ("processed", "features", "models", "reports", "figures", "dashboards")


def numbers(tree: Any) -> Any:
    """Numbers like 100e-6, which YAML reads as text, as floats; "None" as None."""
    if isinstance(tree, dict):
        return {k: numbers(v) for k, v in tree.items()}
    if isinstance(tree, list):
        return [numbers(v) for v in tree]
    if isinstance(tree, str):
        if _NUMBER.fullmatch(tree):
            return float(tree)
        if tree == "None":
            return None
    return tree


def merge(base: dict, over: dict) -> dict:
    """Both trees; where both have a value that isn't a mapping, the second wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class Configs:
    """The YAML files of a folder, each read once."""

    def __init__(self, folder: str | Path):
        self.folder, self._read = Path(folder), {}

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.yaml"))

    def get(self, name: str) -> dict:
        if name not in self._read:
            if yaml is None:
                raise RuntimeError("PyYAML is needed to read configurations")
            self._read[name] = numbers(yaml.safe_load((self.folder / f"{name}.yaml").read_text(encoding="utf-8")) or {})
        return self._read[name]

    def reload(self, name: str | None = None) -> None:
        self._read = {} if name is None else {k: v for k, v in self._read.items() if k != name}

    def all(self) -> dict[str, dict]:
        return {n: self.get(n) for n in self.names()}

    def save(self, tree: dict, name: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{name}.yaml").write_text(yaml.safe_dump(tree, allow_unicode=True, sort_keys=False), encoding="utf-8")
        self.reload(name)


def is_valid(tree: dict, required: list[str] = (), types: dict[str, type] | None = None, ranges: dict[str, tuple] | None = None) -> bool:
    """Whether required keys are there, and values have their types and lie in their inclusive ranges."""
    if any(k not in tree for k in required):
        return False
    if any(k in tree and not isinstance(tree[k], t) for k, t in (types or {}).items()):
        return False
    return all(k not in tree or lo <= tree[k] <= hi for k, (lo, hi) in (ranges or {}).items())


def is_yaml(path: str | Path) -> bool:
    try:
        yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        return True
    except (OSError, UnicodeDecodeError, AttributeError, Exception):  # noqa: B014  whatever the parser raises means no
        return False


def set_up_logging(level: str = "INFO", file: str | None = None) -> logging.Logger:
    log = logging.getLogger("wavemill")
    log.setLevel(level)
    log.handlers[:] = [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]
    for h in log.handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
    return log


def make_folders(root: str | Path) -> dict[str, Path]:
    out = {n: Path(root) / n for n in FOLDERS}
    for p in out.values():
        p.mkdir(parents=True, exist_ok=True)
    return out


def project_root(start: str | Path = ".", marker: str = "wavemill") -> Path:
    at = Path(start).resolve()
    return next((p for p in (at, *at.parents) if (p / marker).is_dir()), at)


def file_megabytes(path: str | Path) -> float:
    try:
        return Path(path).stat().st_size / 1048576
    except OSError:
        return 0.0


def free_gigabytes(path: str | Path = ".") -> float:
    return shutil.disk_usage(path).free / 1024**3


def is_file(path: str | Path) -> bool:
    return Path(path).is_file()
