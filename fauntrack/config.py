"""Run settings: defaults, a TOML file over them, explicit overrides over both."""

from __future__ import annotations

import argparse
import dataclasses
import tomllib
from dataclasses import dataclass, field

# The choices of the enumerated settings.
PATH_METHODS = ("astar", "viterbi")
BARRIER_MODES = ("hsi_only", "hard", "bridge")
INTERVALS = ("raw", "daily", "weekly", "biweekly", "monthly")
DIAGNOSTICS = ("paths", "corridors", "circuit", "agents", "ecology", "validation")


@dataclass(frozen=True)
class Settings:
    """What a run reads, and how its operators are set; every setting is applied by a run or refused when it begins."""

    tagging_file: str | None = None
    hsi_file: str | None = None
    polygon_file: str | None = None
    output_dir: str = "runs"
    bbox: tuple[float, ...] | None = None
    bbox_padding_deg: float = 0.25
    land_polygon_files: tuple[str, ...] = ()
    hex_radius_km: float = 10.0
    depth_barrier_mode: str = "hsi_only"
    depth_range: tuple[float, float] | None = None
    time_interval: str = "raw"
    max_paths: int | None = None
    path_methods: tuple[str, ...] = ("astar",)
    diagnostics: tuple[str, ...] = DIAGNOSTICS
    n_samples: int = 200
    n_warmup: int = 200
    n_agents: int | None = None
    kappa: float = 0.0
    seed: int = 42
    extra: dict = field(default_factory=dict)


def parse_range(x) -> tuple[float, float] | None:
    """A pair from a sequence, 'a,b' or 'a:b', in rising order."""
    if x is None or x == "":
        return None
    parts = x.replace(":", ",").split(",") if isinstance(x, str) else list(x)
    if len(parts) != 2:
        raise ValueError(f"a range has two ends: {x!r}")
    a, b = sorted(map(float, parts))
    return a, b


def _coerce(name: str, value, kind: str):
    if value is None:
        return None
    if name == "depth_range":
        return parse_range(value)
    if "tuple" in kind:
        parts = [p.strip() for p in value.split(",") if p.strip()] if isinstance(value, str) else list(value)
        return tuple(map(float, parts)) if "float" in kind else tuple(map(str, parts))
    if kind.startswith("int"):
        return int(value)
    if kind.startswith("float"):
        return float(value)
    return value


def check(s: Settings) -> Settings:
    for name, choices in (("path_methods", PATH_METHODS), ("diagnostics", DIAGNOSTICS)):
        wrong = set(getattr(s, name)) - set(choices)
        if wrong:
            raise ValueError(f"{name}: {sorted(wrong)} not among {choices}")
    if s.depth_barrier_mode not in BARRIER_MODES:
        raise ValueError(f"depth_barrier_mode: {s.depth_barrier_mode!r} not among {BARRIER_MODES}")
    if s.bbox is not None and len(s.bbox) != 4:
        raise ValueError(f"bbox: west, south, east, north are needed, not {s.bbox}")
    if s.time_interval not in INTERVALS:
        raise ValueError(f"time_interval: {s.time_interval!r} not among {INTERVALS}")
    return s


def override(s: Settings, values: dict) -> Settings:
    """s with the given values; an unknown name is an error, 'all' stands for every diagnostic."""
    kinds = {f.name: str(f.type) for f in dataclasses.fields(Settings)}
    unknown = set(values) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    new = {k: _coerce(k, v, kinds[k]) for k, v in values.items()}
    if new.get("diagnostics") == ("all",):
        new["diagnostics"] = DIAGNOSTICS
    return check(dataclasses.replace(s, **new))


def load(path: str | None = None, **values) -> Settings:
    s = Settings()
    if path:
        with open(path, "rb") as f:
            s = override(s, tomllib.load(f))
    return override(s, values)


def save(s: Settings) -> str:
    """TOML text that load() reads back; settings that are None are left out."""

    def text(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return "[" + ", ".join(map(text, v)) + "]" if isinstance(v, (tuple, list)) else repr(v)

    return "".join(f"{f.name} = {text(v)}\n" for f in dataclasses.fields(s) if f.name != "extra" and (v := getattr(s, f.name)) is not None)


def arguments(argv: list[str] | None = None) -> Settings:
    """Settings from the command line: --config FILE and one option a setting; what is given wins over the file."""
    p = argparse.ArgumentParser(prog="fauntrack")
    p.add_argument("--config")
    for f in dataclasses.fields(Settings):
        if f.name != "extra":
            p.add_argument("--" + f.name.replace("_", "-"), default=argparse.SUPPRESS)
    given = vars(p.parse_args(argv))
    return load(given.pop("config", None), **given)
