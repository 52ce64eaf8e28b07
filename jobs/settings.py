"""What both jobs share: settings from a small TOML file, the expression of a column, and the log."""

from __future__ import annotations

import dataclasses
import logging
import tomllib
from typing import TypeVar

T = TypeVar("T")


def load(kind: type[T], path: str | None) -> T:
    """Settings of the given dataclass from a TOML file; names that it does not have are an error."""
    if not path:
        return kind()
    with open(path, "rb") as f:
        given = tomllib.load(f)
    unknown = set(given) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**given)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(name)


def log_to_terminal() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
