"""Settings from an environment: text values that replace defaults."""

from __future__ import annotations

import dataclasses
import math
import os
from collections.abc import Mapping
from typing import TypeVar

Options = TypeVar("Options")


def number(value: str | None, fallback: float) -> float:
    """The number that a text says; the fallback where it is missing, empty or no finite number."""
    try:
        found = float(value) if value else math.nan
    except ValueError:
        found = math.nan
    return found if math.isfinite(found) else fallback


def overridden(options: Options, prefix: str, environment: Mapping[str, str] | None = None) -> Options:
    """A dataclass of numbers with those fields replaced that the environment names: prefix and the field in capitals."""
    env = os.environ if environment is None else environment
    changes = {}
    for f in dataclasses.fields(options):
        own = getattr(options, f.name)
        found = number(env.get(f"{prefix}{f.name.upper()}"), math.nan)
        if isinstance(own, int | float) and not isinstance(own, bool) and math.isfinite(found):
            changes[f.name] = int(found) if isinstance(own, int) else found
    return dataclasses.replace(options, **changes)


def first_existing(candidates: list[tuple[str, str | None]], exists=os.path.exists) -> tuple[str, str] | None:
    """Source and path of the first candidate (source, path) that is given and exists."""
    return next(((source, path) for source, path in candidates if path and exists(path)), None)
