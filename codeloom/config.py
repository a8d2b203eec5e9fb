"""Configuration: discovery, defaults, precedence."""

from __future__ import annotations

import copy
import json
import os

# Settings and their defaults.
DEFAULTS = {
    "excludePaths": [],
    "testCommand": None,
    "coverageCommand": None,
    "duplication": {"minLines": None, "similarity": None},
    "complexity": {"warnThreshold": None},
    "riskOverrides": [],
    "targetReductionPercent": None,
    "ci": {"failOnRegression": False},
}
FILE_NAME = "codeloom.config.json"
PARENTS = 3


def merged(base: dict, over: dict) -> dict:
    """over on top of base, objects into objects; keys with a leading underscore are remarks."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        if key.startswith("_"):
            continue
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def find(target: str, name: str = FILE_NAME) -> str | None:
    """The nearest file from the target up, three parents at most."""
    here = os.path.abspath(target)
    here = here if os.path.isdir(here) else os.path.dirname(here)
    for _ in range(PARENTS + 1):
        if os.path.isfile(path := os.path.join(here, name)):
            return path
        here = os.path.dirname(here)
    return None


def load(target: str, name: str = FILE_NAME) -> tuple[dict, str | None]:
    """Settings, and a warning if a file was there and could not be read; then the defaults hold."""
    path = find(target, name)
    if path is None:
        return copy.deepcopy(DEFAULTS), None
    try:
        with open(path, encoding="utf-8-sig") as f:
            found = json.load(f)
        if not isinstance(found, dict):
            raise ValueError("not an object")
        return merged(DEFAULTS, found), None
    except (OSError, ValueError) as e:
        return copy.deepcopy(DEFAULTS), f"{path}: {e}"


def resolve(cli, configured, default=None):
    """The command line, else the configuration, else the default. 0, "" and False are values."""
    return cli if cli is not None else configured if configured is not None else default
