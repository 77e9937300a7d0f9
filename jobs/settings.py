"""What the jobs share: config files and the log."""

from __future__ import annotations

import json
import logging
from pathlib import Path


def read_config(path: str | Path, known: dict) -> dict:
    """The settings of a local JSON file over the defaults ``known``; unknown names and values of another type raise ValueError."""
    given = json.loads(Path(path).read_text())
    for name, value in given.items():
        if name not in known or not isinstance(value, type(known[name])):
            raise ValueError(f"{path}: no such setting, or not a {type(known.get(name)).__name__}: {name} = {value!r}")
    return known | given


def start_log() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
