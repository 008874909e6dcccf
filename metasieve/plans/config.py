"""Settings and prompts from YAML files, read once by the driver."""

from __future__ import annotations

import os
from collections.abc import Sequence

import yaml


def load_config(paths: Sequence[str]) -> dict:
    """The files' settings; of a key that several have, the last file's counts. Missing and empty files count nothing."""
    out: dict = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                out |= yaml.safe_load(f) or {}
    return out


def load_prompt(path: str) -> str:
    """A file's text, or what it has as system_prompt, else as prompt; empty for a missing or another kind of file."""
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if isinstance(data, dict):
        data = data.get("system_prompt", data.get("prompt", ""))
    return data if isinstance(data, str) else ""
