"""Configuration files with ``${NAME}`` taken from the environment."""

from __future__ import annotations

import json
import os
import re


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """Known names replaced; unknown ones left as they stand."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), text)


def load_config(path: str, env: dict[str, str] | None = None) -> dict:
    """A JSON file, or a YAML one where that library is installed."""
    with open(path, encoding="utf-8") as f:
        text = substitute(f.read(), env)
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}
