"""Settings: environment, then the repository's files, then off."""

from __future__ import annotations

import os
import tomllib

POLICIES = ("off", "if_fresh", "on")
FILES = (".graphloom/config.toml", "graphloom.toml")


def macro_default(root: str, env: dict[str, str] | None = None) -> tuple[str, str]:
    """The policy on the side dataset and where it comes from. Values that are none fall through."""
    value = (env if env is not None else os.environ).get("GRAPHLOOM_MACRO_DEFAULT", "").strip().lower()
    if value in POLICIES:
        return value, "env"
    for name in FILES:
        try:
            with open(os.path.join(root, name), "rb") as f:
                value = tomllib.load(f).get("macro", {}).get("default")
        except (OSError, ValueError, AttributeError):
            continue
        if isinstance(value, str) and value.strip().lower() in POLICIES:
            return value.strip().lower(), name
    return "off", "default"
