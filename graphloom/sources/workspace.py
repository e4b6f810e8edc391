"""Workspace manifests, package names and path maps.

These files are few and small; they are read on the driver and become a small table of aliases
(schema.ALIASES). Reading goes through a ``read`` function, so that a test or a remote store can
supply it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

Reader = Callable[[str], str | None]

BARRELS = ("src/index.ts", "src/index.tsx", "src/index.js", "src/index.mjs", "src/main.ts", "index.ts", "index.js", "lib/index.js", "lib/index.d.ts", "dist/index.js")
CONDITIONS = ("import", "default", "require", "types")
#: Where an alias comes from, weakest first.
PRIORITY = ("package.json", "package.json_exports", "tsconfig_paths", "cli")


def local(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def root_id(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "-", text)


def manifest(text: str, base: str) -> list[dict]:
    """``{"roots": [{"id", "path"} or path]}`` or a bare list; ids are made unique by a hash."""
    data = json.loads(text)
    items = data["roots"] if isinstance(data, dict) else data
    out: list[dict] = []
    for x in items:
        path = x if isinstance(x, str) else x["path"]
        path = path if os.path.isabs(path) else os.path.normpath(os.path.join(base, path))
        name = root_id(os.path.basename(path.rstrip("/")) if isinstance(x, str) else x["id"])
        if any(r["path"] == path for r in out):
            continue
        if any(r["id"] == name for r in out):
            if not isinstance(x, str):
                raise ValueError(f"root id {name!r} occurs twice")
            name = f"{name}-{hashlib.sha256(path.encode()).hexdigest()[:8]}"
        out.append({"id": name, "path": path})
    if not out:
        raise ValueError("the manifest names no roots")
    return out


def condition(value) -> str | None:
    """The first string under import, default, require, types, however deep."""
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, dict):
        return next((s for k in CONDITIONS if k in value and (s := condition(value[k]))), None)
    if isinstance(value, list):
        return next((s for x in value if (s := condition(x))), None)
    return None


def package(text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """Name and exports (subpath, target) of a package.json; patterns with ``*`` are left out."""
    try:
        data = json.loads(text)
    except ValueError:
        return None, []
    if not isinstance(data, dict):
        return None, []
    name = data.get("name").strip() if isinstance(data.get("name"), str) else None
    exports = data.get("exports")
    if isinstance(exports, dict) and any(k == "." or k.startswith("./") for k in exports):
        subs = [(k[2:].rstrip("/"), condition(v)) for k, v in exports.items() if (k == "." or k.startswith("./")) and "*" not in k and k not in ("./", "./package.json")]
    else:
        subs = [("", condition(exports))] if exports is not None else []
    return name or None, [(k, _plain(t)) for k, t in subs if t]


def _plain(target: str) -> str:
    return re.sub(r"^(\./)+", "", target.strip().replace("\\", "/"))


def tsconfig(text: str) -> list[tuple[str, list[str]]]:
    """``compilerOptions.paths``; line comments are dropped, addresses are not."""
    lines = [x if "//" not in x or "://" in x else x[: x.index("//")] for x in text.splitlines()]
    try:
        paths = json.loads("\n".join(lines))["compilerOptions"]["paths"]
    except (ValueError, KeyError, TypeError):
        return []
    out = []
    for key, targets in paths.items():
        found = [t.strip() for t in ([targets] if isinstance(targets, str) else targets if isinstance(targets, list) else []) if isinstance(t, str)]
        if found:
            out.append((key, found))
    return out


def aliases(roots: list[dict], given: dict[str, str] | None = None, read: Reader = local, exists: Callable[[str], bool] = os.path.isfile) -> list[tuple]:
    """Rows (package, root_id, entry, barrel, source) of a workspace.

    Package names give way to path maps, these to ``given`` (package -> root id). A package name
    that two roots claim is an error unless ``given`` decides it.
    """
    found: dict[str, tuple] = {}
    claims: dict[str, set[str]] = {}

    def put(key: str, root: str, entry: str | None, barrel: str | None, source: str) -> None:
        if key not in found or PRIORITY.index(source) >= PRIORITY.index(found[key][4]):
            found[key] = (key, root, entry, barrel, source)

    for r in roots:
        barrel = next((b for b in BARRELS if exists(f"{r['path']}/{b}")), None)
        name, exports = package(read(f"{r['path']}/package.json") or "")
        if name:
            claims.setdefault(name, set()).add(r["id"])
            put(name, r["id"], None, barrel, "package.json")
            for sub, target in exports:
                put(f"{name}/{sub}" if sub else name, r["id"], target, None, "package.json_exports")
        for key, targets in tsconfig(read(f"{r['path']}/tsconfig.json") or ""):
            put(key, r["id"], _plain(targets[0]), None, "tsconfig_paths")
    for key, root in (given or {}).items():
        path = next((r["path"] for r in roots if r["id"] == root), None)
        put(key, root, None, next((b for b in BARRELS if path and exists(f"{path}/{b}")), None), "cli")
    for name, ids in claims.items():
        if len(ids) > 1 and name not in (given or {}):
            raise ValueError(f"package {name!r} is claimed by {', '.join(sorted(ids))}")
    return sorted(found.values())
