"""Vaults on disk, their registry, and paths that must stay inside them."""

from __future__ import annotations

import os
import shutil
import tomllib
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

#: The folder that marks a vault's root; callers with vaults of another make give their own.
MARKER = ".vault"


def normalise_uri(source: str) -> str:
    """URLs as they are; files as file:// and their real path (missing ones too, so that they can be removed)."""
    return source if source.startswith(("http://", "https://")) else "file://" + os.path.realpath(source)


def inside(root: str, relative: str) -> Path:
    """The path below root, or ValueError where it is absolute or climbs out."""
    if relative.startswith("/"):
        raise ValueError(f"absolute path: {relative}")
    parts: list[str] = []
    for p in PurePosixPath(relative).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"path leaves the vault: {relative}")
            parts.pop()
        elif p != ".":
            parts.append(p)
    return Path(root, *parts)


def registry(path: str) -> dict[str, dict]:
    """name -> {path, description, is_default} of a TOML registry; no file, no vaults."""
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        data = tomllib.load(f)
    return {n: {"path": v["path"], "description": v.get("description"), "is_default": n == data.get("default")} for n, v in sorted(data.get("vaults", {}).items())}


def save_registry(path: str, vaults: dict[str, dict]) -> None:
    """Replaces the registry in one step."""
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    default = next((n for n, v in vaults.items() if v.get("is_default")), None)
    lines = [f"default = {quote(default)}", ""] if default else []
    for n, v in sorted(vaults.items()):
        lines += [f"[vaults.{quote(n)}]", f"path = {quote(v['path'])}"]
        lines += [f"description = {quote(v['description'])}"] if v.get("description") else []
        lines.append("")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w") as f:
        f.write("\n".join(lines))
    os.replace(path + ".tmp", path)


def add_vault(registry_path: str, name: str, path: str, description: str | None = None) -> None:
    """Registers a folder under a name; a name that is known gets the new folder, and stays the default if it was."""
    vaults = registry(registry_path)
    vaults[name] = {"path": path, "description": description, "is_default": vaults.get(name, {}).get("is_default", False)}
    save_registry(registry_path, vaults)


def create_vault(registry_path: str, name: str, path: str, description: str | None = None, marker: str = MARKER) -> None:
    """Makes the folders of a new vault and registers it; a folder that holds anything is refused."""
    if os.path.isdir(path) and os.listdir(path):
        raise ValueError(f"{path} isn't empty: add it as a vault that exists")
    for folder in (marker, "wiki/concepts", "raw"):
        os.makedirs(os.path.join(path, folder), exist_ok=True)
    add_vault(registry_path, name, path, description)


def _known(registry_path: str, name: str) -> dict[str, dict]:
    vaults = registry(registry_path)
    if name not in vaults:
        raise LookupError(f"no vault is registered as {name}")
    return vaults


def remove_vault(registry_path: str, name: str) -> None:
    """Takes a name from the registry, and with it the default if it was that; the folder stays."""
    vaults = _known(registry_path, name)
    del vaults[name]
    save_registry(registry_path, vaults)


def delete_vault(registry_path: str, name: str, force: bool = False) -> None:
    """Removes a vault's folder for good, then its name, so that a removal that fails can be tried again."""
    path = _known(registry_path, name)[name]["path"]
    if not force:
        raise PermissionError(f"{path} and everything in it would be deleted: needs force")
    if os.path.isdir(path):
        shutil.rmtree(path)
    remove_vault(registry_path, name)


def default_vault(registry_path: str, name: str) -> None:
    vaults = _known(registry_path, name)
    save_registry(registry_path, {n: v | {"is_default": n == name} for n, v in vaults.items()})


def registry_table(spark: SparkSession, vaults: dict[str, dict]) -> DataFrame:
    rows = [(n, v["path"], v.get("description"), bool(v.get("is_default"))) for n, v in sorted(vaults.items())]
    return spark.createDataFrame(rows, "name string, path string, description string, is_default boolean")


def resolve_vault(flag: str | None, cwd: str, vaults: dict[str, dict], marker: str = MARKER) -> str:
    """A registered name or a path; else the nearest folder above cwd with the marker; else the default."""
    if flag:
        return vaults[flag]["path"] if flag in vaults else flag
    for d in (Path(cwd), *Path(cwd).parents):
        if (d / marker).is_dir():
            return str(d)
    for v in vaults.values():
        if v.get("is_default"):
            return v["path"]
    raise LookupError("no vault: none is given, none above the working folder, no default")


def merge_layers(*layers: dict) -> dict:
    """Configuration by key, the first layer that has it; nested tables merge."""
    out: dict = {}
    for layer in reversed(layers):
        for k, v in layer.items():
            out[k] = merge_layers(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
