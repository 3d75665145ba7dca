"""Single files of a vault, from the driver, never outside its root; and results as text for people and programs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

from .paths import inside


def read_text(root: str, relative: str) -> str:
    return inside(root, relative).read_text(encoding="utf-8")


def write_text(root: str, relative: str, content: str) -> None:
    """Replaces the file in one step."""
    path = inside(root, relative)
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f".{path.name}.tmp")
    temporary.write_text(content, encoding="utf-8")
    os.replace(temporary, path)


def remove(root: str, relative: str) -> bool:
    """Whether there was anything to remove."""
    path = inside(root, relative)
    if not path.is_file():
        return False
    path.unlink()
    return True


def exists(root: str, relative: str) -> bool:
    return inside(root, relative).is_file()


def results_text(found: DataFrame) -> str:
    """Search results (rank, path, score, title, section_key) of one query; they are few by their limit."""
    rows = found.orderBy("rank").collect()
    return "\n".join(f"{r['rank']}. {r.title or r.path} ({r.path}, {r.score:.4f})" for r in rows) or "No results."


def rows_json(df: DataFrame) -> str:
    """A small result as a JSON array."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str, ensure_ascii=False)
