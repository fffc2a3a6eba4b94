"""The completion manifest of a set of token binaries, and whether it still holds."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

SETTINGS = ("val_split", "seed", "min_length", "max_length", "text_column")
NAME = "manifest.json"


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def source_records(files: list[str], root: str) -> list[dict]:
    return [{"path": os.path.relpath(f, root), "bytes": (s := os.stat(f)).st_size, "mtime_ns": s.st_mtime_ns} for f in files]


def write_json(path: str, data: dict) -> None:
    """Whole or not at all."""
    made = f"{path}.tmp-{os.getpid()}"
    with open(made, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(made, path)


def manifest(tokenizer: dict, settings: dict, splits: dict[str, list[str]], root: str, tokens: dict[str, int]) -> dict:
    parts = {s: {"sources": source_records(files, root), "tokens": tokens[s], "bytes": 2 * tokens[s]} for s, files in splits.items()}
    return {"schema_version": 1, "completed": True, "bounded": False, "tokenizer": tokenizer, "data": {k: settings.get(k) for k in SETTINGS}, "splits": parts}


def valid(folder: str, tokenizer: dict, settings: dict, splits: dict[str, list[str]], root: str, context: int) -> bool:
    """Whether the folder's binaries are those of this tokenizer, these settings and these files. Any error means no."""
    try:
        found = json.loads(Path(folder, NAME).read_text())
        if found["schema_version"] != 1 or not found["completed"] or found["bounded"] or found["tokenizer"] != tokenizer or found["data"] != {k: settings.get(k) for k in SETTINGS}:
            return False
        for s, files in splits.items():
            part = found["splits"][s]
            if part["sources"] != source_records(files, root) or part["tokens"] <= context or part["bytes"] != 2 * part["tokens"] or Path(folder, f"{s}.bin").stat().st_size != part["bytes"]:
                return False
        return True
    except (OSError, KeyError, TypeError, ValueError):
        return False
