"""Folders of checkpoints: written whole, the latest complete one found, old ones removed; and a log of metrics."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Callable

NAME = re.compile(r"step[-_]?(\d+)")
#: A checkpoint without one of these is not complete.
REQUIRED = ("model.bin", "state.json")


def complete(folder: str, required: tuple[str, ...] = REQUIRED) -> list[tuple[int, str]]:
    """Step and path of the complete checkpoints, by step."""
    if not os.path.isdir(folder):
        return []
    found = [(int(m[1]), os.path.join(folder, x)) for x in os.listdir(folder) if (m := NAME.fullmatch(x))]
    return sorted((s, p) for s, p in found if all(os.path.isfile(os.path.join(p, f)) for f in required))


def latest(folder: str, required: tuple[str, ...] = REQUIRED) -> str | None:
    found = complete(folder, required)
    return found[-1][1] if found else None


def save(folder: str, step: int, write: Callable[[str], None], keep: int | None = None, required: tuple[str, ...] = REQUIRED) -> str:
    """write(path) makes the files; the checkpoint appears whole or not at all, and replaces one of the same step. All but the last `keep` go."""
    os.makedirs(folder, exist_ok=True)
    made, name = os.path.join(folder, f".made-{uuid.uuid4().hex}"), os.path.join(folder, f"step-{step}")
    os.makedirs(made)
    try:
        write(made)
        missing = [f for f in required if not os.path.isfile(os.path.join(made, f))]
        if missing:
            raise ValueError(f"the checkpoint lacks {missing}")
        old = f"{made}-old"
        if os.path.exists(name):
            os.replace(name, old)
        os.replace(made, name)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(made, ignore_errors=True)
    if keep:
        for _, path in complete(folder, required)[:-keep]:
            shutil.rmtree(path)
    return name


class MetricsLog:
    """Metrics as JSON lines (step, name, value), which spark.read.json reads; told() formats them for people."""

    def __init__(self, path: str):
        self.path = path

    def log(self, step: int, metrics: dict[str, float]) -> str:
        with open(self.path, "a", encoding="utf-8") as f:
            f.writelines(json.dumps({"step": step, "name": k, "value": float(v)}) + "\n" for k, v in metrics.items())
        return told(step, metrics)


def told(step: int, metrics: dict[str, float]) -> str:
    shown = ((k, f"{v:.3e}" if k.split("/")[-1] == "lr" else f"{v:.4f}" if isinstance(v, float) else str(v)) for k, v in metrics.items())
    return f"step {step} | " + " | ".join(f"{k} {v}" for k, v in shown)
