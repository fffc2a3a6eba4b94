"""Nested settings: read, merged, overridden from the command line; model presets."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from typing import Any

PRESETS = {name: {"n_layers": l, "n_heads": h, "d_model": d, "d_ff": f, "context_length": c} for name, l, h, d, f, c in (("nano", 4, 4, 256, 1024, 512), ("small", 12, 12, 768, 3072, 1024), ("medium", 24, 16, 1024, 4096, 2048), ("large", 36, 20, 1280, 5120, 2048), ("xl", 48, 25, 1600, 6400, 2048))}


class Config:
    """A tree of settings with attribute and item access."""

    def __init__(self, data: dict | None = None):
        object.__setattr__(self, "_data", {k: Config(v) if isinstance(v, dict) else v for k, v in (data or {}).items()})

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name not in self._data:
            raise AttributeError(name)
        return self._data[name]

    def __setattr__(self, name: str, value: Any) -> None:
        self[name] = value

    def __getitem__(self, name: str) -> Any:
        return self._data[name]

    def __setitem__(self, name: str, value: Any) -> None:
        self._data[name] = Config(value) if isinstance(value, dict) else value

    def __contains__(self, name: str) -> bool:
        return name in self._data

    def __iter__(self) -> Iterator[str]:
        return iter(self._data)

    def get(self, name: str, default: Any = None) -> Any:
        return self._data.get(name, default)

    def keys(self):
        return self._data.keys()

    def values(self):
        return self._data.values()

    def items(self):
        return self._data.items()

    def to_dict(self) -> dict:
        return {k: v.to_dict() if isinstance(v, Config) else copy.deepcopy(v) for k, v in self._data.items()}

    def __repr__(self) -> str:
        return f"Config({self.to_dict()!r})"


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config(yaml.safe_load(f) or {})


def merged(*configs: Config) -> Config:
    """Later trees win, key by key."""

    def into(base: dict, more: dict) -> dict:
        for k, v in more.items():
            base[k] = into(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
        return base

    out: dict = {}
    for c in configs:
        into(out, c.to_dict())
    return Config(out)


def parsed(text: str) -> Any:
    """true/false, null/none, whole numbers, numbers, else the text."""
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def overridden(config: Config, settings: list[str]) -> Config:
    """With settings of the form a.b=c. ValueError for one without an equals sign."""
    data = config.to_dict()
    for s in settings:
        name, equals, value = s.partition("=")
        if not equals:
            raise ValueError(f"{s!r} is not name=value")
        at = data
        *above, last = name.split(".")
        for k in above:
            at = at.setdefault(k, {})
        at[last] = parsed(value)
    return Config(data)


def resolved(config: Config) -> Config:
    """With the sizes of model.preset where model leaves them null or out."""
    preset = PRESETS.get(config.get("model", Config()).get("preset"))
    if not preset:
        return config
    data = config.to_dict()
    data["model"] |= {k: v for k, v in preset.items() if data["model"].get(k) is None}
    return Config(data)
