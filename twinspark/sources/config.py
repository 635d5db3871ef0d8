"""Settings and rules read on the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from twinspark.functions.ignore import Rule, parse_rules

MAX_CONFIG = 64 * 1024
DEFAULT_IGNORE = "# Paths to leave out, in the style of .gitignore.\n"


@dataclass(frozen=True)
class Config:
    """Scalar settings. digest: "sha256" (native) or "blake3"; color: "auto", "always" or "never"."""

    digest: str = "sha256"
    recursive: bool = True
    unmatched: bool = False
    color: str = "auto"
    gpu_min_bytes: int = 64 * 1024
    history_runs: int = 20
    event_cap: int = 16384
    queue_capacity: int = 4096
    training_files: int = 2048
    training_bytes: int = 1 << 30
    training_per_band: int = 64
    decay: float = 0.9

    def __post_init__(self):
        for name, low, high in (("gpu_min_bytes", 0, 1 << 62), ("history_runs", 1, 10_000), ("event_cap", 1, 1 << 30), ("queue_capacity", 1, 1 << 24), ("training_files", 1, 2048), ("training_bytes", 1, 1 << 62), ("training_per_band", 1, 64)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be in {low}..{high}")
        if not 0 < self.decay <= 1:
            raise ValueError("decay must be in (0, 1]")
        if self.digest not in ("sha256", "blake3"):
            raise ValueError("digest must be sha256 or blake3")
        if self.color not in ("auto", "always", "never"):
            raise ValueError("color must be auto, always or never")

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """From TOML; absent file: defaults; unknown keys are ignored, wrong types are errors."""
        file = Path(path)
        if not file.exists():
            return cls()
        if file.stat().st_size > MAX_CONFIG:
            raise ValueError("config exceeds 64 KiB")
        values = tomllib.loads(file.read_text(encoding="utf-8"))
        known = {}
        for f in fields(cls):
            if f.name in values:
                kind = type(f.default)
                if type(values[f.name]) is not kind and not (kind is float and type(values[f.name]) is int):
                    raise TypeError(f"{f.name} must be {kind.__name__}")
                known[f.name] = values[f.name]
        return cls(**known)


def load_ignore(root: str | Path) -> list[Rule]:
    file = Path(root) / ".twinspark" / "ignore"
    return parse_rules(file.read_text(encoding="utf-8")) if file.exists() else []


def use_color(setting: str, terminal: bool, no_color: bool = False) -> bool:
    return setting == "always" or (setting == "auto" and terminal and not no_color)
