"""Workspace configuration: strict JSON; what is wrong disables the workspace, what is missing enables it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from loam.operators.store import write_config
from loam.session import LIMITS

THINKING = ("off", "minimal", "low", "medium", "high", "xhigh")  # fixed values


@dataclass(frozen=True)
class Config:
    version: int = 1
    enabled: bool = True
    dreamModel: str | None = None
    dreamThinking: str | None = None
    recallModel: str | None = None
    recallThinking: str | None = None
    minTurns: int = LIMITS.min_turns
    minMinutes: int = LIMITS.min_minutes
    embeddingModel: str = "default"


def positive_int(value, instead: int) -> int:
    """Whole positive numbers, rounded down; anything else gives `instead`."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value < 1:
        return instead
    return int(value)


def parse(text: str) -> Config:
    """The configuration, or ValueError."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("no object")
    if unknown := sorted(data.keys() - Config.__dataclass_fields__.keys()):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    if data.get("version") != 1 or not isinstance(data.get("enabled", True), bool):
        raise ValueError("version must be 1 and enabled a boolean")
    for key in ("dreamModel", "recallModel"):
        if data.get(key) is not None and split_model(data[key]) is None:
            raise ValueError(f"{key} must be provider/model")
    for key in ("dreamThinking", "recallThinking"):
        if data.get(key) is not None and data[key] not in THINKING:
            raise ValueError(f"{key} is no thinking level")
    data["minTurns"] = positive_int(data.get("minTurns"), LIMITS.min_turns)
    data["minMinutes"] = positive_int(data.get("minMinutes"), LIMITS.min_minutes)
    return Config(**data)


def load(path: str) -> Config:
    file = Path(path)
    if not file.exists():
        return Config()
    try:
        return parse(file.read_text())
    except ValueError:
        return Config(enabled=False)


def save(path: str, config: Config) -> None:
    write_config(path, {k: v for k, v in asdict(config).items() if v is not None})


def pause(path: str, paused: bool = True) -> Config:
    """Flips `enabled` and nothing else; a file that cannot be read as configuration is not overwritten."""
    config = replace(parse(Path(path).read_text()) if Path(path).exists() else Config(), enabled=not paused)
    save(path, config)
    return config


def split_model(name) -> tuple[str, str] | None:
    provider, slash, model = name.partition("/") if isinstance(name, str) else ("", "", "")
    return (provider, model) if slash and provider and model else None
