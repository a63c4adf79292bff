"""Settings of an index, read from and written to TOML."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from quarry.sources.files import LANGUAGES


class ConfigError(ValueError):
    """A settings file that can't be read or holds wrong values."""


@dataclass
class Storage:
    db_path: str = ".quarry/index"
    max_db_size_mb: int = 500


@dataclass
class Retrieval:
    default_max_tokens: int = 4000
    default_max_results: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


@dataclass
class Server:
    transport: str = "stdio"


@dataclass
class Config:
    """Missing keys take defaults, unknown ones are left out."""

    version: str = "0.1.0"
    index_paths: list[str] = field(default_factory=list)
    ignore_patterns: list[str] = field(default_factory=list)
    use_default_ignores: bool = True
    languages: list[str] = field(default_factory=lambda: list(LANGUAGES.values()))
    storage: Storage = field(default_factory=Storage)
    retrieval: Retrieval = field(default_factory=Retrieval)
    server: Server = field(default_factory=Server)


def _fill(kind: type, values: dict, where: str = ""):
    out = kind()
    for f in dataclasses.fields(kind):
        if f.name not in values:
            continue
        value, default = values[f.name], getattr(out, f.name)
        if dataclasses.is_dataclass(default):
            value = _fill(type(default), value, f"{f.name}.") if isinstance(value, dict) else value
        elif isinstance(default, float) and type(value) is int:
            value = float(value)
        if type(value) is not type(default) or (isinstance(value, list) and not all(isinstance(v, str) for v in value)):
            raise ConfigError(f"{where}{f.name}: {value!r}")
        setattr(out, f.name, value)
    return out


def parse(text: str) -> Config:
    try:
        config = _fill(Config, tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    unknown = set(config.languages) - set(LANGUAGES.values())
    if unknown:
        raise ConfigError(f"unknown languages: {sorted(unknown)}")
    return config


def load(path: str | Path) -> Config:
    try:
        return parse(Path(path).read_text("utf-8"))
    except OSError as e:
        raise ConfigError(f"{path}: {e}") from e


def dump(config: Config) -> str:
    """The settings as TOML."""
    values = dataclasses.asdict(config)
    plain = [f"{k} = {json.dumps(v)}" for k, v in values.items() if not isinstance(v, dict)]
    tables = [f"\n[{k}]\n" + "\n".join(f"{n} = {json.dumps(v)}" for n, v in t.items()) for k, t in values.items() if isinstance(t, dict)]
    return "\n".join(plain + tables) + "\n"
