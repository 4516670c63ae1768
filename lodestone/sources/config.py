"""Settings: defaults, TOML files, validation, key storage."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass


class ConfigError(ValueError):
    pass


# Folders of dependencies and build output, never indexed unless everything is.
DEPENDENCY_DIRS = ["node_modules", "bower_components", "target", ".venv", "venv", "env", ".env", "__pycache__", ".eggs", "*.egg-info", ".tox", ".nox", "vendor", "vendor/bundle", ".gradle", ".m2", "build", "bin", "obj", "packages", "deps", "_build", ".stack-work", "dist-newstyle", "_opam", "Pods", ".build", "DerivedData", ".dart_tool", ".pub-cache", "zig-cache", "zig-out"]
# Globs ignored by default.
IGNORE_PATTERNS = ["*.lock", "*.min.js", "*.min.css", "*.map", "*.wasm", "*.pyc", "*.o", "*.so", "*.dylib", "*.dll", "*.exe", "*.bin", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.pdf", "*.zip", "*.tar", "*.gz", ".git", "dist"]


@dataclass
class Embedding:
    dimension: int = 384
    batch_size: int = 32


@dataclass
class Indexing:
    max_file_size_bytes: int = 1 << 20
    ignore_file: str = ".indexignore"


@dataclass
class Query:
    top_k: int = 10
    broad_k: int = 50
    hybrid: bool = True
    rerank: bool = True
    max_context_tokens: int = 2048
    history_turns: int = 6


@dataclass
class Generation:
    max_tokens: int = 1024
    temperature: float = 0.1
    redact_secrets: bool = True


@dataclass
class Watching:
    debounce_ms: int = 500


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    indexing: Indexing = field(default_factory=Indexing)
    query: Query = field(default_factory=Query)
    generation: Generation = field(default_factory=Generation)
    watching: Watching = field(default_factory=Watching)
    ignore_patterns: list[str] = field(default_factory=lambda: list(IGNORE_PATTERNS))

    def validate(self) -> Config:
        for name, v in (("embedding.dimension", self.embedding.dimension), ("embedding.batch_size", self.embedding.batch_size), ("indexing.max_file_size_bytes", self.indexing.max_file_size_bytes), ("query.top_k", self.query.top_k), ("query.broad_k", self.query.broad_k)):
            if v < 1:
                raise ConfigError(f"{name} must be positive")
        if not 0 <= self.generation.temperature <= 2:
            raise ConfigError("generation.temperature must lie between 0 and 2")
        return self


def _filled(target, values: dict) -> None:
    known = {f.name: f for f in fields(target)}
    for key, value in values.items():
        if key in known:
            current = getattr(target, key)
            if is_dataclass(current):
                _filled(current, value)
            else:
                setattr(target, key, type(current)(value) if not isinstance(current, list) else list(value))


def loads(text: str) -> Config:
    """Defaults, overridden by what the TOML text names; missing keys, ignore_patterns too, keep their defaults."""
    config = Config()
    _filled(config, tomllib.loads(text))
    return config.validate()


def load(path: str) -> Config:
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def _toml(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return repr(value)


def dumps(config: Config) -> str:
    values = asdict(config)
    top = [f"{k} = {_toml(v)}" for k, v in values.items() if not isinstance(v, dict)]
    for section, items in values.items():
        if isinstance(items, dict):
            top += ["", f"[{section}]", *(f"{k} = {_toml(v)}" for k, v in items.items())]
    return "\n".join(top) + "\n"


def set_value(config: Config, key: str, text: str) -> Config:
    """Sets "section.key" (or "key") from a text, by the type it has."""
    *section, name = key.split(".")
    target = getattr(config, section[0], None) if section else config
    if target is None or not hasattr(target, name):
        raise ConfigError(f"unknown setting {key}")
    current = getattr(target, name)
    try:
        value = text.lower() in ("true", "1", "yes", "on") if isinstance(current, bool) else text.split(",") if isinstance(current, list) else type(current)(text)
    except ValueError as e:
        raise ConfigError(f"{key}: {e}") from e
    setattr(target, name, value)
    return config.validate()


def save_private(path: str, text: str) -> None:
    """Writes a file only its owner can read, for keys."""
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        f.write(text)
    os.chmod(path, 0o600)
