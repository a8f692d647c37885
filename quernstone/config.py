"""Settings: argument before environment before file before default."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

PREFIX = "QUERNSTONE_"


class ConfigError(ValueError):
    """A setting that cannot be, with what to do about it."""

    def __init__(self, message: str, suggestion: str = "") -> None:
        super().__init__(f"{message}. {suggestion}" if suggestion else message)
        self.suggestion = suggestion


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    index_path: str = ""
    pages_path: str = ""
    cache_seconds: int = 3600
    max_workers: int = 10
    crawl_delay_ms: int = 1000
    max_depth: int = 3
    user_agent: str = "quernstone/1.0"
    respect_robots: bool = True
    no_cache: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.max_workers <= 100:
            raise ConfigError(f"max_workers is {self.max_workers}", "Choose a number from 1 to 100")
        for name in ("crawl_delay_ms", "max_depth", "cache_seconds"):
            if getattr(self, name) < 0:
                raise ConfigError(f"{name} is negative", "Choose 0 or more")
        if not self.data_dir:
            raise ConfigError("data_dir is empty", "Name a folder")
        for name in ("index", "pages"):
            if not getattr(self, f"{name}_path"):
                object.__setattr__(self, f"{name}_path", f"{self.data_dir.rstrip('/')}/{name}")

    @classmethod
    def load(cls, path: str | None = None, **given) -> Config:
        """From arguments (None: not given), PREFIX variables, and a JSON file of settings."""
        values: dict[str, object] = {}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if path:
            try:
                with open(path) as f:
                    values |= json.load(f)
            except (OSError, ValueError) as e:
                raise ConfigError(f"{path} cannot be read: {e}", "Check the file") from e
        values |= {k: os.environ[PREFIX + k.upper()] for k in kinds if PREFIX + k.upper() in os.environ}
        values |= {k: v for k, v in given.items() if v is not None}
        if unknown := set(values) - set(kinds):
            raise ConfigError(f"unknown settings {', '.join(sorted(unknown))}", f"There are {', '.join(kinds)}")
        try:
            return cls(**{k: v.lower() in ("1", "true", "yes") if kinds[k] is bool and isinstance(v, str) else kinds[k](v) for k, v in values.items()})
        except (TypeError, ValueError) as e:
            raise e if isinstance(e, ConfigError) else ConfigError(str(e), "Check the type of the setting") from e

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)
