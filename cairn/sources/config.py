"""Settings of a store and its remotes, as JSON beside the tables."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

SCHEMA_VERSION = 1
INSECURE = ("http",)
#: Settings a user may change by name.
USER_KEYS = ("user.name", "user.email")


@dataclass(frozen=True)
class Config:
    """Values are clamped on load: a level outside 1..19 and an interval below 10 s go to the nearest limit."""

    user_name: str = ""
    user_email: str = ""
    compress: bool = True
    compression_level: int = 3
    trust_mtime: bool = False
    watch_interval: int = 300
    keep_autos: int = 50
    version: int = SCHEMA_VERSION

    def normalised(self) -> Config:
        return replace(self, compression_level=min(max(self.compression_level, 1), 19), watch_interval=max(self.watch_interval, 10), keep_autos=max(self.keep_autos, 0))

    def validate(self) -> None:
        if self.version != SCHEMA_VERSION:
            raise ValueError(f"unknown settings version {self.version}")

    def with_environment(self, env: dict[str, str] | None = None) -> Config:
        """CAIRN_USER_NAME and CAIRN_USER_EMAIL take the place of the stored values."""
        env = dict(os.environ) if env is None else env
        return replace(self, user_name=env.get("CAIRN_USER_NAME", self.user_name), user_email=env.get("CAIRN_USER_EMAIL", self.user_email))

    def set(self, key: str, value: str) -> Config:
        if key not in USER_KEYS:
            raise KeyError(key)
        return replace(self, **{key.replace(".", "_"): value})

    def get(self, key: str) -> str:
        if key not in USER_KEYS:
            raise KeyError(key)
        return getattr(self, key.replace(".", "_"))


def load_config(path: str) -> Config:
    if not os.path.exists(path):
        return Config()
    known = Config.__dataclass_fields__
    config = Config(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known}).normalised()
    config.validate()
    return config


def save_config(path: str, config: Config) -> None:
    part = f"{path}.partial"
    Path(part).write_text(json.dumps(asdict(config.normalised()), indent=1))
    os.replace(part, path)


@dataclass
class Remotes:
    """Named remote stores: a name and the location of its tables, any path Spark can read and write."""

    locations: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, location: str, allow_insecure: bool = False) -> None:
        scheme = location.partition("://")[0] if "://" in location else ""
        if scheme in INSECURE and not allow_insecure:
            raise ValueError(f"plain {scheme} is not allowed unless asked for: {location}")
        self.locations[name] = location

    def remove(self, name: str) -> None:
        del self.locations[name]

    def rename(self, old: str, new: str) -> None:
        if new in self.locations:
            raise ValueError(f"remote {new} exists")
        self.locations = {new if k == old else k: v for k, v in self.locations.items()}

    def find(self, name: str | None = None) -> str:
        """The location of a remote; without a name, of the only one."""
        if name is None and len(self.locations) == 1:
            return next(iter(self.locations.values()))
        if name not in self.locations:
            raise KeyError(f"no remote {name!r}")
        return self.locations[name]

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.locations, indent=1))

    @classmethod
    def load(cls, path: str) -> Remotes:
        return cls(json.loads(Path(path).read_text()) if os.path.exists(path) else {})
