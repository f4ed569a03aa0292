"""Settings: defaults, TOML files, environment, merging, validation, paths."""
from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

MODES, EXTRACTIONS = ("bm25", "semantic", "hybrid"), ("snippet", "entry", "full")
PREFIX, FOLDER = "NOTELOOM_", "noteloom"
#: Settings that a merge takes from the other side whatever they are.
ALWAYS = ("extraction_include_summary", "extraction_include_raw", "provider_allow_fallbacks")


@dataclass(frozen=True)
class SearchConfig:
    mode: str = "hybrid"
    top_k: int = 10
    tag_filter: str | None = None
    enable_rewrite: bool = True
    bm25_weight: float = 0.5
    semantic_weight: float = 0.5

    def with_mode(self, mode: str) -> SearchConfig:
        """Unknown modes are keyword search."""
        return replace(self, mode=mode if mode in MODES else "bm25")

    def with_top_k(self, k: int) -> SearchConfig:
        return replace(self, top_k=k)

    def with_tag_filter(self, tag: str | None) -> SearchConfig:
        return replace(self, tag_filter=tag)


@dataclass(frozen=True)
class AppConfig:
    index_dir: str = ".rag"
    api_key: str | None = None
    service_url: str | None = None
    embedding_model: str = "text-embedding"
    default_top_k: int = 10
    default_search_mode: str = "bm25"
    extraction_mode: str = "snippet"
    extraction_max_chars: int = 5000
    extraction_include_summary: bool = True
    extraction_include_raw: bool = True
    summarization_enabled: bool = False
    summarization_model: str = "local-chat"
    summarization_max_tokens: int = 500
    summarization_temperature: float = 0.3
    provider_order: tuple[str, ...] | None = None
    provider_allow_fallbacks: bool = True
    provider_only: tuple[str, ...] | None = None
    provider_ignore: tuple[str, ...] | None = None
    provider_sort: str | None = None
    provider_require_parameters: bool = False

    @classmethod
    def from_mapping(cls, values: Mapping) -> AppConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

    @classmethod
    def load(cls, path: str | Path) -> AppConfig:
        with open(path, "rb") as f:
            return cls.from_mapping(tomllib.load(f))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> AppConfig:
        return cls(**cls.env_values(env))

    @classmethod
    def env_values(cls, env: Mapping[str, str] | None = None) -> dict:
        """What variables with the prefix say; lists are separated by commas. Values that can't be read are left out."""
        env = os.environ if env is None else env
        out: dict = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is None:
                continue
            try:
                if "tuple" in str(f.type):
                    out[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
                elif "bool" in str(f.type):
                    out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
                elif f.type == "int":
                    out[f.name] = int(raw)
                elif f.type == "float":
                    out[f.name] = float(raw)
                else:
                    out[f.name] = raw
            except ValueError:
                continue
        return out

    def merge(self, other: AppConfig) -> AppConfig:
        """Settings of ``other`` win where they are not the default, and those of ``ALWAYS`` in any case."""
        base = AppConfig()
        return replace(self, **{f.name: getattr(other, f.name) for f in fields(self) if f.name in ALWAYS or getattr(other, f.name) != getattr(base, f.name)})

    def with_index_dir(self, folder: str) -> AppConfig:
        return replace(self, index_dir=folder)

    def with_default_top_k(self, k: int) -> AppConfig:
        return replace(self, default_top_k=k)

    def validate(self) -> AppConfig:
        if self.default_top_k <= 0:
            raise ValueError("default_top_k must be positive")
        if self.default_search_mode not in MODES:
            raise ValueError(f"search mode {self.default_search_mode!r} is none of {MODES}")
        if self.extraction_mode not in EXTRACTIONS:
            raise ValueError(f"extraction mode {self.extraction_mode!r} is none of {EXTRACTIONS}")
        return self

    def to_toml(self) -> str:
        def value(v) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, tuple):
                return "[" + ", ".join(map(value, v)) + "]"
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else str(v)

        return "".join(f"{k} = {value(v)}\n" for k, v in asdict(self).items() if v is not None)


def expand_home(path: str) -> Path:
    """~ and ~/x by HOME; ~name stays as it is."""
    if path == "~" or path.startswith("~/"):
        return Path(os.environ["HOME"] + path[1:])
    return Path(path)


def resolve(path: str) -> Path:
    p = expand_home(path)
    return p if p.is_absolute() else Path.cwd() / p


def _xdg(variable: str, *fallback: str) -> Path:
    if root := os.environ.get(variable):
        return Path(root) / FOLDER
    return Path(os.environ.get("HOME", "."), *fallback, FOLDER)


def config_dir() -> Path:
    return _xdg("XDG_CONFIG_HOME", ".config")


def data_dir() -> Path:
    return _xdg("XDG_DATA_HOME", ".local", "share")


def cache_dir() -> Path:
    return _xdg("XDG_CACHE_HOME", ".cache")


def default_config_path() -> Path:
    return config_dir() / "config.toml"


def find_project_root(start: str | Path) -> Path | None:
    """The nearest folder upwards that holds .git."""
    here = Path(start)
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), None)


def effective(path: str | Path | None = None, env: Mapping[str, str] | None = None) -> AppConfig:
    """Defaults, then the file where there is one, then what the environment says, be it a default or not."""
    path = Path(path) if path else default_config_path()
    return replace(AppConfig.load(path) if path.exists() else AppConfig(), **AppConfig.env_values(env))
