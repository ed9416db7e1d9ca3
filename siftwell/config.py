"""Typed, bounded settings, read from TOML; driver-side only."""

from __future__ import annotations

import hashlib
import json
import math
import tomllib
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """A setting that is unknown, of the wrong type or out of bounds."""


@dataclass(frozen=True)
class Setting:
    name: str
    default: object
    low: float | None = None
    high: float | None = None
    members: tuple = ()
    build: bool = False  # whether an index must be built anew when it changes

    def checked(self, value):
        kind = type(self.default)
        if kind is tuple:
            if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
                raise ConfigError(f"{self.name}: a list of strings is needed, got {value!r}")
            return tuple(value)
        if kind in (int, float):
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ConfigError(f"{self.name}: a number is needed, got {value!r}")
            if not math.isfinite(value) or (kind is int and value != int(value)):
                raise ConfigError(f"{self.name}: {value!r} is not allowed")
            value = kind(value)
            if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
                raise ConfigError(f"{self.name}: {value} is outside [{self.low}, {self.high}]")
            return value
        if not isinstance(value, str):
            raise ConfigError(f"{self.name}: a string is needed, got {value!r}")
        if self.members and value not in self.members:
            raise ConfigError(f"{self.name}: {value!r} is none of {', '.join(self.members)}")
        return value


SUFFIXES = (
    ".py .pyi .js .jsx .mjs .cjs .ts .tsx .java .go .rs .c .h .cc .cpp .hpp .cs .rb .php .swift .kt .kts .scala .sh .bash".split()
)
SETTINGS = {
    s.name: s
    for s in (
        Setting("index.ignore", ("node_modules", "venv", "dist", "build", "__pycache__", "target"), build=True),
        Setting("index.suffixes", tuple(SUFFIXES), build=True),
        Setting("index.max_file_bytes", 5 << 20, 1, 1 << 30, build=True),
        Setting("embedding.dimensions", 384, 32, 4096, build=True),
        Setting("embedding.provider", "signed-feature-hash", members=("signed-feature-hash", "openai-compatible", "sentence-transformers"), build=True),
        Setting("embedding.endpoint", "", build=True),
        Setting("embedding.model", "", build=True),
        Setting("embedding.api_key_env", ""),
        Setting("embedding.batch", 64, 1, 4096),
        Setting("embedding.timeout", 60.0, 0.1, 3600),
        Setting("embedding.retries", 3, 0, 20),
        Setting("search.vector_recall", 50, 0, 500),
        Setting("search.vector_weight", 0.15, 0, 1),
        Setting("search.min_coverage", 0.40, 0, 1),
        Setting("search.min_concentration", 0.28, 0, 1),
        Setting("search.limit", 8, 1, 100),
        Setting("search.max_chars", 12_000, 1, 10_000_000),
        Setting("agent.max_open_bytes", 5 << 20, 1, 1 << 30),
        Setting("agent.max_open_chars", 100_000, 1, 100_000_000),
        Setting("describe.languages", ("en", "zh")),
        Setting("describe.batch", 20, 1, 1000),
        Setting("describe.max_chars", 1000, 1, 1_000_000),
        Setting("describe.skip", ()),
    )
}


@dataclass(frozen=True)
class Config:
    values: dict

    def __getitem__(self, name: str):
        return self.values[name]

    def overridden(self, **given) -> Config:
        """With search__limit=3 and the like; None says nothing."""
        out = dict(self.values)
        for k, v in given.items():
            name = k.replace("__", ".")
            if v is not None:
                out[name] = _setting(name).checked(v)
        return Config(out)

    def build_values(self) -> dict:
        return {k: v for k, v in self.values.items() if SETTINGS[k].build}

    def build_fingerprint(self) -> str:
        """A digest of the settings that decide what an index holds."""
        text = json.dumps(self.build_values(), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=list)
        return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _setting(name: str) -> Setting:
    if name not in SETTINGS:
        raise ConfigError(f"unknown setting {name}")
    return SETTINGS[name]


def defaults() -> Config:
    return Config({k: s.default for k, s in SETTINGS.items()})


def from_text(text: str) -> Config:
    try:
        read = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    out = dict(defaults().values)
    for section, body in read.items():
        if not isinstance(body, dict):
            raise ConfigError(f"unknown setting {section}")
        for key, value in body.items():
            out[f"{section}.{key}"] = _setting(f"{section}.{key}").checked(value)
    return Config(out)


def load(path: str | Path) -> Config:
    """The defaults where there is no file."""
    p = Path(path)
    return from_text(p.read_text(encoding="utf-8")) if p.exists() else defaults()


def rendered(value) -> str:
    if isinstance(value, tuple):
        return "[" + ", ".join(rendered(x) for x in value) + "]"
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return str(value)


def template() -> str:
    """All settings with their defaults, as TOML."""
    out: list[str] = []
    last = ""
    for name, s in SETTINGS.items():
        section, key = name.split(".")
        if section != last:
            out += [""] * bool(out) + [f"[{section}]"]
            last = section
        out.append(f"{key} = {rendered(s.default)}")
    return "\n".join(out) + "\n"


def updated(text: str, name: str, value) -> str:
    """The text of a settings file with one value set; comments and order stay."""
    section, key = _setting(name).name.split(".")
    line = f"{key} = {rendered(SETTINGS[name].checked(value))}"
    lines, here, at_end = text.splitlines(), "", None
    for i, old in enumerate(lines):
        bare = old.strip()
        if bare.startswith("[") and bare.endswith("]"):
            here = bare[1:-1].strip()
        elif here == section and bare.split("=")[0].strip() == key:
            comment = ""
            if "#" in old and not any(q in old.split("#")[0].split("=", 1)[1] for q in "\"'["):
                comment = "  #" + old.split("#", 1)[1]
            lines[i] = line + comment
            return "\n".join(lines) + "\n"
        if here == section and bare:
            at_end = i
    if at_end is None:
        lines += [""] * bool(lines) + [f"[{section}]", line]
    else:
        lines.insert(at_end + 1, line)
    return "\n".join(lines) + "\n"
