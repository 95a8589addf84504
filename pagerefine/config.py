"""Settings: defaults, then a file, then the environment, then what the caller gives; checked at the end."""

from __future__ import annotations

import copy
import json
import logging
import os
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

PREFIX = "PAGEREFINE_"
FILES = ("pagerefine.config.json", ".pagerefinerc", ".pagerefinerc.json")
WAIT = ("networkidle", "domcontentloaded", "load")
log = logging.getLogger(__name__)


class ConfigError(ValueError):
    """A setting is out of its range."""


@dataclass(frozen=True)
class Quality:
    min_score: int = 60
    js_retry_threshold: int = 85


@dataclass(frozen=True)
class Paths:
    temp_dir: str = ".tmp"
    docs_dir: str = "docs/ai/references"


@dataclass(frozen=True)
class Rendering:
    """renderer: `module:function` that gives the HTML of a page for its url, wait strategy and timeout; none by default."""

    timeout: int = 30000
    wait_strategy: str = "networkidle"
    renderer: str = ""


@dataclass(frozen=True)
class Retry:
    """Accepted, without effect."""

    max_attempts: int = 2
    backoff_ms: int = 1000


@dataclass(frozen=True)
class Config:
    quality: Quality = field(default_factory=Quality)
    paths: Paths = field(default_factory=Paths)
    rendering: Rendering = field(default_factory=Rendering)
    retry: Retry = field(default_factory=Retry)

    def as_dict(self) -> dict:
        return asdict(self)


def merge(target: dict, source: dict) -> dict:
    """target with source over it, nested dicts merged; lists, scalars and None replace."""
    out = copy.deepcopy(target)
    for key, value in source.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def find_file(folder: str | os.PathLike = ".") -> Path | None:
    """The first of FILES that exists."""
    return next((p for p in (Path(folder) / n for n in FILES) if p.exists()), None)


def snake_case(settings: dict) -> dict:
    """Keys like minScore as min_score, in sections too; the section `playwright` is the one of rendering."""
    names = {k: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", k).lower() for k in settings}
    return {"rendering" if n == "playwright" else n: snake_case(settings[k]) if isinstance(settings[k], dict) else settings[k] for k, n in names.items()}


def from_file(path: str | os.PathLike) -> dict:
    """A JSON file's settings, keys in either spelling; any failure is logged and gives none."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        log.warning("can't read %s: %s", path, e)
        return {}
    return snake_case(found) if isinstance(found, dict) else {}


def _leading_int(text: str) -> int | None:
    digits = text.strip()
    sign = digits[:1] if digits[:1] in ("-", "+") else ""
    rest = digits[len(sign) :]
    n = len(rest) - len(rest.lstrip("0123456789"))
    return int(sign + rest[:n]) if n else None


def from_env(env: dict | None = None) -> dict:
    """Four variables; an empty one is unset, and a number ends before the first other character."""
    env = os.environ if env is None else env
    out: dict = {}
    for name, section, key, number in (
        ("MIN_SCORE", "quality", "min_score", True), ("JS_RETRY_THRESHOLD", "quality", "js_retry_threshold", True),
        ("TEMP_DIR", "paths", "temp_dir", False), ("DOCS_DIR", "paths", "docs_dir", False),
    ):
        if text := env.get(PREFIX + name):
            out.setdefault(section, {})[key] = _leading_int(text) if number else text
    return out


def parse(settings: dict) -> Config:
    """A checked Config; missing sections and keys take defaults, unknown ones are ignored."""

    def section(name: str, kind):
        given = settings.get(name, {})
        if not isinstance(given, dict):
            raise ConfigError(f"{name} isn't a section")
        known = kind.__dataclass_fields__
        return kind(**{k: v for k, v in given.items() if k in known})

    out = Config(section("quality", Quality), section("paths", Paths), section("rendering", Rendering), section("retry", Retry))
    for name in ("min_score", "js_retry_threshold"):
        value = getattr(out.quality, name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 100:
            raise ConfigError(f"quality.{name} must be a number from 0 to 100")
    if out.rendering.wait_strategy not in WAIT:
        raise ConfigError(f"rendering.wait_strategy must be one of {', '.join(WAIT)}")
    for section_, name in (("paths", "temp_dir"), ("paths", "docs_dir")):
        if not isinstance(getattr(getattr(out, section_), name), str):
            raise ConfigError(f"{section_}.{name} must be text")
    if isinstance(out.rendering.timeout, bool) or not isinstance(out.rendering.timeout, (int, float)):
        raise ConfigError("rendering.timeout must be a number")
    if not isinstance(out.rendering.renderer, str) or out.rendering.renderer.count(":") > 1:
        raise ConfigError("rendering.renderer must be module:function")
    return out


def load(folder: str | os.PathLike = ".", env: dict | None = None, **overrides) -> Config:
    """overrides: min_quality, js_retry_threshold, temp_dir, docs_dir, wait_strategy, timeout, renderer; None is not given."""
    where = {
        "min_quality": ("quality", "min_score"), "js_retry_threshold": ("quality", "js_retry_threshold"), "temp_dir": ("paths", "temp_dir"),
        "docs_dir": ("paths", "docs_dir"), "wait_strategy": ("rendering", "wait_strategy"), "timeout": ("rendering", "timeout"),
        "renderer": ("rendering", "renderer"),
    }
    given: dict = {}
    for name, value in overrides.items():
        section, key = where[name]
        if value is not None:
            given.setdefault(section, {})[key] = value
    path = find_file(folder)
    settings = merge(Config().as_dict(), from_file(path) if path else {})
    return parse(merge(merge(settings, from_env(env)), given))
