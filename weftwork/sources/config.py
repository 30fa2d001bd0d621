"""Crawl settings: strict JSON, every field checked on the driver."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

from weftwork.operators.admission import java_pattern


class ConfigError(ValueError):
    """A setting is unknown, of the wrong kind or out of range; the message names its path."""


@dataclass(frozen=True)
class Crawl:
    # The defaults.
    start_urls: tuple[str, ...] = ()
    sitemap_urls: tuple[str, ...] = ()
    max_concurrent: int = 10
    limit_per_host: int | None = None
    max_pages: int = 100
    max_depth: int = 2
    same_domain_only: bool = True
    filter_external_links: bool = False
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    connect_timeout: float = 5.0
    read_timeout: float = 15.0
    total_timeout: float = 30.0
    timeout_multiplier: float = 2.0
    max_timeout: float = 120.0
    requests_per_second: float | None = None
    respect_robots: bool = False
    min_delay: float = 0.0
    jitter: float = 0.0
    user_agent: str = "weft/1.0"
    max_attempts: int = 4
    retry_base_delay: float = 0.5
    retry_max_delay: float = 30.0

    @property
    def effective_rate(self) -> float | None:
        """Requests a second: 1 where a politeness option is on and no rate is set."""
        polite = self.respect_robots or self.min_delay > 0 or self.jitter > 0
        return self.requests_per_second if self.requests_per_second is not None else 1.0 if polite else None


@dataclass(frozen=True)
class Reporting:
    show_progress: bool = False
    progress_interval: float = 1.0
    json_report: str | None = None
    html_report: str | None = None


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"
    file: str | None = None
    max_bytes: int = 10_485_760
    backup_count: int = 3


@dataclass(frozen=True)
class Settings:
    start_urls: tuple[str, ...] = ()
    sitemap_urls: tuple[str, ...] = ()
    crawl: Crawl = field(default_factory=Crawl)
    storage: tuple[dict, ...] = ()
    reporting: Reporting = field(default_factory=Reporting)
    logging: Logging = field(default_factory=Logging)

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(asdict(self)))

    @property
    def seeds(self) -> tuple[str, ...]:
        """The first pages, those named at the top before those of the crawl."""
        return tuple(dict.fromkeys((*self.start_urls, *self.crawl.start_urls)))

    def check_sources(self) -> None:
        """ConfigError if there is nothing to begin with, after all settings have been put together."""
        if not self.seeds and not self.sitemap_urls and not self.crawl.sitemap_urls:
            raise ConfigError("start_urls or sitemap_urls must name at least one URL")


#: Lowest value by field; what is listed as POSITIVE must be above it.
LEAST = {"max_concurrent": 1, "limit_per_host": 1, "max_pages": 1, "max_depth": 0, "max_attempts": 1, "timeout_multiplier": 1, "min_delay": 0, "jitter": 0, "retry_base_delay": 0, "retry_max_delay": 0, "max_bytes": 1, "backup_count": 0}
POSITIVE = {"connect_timeout", "read_timeout", "total_timeout", "max_timeout", "requests_per_second", "progress_interval"}
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def _checked(name: str, kind: str, value: Any, section: str = "crawl") -> Any:
    at = f"{section}.{name}"
    if value is None and "None" in kind:
        return None
    if "tuple" in kind:
        if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) and x.strip() for x in value):
            raise ConfigError(f"{at} must be a list of non-blank strings")
        if name.endswith("_patterns"):
            try:
                return tuple(map(java_pattern, value)) and tuple(value)
            except ValueError as error:
                raise ConfigError(f"{at}: {error}") from error
        return tuple(value)
    if kind == "bool":
        if not isinstance(value, bool):
            raise ConfigError(f"{at} must be true or false")
        return value
    if kind.startswith("str"):
        if not isinstance(value, str) or not value.strip():
            raise ConfigError(f"{at} must be a non-blank string")
        return value
    allowed = (int,) if kind.startswith("int") else (int, float)
    if isinstance(value, bool) or not isinstance(value, allowed) or not math.isfinite(value):
        raise ConfigError(f"{at} must be a finite {'integer' if allowed == (int,) else 'number'}")
    if value < LEAST.get(name, value) or name in POSITIVE and value <= 0:
        raise ConfigError(f"{at} is too small")
    return value if kind.startswith("int") else float(value)


def _section(kind: type, name: str, given: Any):
    kinds = {f.name: str(f.type) for f in fields(kind)}
    if not isinstance(given, dict):
        raise ConfigError(f"{name} must be an object: {given!r}")
    if unknown := sorted(set(given) - set(kinds)):
        raise ConfigError(f"{name} has unknown keys: {', '.join(map(str, unknown))}")
    return kind(**{k: _checked(k, kinds[k], v, name) for k, v in given.items()})


def _urls(name: str, value: Any) -> tuple[str, ...]:
    """Absolute http and https URLs, each once, in order."""
    if not isinstance(value, (list, tuple)):
        raise ConfigError(f"{name} must be a list")
    out: dict[str, None] = {}
    for i, x in enumerate(value):
        try:
            parts = urlsplit(x.strip()) if isinstance(x, str) else None
            fine = parts is not None and parts.scheme in ("http", "https") and bool(parts.hostname) and (parts.port or 1) > 0
        except ValueError:
            fine = False
        if not fine:
            raise ConfigError(f"{name}[{i}] must be an absolute http or https URL")
        out.setdefault(x.strip())
    return tuple(out)


def from_dict(value: dict[str, Any], base: str | Path | None = None) -> Settings:
    """Settings from plain JSON values; unknown keys are refused at each level.

    With ``base`` the paths of storage, reports and the log begin there, unless they
    are absolute; a ``~`` stays as it is.
    """
    if not isinstance(value, dict):
        raise ConfigError("the settings must be an object")
    if unknown := sorted(set(value) - {f.name for f in fields(Settings)}):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    crawl = _section(Crawl, "crawl", value.get("crawl", {}))
    if crawl.max_timeout < max(crawl.connect_timeout, crawl.read_timeout, crawl.total_timeout):
        raise ConfigError("crawl.max_timeout must not be below the first timeouts")
    if crawl.retry_max_delay < crawl.retry_base_delay:
        raise ConfigError("crawl.retry_max_delay must not be below crawl.retry_base_delay")
    storage = value.get("storage", [])
    if not isinstance(storage, list) or not all(isinstance(x, dict) and x.get("type") in ("json", "csv", "sqlite") and isinstance(x.get("path"), str) and x["path"].strip() for x in storage):
        raise ConfigError("storage must be a list of objects with type (json, csv, sqlite) and path")
    reporting, logging = _section(Reporting, "reporting", value.get("reporting", {})), _section(Logging, "logging", value.get("logging", {}))
    if logging.level not in LEVELS:
        raise ConfigError(f"logging.level must be one of {', '.join(LEVELS)}")
    if reporting.json_report is not None and reporting.json_report == reporting.html_report:
        raise ConfigError("reporting.json_report and reporting.html_report must differ")
    at = lambda path: path if path is None or base is None else str(Path(base) / path)
    return Settings(
        _urls("start_urls", value.get("start_urls", [])),
        _urls("sitemap_urls", value.get("sitemap_urls", [])),
        crawl,
        tuple({**x, "path": at(x["path"])} for x in storage),
        replace(reporting, json_report=at(reporting.json_report), html_report=at(reporting.html_report)),
        replace(logging, file=at(logging.file)),
    )


def from_json(path: str) -> Settings:
    """Settings of a UTF-8 JSON file; NaN and Infinity are refused, relative paths start at the file."""

    def refuse(name: str) -> None:
        raise ConfigError(f"{name} is not a JSON number")

    try:
        value = json.loads(Path(path).read_bytes().decode("utf-8"), parse_constant=refuse)
    except (OSError, UnicodeError, json.JSONDecodeError) as error:
        raise ConfigError(f"{path} cannot be read: {error}") from error
    return from_dict(value, Path(path).absolute().parent)
