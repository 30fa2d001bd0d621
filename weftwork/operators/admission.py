"""URL admission: hosts, exclude and include patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import urls


def java_pattern(pattern: str) -> str:
    """A Python regular expression as Spark's ``rlike`` takes it; ValueError if blank or invalid."""
    if not isinstance(pattern, str) or not pattern.strip():
        raise ValueError("a URL pattern must be a non-blank string")
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid URL pattern {pattern!r}: {error}") from error
    return pattern.replace("(?P<", "(?<")


def domain_name(value: str) -> str:
    """The host of a domain as settings name it: lower case, without port or brackets; ValueError if it has a path, query or fragment."""
    try:
        parts = urlsplit(f"//{value.strip()}")
        host, _ = parts.hostname, parts.port
    except ValueError as error:
        raise ValueError(f"invalid domain {value!r}: {error}") from error
    if not host or parts.path or parts.query or parts.fragment or any(x.isspace() for x in host):
        raise ValueError(f"invalid domain {value!r}")
    return host


class UrlFilter:
    """Admits valid URLs of allowed hosts that no exclude pattern and some include pattern finds.

    Without allowed hosts every host is admitted; without include patterns every
    URL is included; exclude beats include.
    """

    def __init__(self, allowed: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), same_domain_only: bool = True):
        self.allowed = [domain_name(x) for x in allowed]
        if same_domain_only and not self.allowed:
            raise ValueError("same_domain_only needs at least one host")
        self.same_domain_only = same_domain_only
        self.include, self.exclude = [java_pattern(x) for x in include], [java_pattern(x) for x in exclude]

    def column(self, url: Column) -> Column:
        """Whether a URL is admitted; the hosts are a list of seeds, which the caller holds."""
        text = F.trim(url)
        out = urls.is_valid(url)
        if self.same_domain_only:
            out = out & F.coalesce(urls.host(url).isin(self.allowed), F.lit(False))
        for pattern in self.exclude:
            out = out & ~text.rlike(pattern)
        if self.include:
            some = F.lit(False)
            for pattern in self.include:
                some = some | text.rlike(pattern)
            out = out & some
        return F.coalesce(out, F.lit(False))


def same_hosts(rows: DataFrame, seeds: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` whose host is a host of ``seeds``: a semi-join, so seeds may be many."""
    hosts = seeds.select(urls.host(F.col(url)).alias("_host")).where("_host is not null").distinct()
    return rows.withColumn("_host", urls.host(F.col(url))).join(hosts, "_host", "left_semi").drop("_host")
