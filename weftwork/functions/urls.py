"""URL expressions: host, origin, validity and resolution, as native columns.

Hosts are lower-case without port, user or brackets; only http and https URLs
with a host and a possible port are valid.  Resolution follows RFC 3986 for
absolute, scheme-relative, absolute-path, relative-path and query references.
"""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::([^/?#]*))?(?:[/?#]|$)"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, group)


def host(url: Column) -> Column:
    """Host of a valid URL, else null."""
    return F.when(is_valid(url), F.lower(F.regexp_replace(_part(url, 2), r"[\[\]]", "")))


def port(url: Column) -> Column:
    """Port given in the URL, else null."""
    return _part(url, 3).try_cast("int")


def is_valid(url: Column) -> Column:
    """http or https, a host, and no port or one of 0 to 65535."""
    given = _part(url, 3)
    fits = (given == "") | (given.rlike(r"^[0-9]{1,5}$") & (F.coalesce(given.try_cast("int"), F.lit(-1)).between(0, 65535)))
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https") & (F.regexp_replace(_part(url, 2), r"[\[\]]", "") != "") & fits, F.lit(False))


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case without the scheme's own port."""
    scheme, given = F.lower(_part(url, 1)), port(url)
    own = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80))
    tail = F.when(given.isNull() | (given == own), F.lit("")).otherwise(F.concat(F.lit(":"), given.cast("string")))
    return F.when(is_valid(url), F.concat(scheme, F.lit("://"), F.lower(_part(url, 2)), tail))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"#.*$", "")


def path(url: Column) -> Column:
    """Path and query, ``/`` if there is none."""
    rest = F.regexp_replace(without_fragment(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def absolute(base: Column, href: Column) -> Column:
    """Fast path: hrefs that begin with ``/`` or a scheme, resolved natively; others are null."""
    ref = without_fragment(href)
    root = F.regexp_extract(F.trim(base), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(ref.rlike("^//"), F.concat(F.lower(_part(base, 1)), F.lit(":"), ref)).when(ref.rlike("^/"), F.concat(root, ref)).when(ref.rlike(r"^[hH][tT][tT][pP][sS]?://"), ref)


@F.arrow_udf(StringType())
def join_url(base: pa.Array, href: pa.Array) -> pa.Array:
    """Any reference, resolved and without its fragment; null where it cannot be resolved."""
    out = []
    for a, b in zip(base.to_pylist(), href.to_pylist()):
        try:
            out.append(None if a is None or b is None else urldefrag(urljoin(a, b.strip())).url)
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


def resolved(base: Column, href: Column) -> Column:
    """Any reference to an http or https page: the fast path, or ``join_url`` where that is null; empty ones are null."""
    other = F.when(F.trim(href) != "", join_url(base, href))
    return F.coalesce(absolute(base, href), F.when(is_valid(other), other))


def limiter_key(domain: Column) -> Column:
    """Key of the rate limiter: trimmed, lower-case, without trailing dots."""
    return F.regexp_replace(F.lower(F.trim(domain)), r"\.+$", "")
