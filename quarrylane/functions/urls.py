"""URLs of a crawled site as column expressions: canonical form, scope, parts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylane.functions import vocabulary as v


def canonical_url(url: str, base: str | None = None) -> str:
    """Absolute, https, lower-case host, no fragment, only page parameters (sorted), no trailing slash."""
    p = urlsplit(urljoin(base, url) if base else url)
    path = p.path.rstrip("/") if len(p.path) > 1 else p.path
    query = urlencode(sorted((k, x) for k, x in parse_qsl(p.query) if k == "page"))
    return urlunsplit(("https", p.netloc.lower(), path, query, ""))


@F.pandas_udf(StringType())
def _canonical(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else canonical_url(u, b) for u, b in zip(url, base, strict=True)], dtype="object")


def canonical(url: Column | str, base: Column | str | None = None) -> Column:
    """Relative references need a full resolver, so this is a vectorised UDF."""
    return _canonical(F.col(url) if isinstance(url, str) else url, F.lit(None).cast("string") if base is None else (F.col(base) if isinstance(base, str) else base))


def _part(url: Column | str, pattern: str) -> Column:
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, pattern, 1)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value); as a variable of a lambda the value is found once, and not for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def host(url: Column | str) -> Column:
    return F.lower(_part(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"))


def path(url: Column | str) -> Column:
    return _part(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)")


def allowed(url: Column | str, site: str) -> Column:
    """Within the site and the crawled prefix; no assets, no excluded parts, not the bare root."""

    def crawled(p: Column) -> Column:
        ok = p.startswith(v.PATH_PREFIX) & ~p.isin(v.PATH_PREFIX, v.PATH_PREFIX.rstrip("/"))
        for part in v.EXCLUDED_PARTS:
            ok = ok & ~F.contains(p, F.lit(part))
        return ok & ~_once(F.lower(p), lambda low: reduce(Column.__or__, [low.endswith(end) for end in v.ASSETS]))

    return (host(url).isin("", site)) & _once(path(url), crawled)


def _segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def slug(url: Column | str) -> Column:
    s = _segments(url)
    return F.when((F.get(s, F.lit(0)) == v.PATH_PREFIX.strip("/")) & (F.get(s, F.lit(1)) != v.AREA_INDEX), F.get(s, F.lit(1)))


def area_page(url: Column | str) -> Column:
    """The kind of supporting page of an area, if the url is one."""
    s = _segments(url)
    last = F.get(s, F.lit(2))
    return F.when((F.size(s) == 3) & (F.get(s, F.lit(0)) == v.PATH_PREFIX.strip("/")) & last.isin(*v.AREA_PAGES), last)


def is_area_index(url: Column | str) -> Column:
    return F.regexp_replace(path(url), r"/+$", "") == v.PATH_PREFIX + v.AREA_INDEX


def seed(url: Column | str, site: str) -> Column:
    """The site's bare city page, which has no content, stands for the area index."""
    u = canonical(url)
    root = f"https://{site}{v.PATH_PREFIX.rstrip('/')}"
    return F.when(u == root, f"{root}/{v.AREA_INDEX}").otherwise(u)
