"""URL columns, by regex so that one odd address never fails a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions import rules

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(c, i: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(_c(c), F.lit(""))), URL_PARTS, i)


def host_of(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_part(c, 2)), r":\d*$", ""), r"\.+$", "")


def is_allowed_url(c, hosts) -> Column:
    """http(s), no credentials, and the host is one of ``hosts`` or below one."""
    host = host_of(c)
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h) | host.endswith("." + h)
    return F.lower(_part(c, 1)).isin("http", "https") & (host != "") & ~F.contains(_part(c, 2), F.lit("@")) & listed


def is_url(c) -> Column:
    return F.lower(_part(c, 1)).isin("http", "https") & (_part(c, 2) != "")


def canonical_url(c, drop_query_hosts=()) -> Column:
    """Scheme and host in lower case, no trailing slash, path parameters or fragment; listed hosts lose the query."""
    raw = F.trim(F.coalesce(_c(c), F.lit("")))
    net = F.lower(_part(c, 2))
    path = F.regexp_replace(F.regexp_replace(_part(c, 3), r";[^/]*$", ""), "/+$", "")
    query = F.regexp_replace(_part(c, 4), r"^\?$", "")
    dropped = F.lit(False)
    for h in drop_query_hosts:
        dropped = dropped | net.endswith(h)
    url = F.concat(
        F.lower(_part(c, 1)), F.lit("://"), net, F.when(path == "", F.lit("/")).otherwise(path),
        F.when(dropped, F.lit("")).otherwise(query),
    )
    return F.when(is_url(c), url).otherwise(raw)


def extract_media_id(c, least: int = 15, most: int = 22) -> Column:
    """First stand-alone digit run of the given length; empty when there is none."""
    return F.regexp_extract(F.coalesce(_c(c), F.lit("")), rf"\b(\d{{{least},{most}}})\b", 1)


def to_https(c) -> Column:
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), "^http://", "https://")


def link_safety(c) -> Column:
    """Class of a link or path: safe, relative, absolute_path, unsafe_scheme or unknown_scheme."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"^[A-Za-z]:[\\/]"), "absolute_path")
        .when(scheme.isin(*rules.UNSAFE_SCHEMES), "unsafe_scheme")
        .when(scheme.isin(*rules.SAFE_SCHEMES), "safe")
        .when(scheme != "", "unknown_scheme")
        .when(t.startswith("//"), "safe")
        .when(t.startswith("/"), "absolute_path")
        .otherwise("relative")
    )
