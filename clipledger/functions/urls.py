"""URL pieces, media extensions and the outbound URL policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.constants import (
    ALLOWED_PORTS,
    EXTENSIONS,
    INFERRED_EXTENSIONS,
    LOCAL_SUFFIXES,
    MEDIA_HOST_SUFFIX,
    MEDIA_HOSTS,
)
from clipledger.functions.shared import whole_number

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)"
_HOST = r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::([0-9]*))?$"
_BAD_HOST = r"[\s<>^|%\[\]]"
_QUAD = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def url_suffix(url: Column) -> Column:
    """Lower-cased text after the last dot of the file name, query excluded; null when there is none."""
    name = F.substring_index(F.substring_index(url, "?", 1), "/", -1)
    tail = F.substring_index(name, ".", -1)
    return F.when((tail != name) & (tail != ""), F.lower(tail))


def query_format(url: Column) -> Column:
    """Value of the first non-empty ``format`` query parameter."""
    query = F.when(F.instr(url, "?") > 0, F.substring(url, F.instr(url, "?") + 1, F.length(url)))
    return F.nullif(F.lower(F.regexp_extract(query, "(?i)(?:^|&)format=([^&]+)", 1)), F.lit(""))


def clean_extension(ext: Column) -> Column:
    """A known-safe extension; anything else is mp4."""
    bare = F.regexp_replace(F.trim(ext), r"^\.+", "")
    bare = F.lower(F.regexp_extract(bare, r"^([^/\\?#]*)", 1))
    return F.when(bare.isin(EXTENSIONS), bare).otherwise("mp4")


def media_extension(media_type: Column, url: Column) -> Column:
    last = F.substring_index(F.substring_index(url, ".", -1), "?", 1)
    by_type = (
        F.when(media_type == "gif", "gif").when(media_type.isin("image", "photo"), "jpg").otherwise("mp4")
    )
    return clean_extension(
        F.coalesce(
            url_suffix(url),
            query_format(url),
            F.when(media_type == "gif", "gif"),
            F.when(last.isin(INFERRED_EXTENSIONS), last),
            by_type,
        )
    )


#: URLs that are read as they are written.
_PLAIN = r"^https?://[^/\\\x00-\x20](?:[^\t\n\r]*[^\x00-\x20])?\z"


def _normal(url: Column) -> Column:
    """As URL parsers read it: no tab or line break, and for http and https any run of slashes, or none, opens the host."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    read = F.regexp_replace(bare, r"^([Hh][Tt][Tt][Pp][Ss]?):[/\\]*", "$1://")
    return F.when(url.rlike(_PLAIN), url).otherwise(read)


def with_policy(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, port and reason: the first failing rule, ``ok`` when none fails.

    Pieces are staged as columns, so each pattern runs once per row.
    """
    scheme, server, host, port = F.col("_scheme"), F.col("_server"), F.col("host"), F.col("port")
    staged = (
        df.withColumn("_url", _normal(F.col(url)))
        .withColumn("_scheme", F.lower(F.regexp_extract("_url", _SCHEME, 1)))
        # authority without user information
        .withColumn("_server", F.regexp_extract(F.regexp_extract("_url", _AUTHORITY, 1), r"([^@]*)$", 1))
        .withColumn("host", F.regexp_replace(F.lower(F.regexp_extract("_server", _HOST, 1)), r"\.+$", ""))
        .withColumn("host", F.nullif("host", F.lit("")))
        .withColumn(
            "port",
            F.coalesce(
                whole_number(F.regexp_extract("_server", _HOST, 2), "int"),
                F.when(scheme == "https", 443).when(scheme == "http", 80),
            ),
        )
    )
    unreadable = (
        F.col("_url").isNull()
        | (scheme == "")
        | (scheme.isin("http", "https") & (server == ""))
        | ((server != "") & (~server.rlike(_HOST) | (host.rlike(_BAD_HOST) & ~host.startswith("["))))
        | (port > 65_535)
    )
    local = host == "localhost"
    for suffix in LOCAL_SUFFIXES:
        local = local | host.endswith(suffix)
    reason = (
        F.when(unreadable, "parse error")
        .when(scheme != "https", "non-https url")
        .when(host.isNull(), "missing url host")
        .when(local, "local hostname rejected")
        .when(host.rlike(_QUAD), "ip literal rejected")
        .when(~(host.isin(MEDIA_HOSTS) | host.endswith(MEDIA_HOST_SUFFIX)), "host not on allowlist")
        .when(~port.isin(ALLOWED_PORTS), "port not allowed")
        .otherwise("ok")
    )
    return staged.withColumn("reason", reason).drop("_url", "_scheme", "_server")
