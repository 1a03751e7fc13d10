"""Asset addresses and restore paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asset_uri(project: Column | str, asset: Column | str, version: Column | str, representation: Column | str) -> Column:
    """asset://project/asset/version/representation"""
    return F.concat(F.lit("asset://"), F.concat_ws("/", project, asset, version, representation))


def parsed_uri(uri: Column | str) -> Column:
    """(project, asset, version_spec, representation) of an address; blank parts if it is none."""
    part = lambda k: F.regexp_extract(uri, r"^asset://([^/]+)/([^/]+)/(latest|[0-9]+)/([^/]+)$", k)
    return F.struct(*(part(k + 1).alias(n) for k, n in enumerate(("project", "asset", "version_spec", "representation"))))


def restore_path(root: str, asset: Column | str, version: Column | str, filename: Column | str) -> Column:
    """root/asset/v0001/filename; versions that are not numbers stand as they are."""
    v = F.col(version) if isinstance(version, str) else version
    return F.concat_ws("/", F.lit(root), asset, F.when(v.rlike("^[0-9]+$"), F.format_string("v%04d", v.try_cast("long"))).otherwise(v), filename)
