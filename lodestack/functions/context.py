"""Small documents that hosts exchange: launch contexts, issues, publish requests, heartbeats, themes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.operators.catalog import filled

CONTEXT_FIELDS = ("intent", "dcc", "project_id", "project_code", "asset_id", "asset_code", "shot_id", "task_id", "representation", "current_file", "user_id", "session_id", "api_base_url")
CONTEXT = "struct<" + ",".join(f"{c}:string" for c in CONTEXT_FIELDS) + ",version_spec:map<string,string>>"
REQUIRED = ("intent", "project_id", "dcc")
PUBLISH_STAGES = ("", "modelling", "texturing", "rigging", "lookdev")


def launch_context(text: Column | str) -> Column:
    """The context of a JSON text; null if it is blank, no object, or lacks a required field."""
    c = F.from_json(text, CONTEXT)
    ok = F.lit(True)
    for name in REQUIRED:
        ok = ok & c[name].isNotNull()
    return F.when(ok, c)


def lenient_context(text: Column | str) -> Column:
    """The twin that fills what is missing: blank fields, spec "1" and the host blender; null for no object."""
    c = F.from_json(text, CONTEXT)
    t = F.col(text) if isinstance(text, str) else text
    spec = F.coalesce(c["version_spec"]["version"], F.lit("1"))
    return F.when(
        F.ltrim(t).startswith("{") & F.try_parse_json(t).isNotNull(),
        F.struct(F.coalesce(c["intent"], F.lit("")).alias("intent"), F.coalesce(c["project_id"], F.lit("")).alias("project_id"), F.coalesce(c["dcc"], F.lit("blender")).alias("dcc"), spec.alias("version")),
    )


def joined_url(base: Column | str, path: Column | str) -> Column:
    """The base without slashes at its end and the path, with a slash before it if it has none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(F.regexp_replace(base, "/+$", ""), F.when(path.startswith("/"), "").otherwise("/"), path)


def issue_problem(title: Column | str, project: Column | str) -> Column:
    """Why an issue cannot be sent, or null."""
    return F.when(filled(title).isNull(), "title_required").when(filled(project).isNull(), "project_required")


def publish_problem(project: Column | str, asset: Column | str, stage: Column | str, path: Column | str) -> Column:
    """Why a publish request is refused, or null: the first failed check."""
    s = F.lower(F.trim(F.coalesce(F.col(stage) if isinstance(stage, str) else stage, F.lit(""))))
    return F.when(filled(project).isNull(), "project_required").when(filled(asset).isNull(), "asset_required").when(~s.isin(*PUBLISH_STAGES), "unknown_stage").when(filled(path).isNull(), "file_missing")


def heartbeat(user: Column | str, session: Column | str, representation: Column | str, fresh: Column) -> Column:
    """A heartbeat with defaults: the user blender_user, a fresh session id and the representation blend."""
    return F.struct(F.coalesce(filled(user), F.lit("blender_user")).alias("user_id"), F.coalesce(filled(session), fresh).alias("session_id"), F.coalesce(filled(representation), F.lit("blend")).alias("representation"))


def themed(template: Column | str, tokens: Column | str) -> Column:
    """A template with each {key} replaced by the value of that key of a map; unknown keys stay."""
    entries = F.array_sort(F.map_entries(tokens))
    return F.aggregate(entries, F.col(template) if isinstance(template, str) else template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def load_route(hit: Column, size: Column, is_manifest: Column, small: int = 256 << 10) -> Column:
    """How content gets to the cache: hit, manifest, small or large; only known sizes up to ``small`` are looked into."""
    looked_at = size.isNotNull() & (size <= small)
    return F.when(hit, "hit").when(looked_at & is_manifest, "manifest").when(looked_at, "small").otherwise("large")
