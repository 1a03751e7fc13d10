"""Catalogue questions: projects, assets, version groups, stages, representations and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_STAGES = ("lookdev", "modelling", "rigging", "texturing")
DEFAULT_REPRESENTATION = "blend"


def filled(*columns: Column | str) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns))


def filter_assets(assets: DataFrame, query: str, columns: tuple[str, ...] = ("code", "name", "type")) -> DataFrame:
    """Assets with the query in one of the columns, whatever the case; a blank query keeps all."""
    q = query.strip().lower()
    if not q:
        return assets
    any_of = F.lit(False)
    for c in columns:
        any_of = any_of | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    return assets.where(any_of)


def list_rows(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column free."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def project_rows(projects: DataFrame) -> DataFrame:
    """Projects with ``name`` filled from code or id, and their enum value ``id|code``."""
    key = F.col("id").cast("string")
    return projects.withColumn("name", filled("name", "code", key)).withColumn("enum_value", F.concat(key, F.lit("|"), "code"))


def decoded_enum(value: Column | str) -> Column:
    """(id, code) of an enum value, split at its first bar; both blank without one."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.instr(v, "|")
    return F.struct(F.when(at > 0, F.substring(v, F.lit(1), at - 1)).otherwise("").alias("id"), F.when(at > 0, F.substring(v, at + 1, F.length(v))).otherwise("").alias("code"))


def stage_of(stage: Column | str, fallback: Column | str) -> Column:
    """The stage in lower case, else the fallback's, else blank."""
    return F.coalesce(filled(F.lower(F.col(stage) if isinstance(stage, str) else stage)), filled(F.lower(F.col(fallback) if isinstance(fallback, str) else fallback)), F.lit(""))


def same_stage(wanted: str, stage: Column | str) -> Column:
    """A blank stage on either side fits every stage."""
    s = F.col(stage) if isinstance(stage, str) else stage
    w = wanted.strip().lower()
    return F.lit(True) if not w else (s == "") | (s == w)


def palette(assets: DataFrame, groups: DataFrame, query: str, search: tuple[str, ...] = ("code", "name", "type"), preview_assets: int = 8, preview_versions: int = 12) -> DataFrame:
    """One row a project: how many assets fit, the first codes, the chosen asset and its versions, latest first.

    The chosen asset is the first that fits, by code and then by id. Previews are cut by rank, which
    Spark limits before it shuffles, so no group is collected beyond its preview.
    ``groups`` has asset_id and version_number.
    """
    fits = filter_assets(assets, query, search)
    per = fits.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_assets"), F.min(F.struct("code", "id")).alias("c"))
    chosen = per.select("project_id", "n_assets", F.col("c.code").alias("asset_code"), F.col("c.id").alias("asset_id"))
    first = fits.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("code"))).where(F.col("rank") <= preview_assets)
    codes = first.groupBy("project_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    own = groups.join(chosen.select("asset_id"), "asset_id", "left_semi")
    last = own.withColumn("rank", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("version_number")))).where(F.col("rank") <= preview_versions)
    versions = last.groupBy("asset_id").agg(F.sort_array(F.collect_list("version_number"), False).alias("versions"))
    out = chosen.join(codes, "project_id").join(versions, "asset_id", "left")
    text = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.cast("string")), ",")
    return out.select("project_id", "n_assets", "asset_code", text(F.col("codes")).alias("codes"), text(F.col("versions").cast("array<string>")).alias("versions"))


def distinct_stages(groups: DataFrame) -> DataFrame:
    """(asset_id, stages): the stages of an asset in order, or the usual ones if it has none."""
    found = groups.groupBy("asset_id").agg(F.sort_array(F.collect_set(F.nullif("stage", F.lit("")))).alias("stages"))
    usual = F.array(*(F.lit(s) for s in DEFAULT_STAGES))
    return found.withColumn("stages", F.when(F.size("stages") == 0, usual).otherwise(F.col("stages")))


def distinct_versions(groups: DataFrame, stage: str) -> DataFrame:
    """(asset_id, version_number, label) of the versions that fit the stage."""
    rows = groups.where(same_stage(stage, "stage")).select("asset_id", "version_number").distinct()
    return rows.withColumn("label", F.format_string("v%03d", "version_number"))


def distinct_representations(groups: DataFrame, stage: str) -> DataFrame:
    """(asset_id, version_number, representations) of those that fit the stage; the usual one if there is none."""
    rep = F.when(same_stage(stage, "stage"), F.nullif("representation", F.lit("")))
    found = groups.groupBy("asset_id", "version_number").agg(F.sort_array(F.collect_set(rep)).alias("representations"))
    return found.withColumn("representations", F.when(F.size("representations") == 0, F.array(F.lit(DEFAULT_REPRESENTATION))).otherwise(F.col("representations")))


def version_fanout(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """Every asset with the number of its version groups and the latest one; 0 and null without any."""
    per = groups.groupBy(F.col("asset_id").alias("id")).agg(F.count(F.lit(1)).alias("n_groups"), F.max("version_number").alias("latest"))
    return assets.join(per, "id", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))


def switch_representation(groups: DataFrame, stage: str = "modelling") -> DataFrame:
    """(asset_id, representation): the first filled one that fits the stage, by version; the usual one if there is none."""
    fits = same_stage(stage, "stage") & (F.col("representation") != "")
    return groups.groupBy("asset_id").agg(F.coalesce(F.min_by("representation", F.when(fits, F.col("version_number"))).alias("r"), F.lit(DEFAULT_REPRESENTATION)).alias("representation"))


def my_tasks(tasks: DataFrame, users: DataFrame, name: Column | str) -> DataFrame:
    """Tasks that name a user of this name (a text or a scalar column), as assignee, assignee of many or collaborator."""
    who = F.lower(F.trim(F.lit(name)))
    mine = users.where((F.lower("username") == who) | (F.lower("name") == who)).select(F.col("id").cast("string").alias("_user"))
    ids = F.explode(F.array_compact(F.array_union(F.array(F.col("assignee_id").cast("string")), F.coalesce(F.col("collaborators").cast("array<string>"), F.array().cast("array<string>")))))
    keys = tasks.select(F.col("id").alias("_task"), ids.alias("_user")).join(mine, "_user", "left_semi").select("_task")
    return tasks.join(keys, tasks["id"] == keys["_task"], "left_semi")


def task_label(title: Column, kind: Column, stage: Column, status: Column) -> Column:
    """title, else type, else "task", with [stage] and (status) where there are any."""
    part = lambda c, a, b: F.coalesce(F.concat(F.lit(f" {a}"), filled(c), F.lit(b)), F.lit(""))
    return F.concat(F.coalesce(filled(title), filled(kind), F.lit("task")), part(stage, "[", "]"), part(status, "(", ")"))


# Module names in the order in which they are looked for.
HOSTS = (
    ("bpy", "blender"), ("maya.cmds", "maya"), ("maya", "maya"), ("pymel", "maya"), ("hou", "houdini"), ("nuke", "nuke"), ("unreal", "unreal"), ("nuke_internal", "nuke"),
    ("c4d", "cinema4d"), ("rt", "3dsmax"), ("MaxPlus", "3dsmax"), ("substance_painter", "substance_painter"), ("sd", "substance_designer"), ("mari", "mari"),
)
EXECUTABLES = (("blender", "%blender%"), ("maya", "%maya%"), ("houdini", "%houdini%"), ("houdini", "hfs%"), ("nuke", "%nuke%"), ("unreal", "%unreal%"), ("unreal", "%ue4editor%"), ("unreal", "%ueeditor%"))


def host_name(modules: Column, hint: Column, executable: Column) -> Column:
    """The host application: by loaded modules, else by the hint, else by the executable's name, else N/A."""
    out = F.when(F.lit(False), "")
    for module, name in HOSTS:
        out = out.when(F.array_contains(modules, module), name)
    out = out.when(filled(hint).isNotNull(), F.lower(F.trim(hint)))
    base = F.lower(F.substring_index(executable, "/", -1))
    for name, pattern in EXECUTABLES:
        out = out.when(base.like(pattern), name)
    return out.otherwise("N/A")
