"""Queries on canonical forms; the scenes are made from customers and documents by like expressions in both engines."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lodestack.functions import scenes
from lodestack.plans.registry import query
from lodestack.sources import tables

P = scenes.PLACEHOLDER
# ${k} is the customer's key.
SCENE = "\n".join(
    (
        "//Maya ASCII 2024 scene",
        "// Created by Maya on ${k}",
        "//Last modified: ${k}",
        '\trequires maya "${k}";',
        'fileInfo "application" "maya ${k}";',
        'fileInfo "custom" "kept ${k}";',
        'fileInfo "os" "x \\"${k}\\" y";',
        'workspace -fr "images" "dir${k}";',
        'createNode transform -n "n${k}";',
        '\trename -uid "${k}-AB";',
        'createNode animCurveTL -n "c${k}";',
        '\tsetAttr ".ktv[0:1]"  1 ${k}.25 2 0.5;',
        'setAttr ".vt" -type "pointArray" 1 ${k}.5;',
        "plain ${k}",
    )
)
CANONICAL = "\n".join(
    (
        "//Maya ASCII scene",
        "// Created by Maya",
        f'\trequires maya "{P}";',
        f'fileInfo "application" "{P}";',
        'fileInfo "custom" "kept ${k}";',
        f'fileInfo "os" "{P}";',
        'createNode transform -n "n${k}";',
        f'\trename -uid "{scenes.ZERO_UUID}";',
        'createNode animCurveTL -n "c${k}";',
        '\tsetAttr ".ktv[0:1]"  1 ${k}.25 2 0.5;',
        'setAttr ".vt" -type "pointArray" 1 ${k}.5;',
        "plain ${k}",
    )
)
_sql = lambda t: "replace('" + t.replace("'", "''") + "', '${k}', CAST(c_custkey AS VARCHAR))"


def _scene(text: str):
    return F.replace(F.lit(text), F.lit("${k}"), F.col("c_custkey").cast("string"))


def _customers(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").select("c_custkey")


@query("text_scene_lines", f"SELECT c_custkey, {_sql(CANONICAL)} AS canonical FROM customer")
def text_scene_lines(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", scenes.canonical_lines(F.replace(_scene(SCENE), F.lit("\n"), F.lit("\r\n"))).alias("canonical"))


STATEFUL = 'createNode script -n "uiConfigurationScriptNode";\n\tsetAttr ".b" -type "string" "begin ${k}\nmore \\";\nend";\nsetAttr ".st" 3;\nselect -ne :time1;\nsetAttr ".b" -type "string" "kept ${k}";\nsetAttr ".d" -type "dataPolyComponent" "Index\n${k}";\nlast'
STATEFUL_CANONICAL = f'createNode script -n "uiConfigurationScriptNode";\n\tsetAttr ".b" -type "string" "{P}";\nsetAttr ".st" 3;\nselect -ne :time1;\nsetAttr ".b" -type "string" "kept ${{k}}";\nsetAttr ".d" -type "dataPolyComponent" "{P}";\nlast'


@query("text_scene_canonical", f"SELECT c_custkey, {_sql(CANONICAL + chr(10) + STATEFUL_CANONICAL)} AS canonical FROM customer")
def text_scene_canonical(spark, sf_dir):
    raw = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(_scene(SCENE + "\n" + STATEFUL), "UTF-8"))
    return _customers(spark, sf_dir).select("c_custkey", F.decode(scenes.canonical(raw, F.lit("text")), "UTF-8").alias("canonical"))


@query(
    "semantic_anchors",
    f"""WITH l AS (SELECT c_custkey, unnest(string_split({_sql(SCENE)}, chr(10))) AS line, generate_subscripts(string_split({_sql(SCENE)}, chr(10)), 1) AS i FROM customer),
    o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY c_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM l)
    SELECT c_custkey, array_to_string(list(CAST(o.at AS BIGINT) ORDER BY i), ',') AS anchors FROM o
    WHERE ltrim(line, chr(9) || ' ') LIKE 'createNode animCurve%' OR (contains(line, '.ktv[') AND ltrim(line, chr(9) || ' ') LIKE 'setAttr %') OR contains(line, '-type "pointArray"') GROUP BY 1""",
)
def semantic_anchors(spark, sf_dir):
    @F.pandas_udf("array<bigint>")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else scenes.anchor_offsets(bytes(b)))

    found = run(F.encode(_scene(SCENE), "UTF-8"))
    return _customers(spark, sf_dir).select("c_custkey", F.array_join(found.cast("array<string>"), ",").alias("anchors"))


@query("float_quantize", "SELECT c_custkey, 'setAttr \".vt\" -type \"pointArray\" 2 ' || c_custkey || '.25000 -0.12300 \"1.5\" 1000.00000 x1.5;' AS line FROM customer")
def float_quantize(spark, sf_dir):
    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        scene = scenes.TextScene(quantize=5)
        return lines.map(lambda x: "\n".join(scene.lines([x])))

    return _customers(spark, sf_dir).select("c_custkey", run(_scene('setAttr ".vt" -type "pointArray" 2 ${k}.25 -.123 "1.5" 1e3 x1.5;'.replace("1e3", "1.0e3"))).alias("line"))


@query("stage_detect", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'usda' WHEN 1 THEN 'usdc' WHEN 2 THEN 'usdz' WHEN 3 THEN 'unknown' ELSE 'usda' END AS format FROM documents")
def stage_detect(spark, sf_dir):
    k = F.col("doc_id") % 5
    head = F.when(k == 0, F.lit("#usda 1.0\n")).when(k == 1, "PXR-USDC").when(k == 2, "PK\x03\x04").when(k == 3, " PXR-USDC").otherwise(" \t\n#usda")
    return tables.read(spark, sf_dir, "documents").select("doc_id", scenes.stage_format_column(F.encode(F.concat(head, "text"), "UTF-8")).alias("format"))


@query("canonicalizer_route", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'blocks' WHEN 1 THEN 'text' WHEN 2 THEN 'stage' WHEN 3 THEN 'blocks' WHEN 4 THEN NULL WHEN 5 THEN 'stage' END AS route FROM documents")
def canonicalizer_route(spark, sf_dir):
    k = F.col("doc_id") % 7
    path = F.when(k == 0, "a.BLEND").when(k == 1, "a.ma").when(k == 2, "a.usdc").when(k == 3, "a.ma").otherwise("a.txt")
    hint = F.when(k == 3, " Blender ").when(k == 4, "maya").when(k == 5, "USD")
    return tables.read(spark, sf_dir, "documents").select("doc_id", scenes.route(path, hint).alias("route"))


def _block_file(pointer: int, code_hex: str, key):
    """Header, one block with the key in its old address, and the end block, as hex text."""
    return F.concat(F.lit(b"BLENDER-v400".hex() if pointer == 8 else b"BLENDER_v400".hex()), F.lit(code_hex + "03000000"), F.lpad(F.hex(key), 2 * pointer, "0"), F.lit("0100000002000000" + "616263"), F.lit(b"ENDB".hex() + "00" * (16 + pointer)))


@query("block_layout", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 8 END AS pointer, doc_id % 3 <> 1 AS little, CASE doc_id % 3 WHEN 2 THEN 17 ELSE 12 END AS header FROM documents")
def block_layout(spark, sf_dir):
    k = F.col("doc_id") % 3
    raw = F.encode(F.when(k == 0, "BLENDER-v400").when(k == 1, "BLENDER_V279").otherwise("BLENDER17-01v0500"), "UTF-8")

    @F.pandas_udf("pointer int, little boolean, header int")
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scenes.block_layout(bytes(b)) for b in data], columns=["pointer", "little", "header"])

    return tables.read(spark, sf_dir, "documents").select("doc_id", run(raw).alias("at")).select("doc_id", "at.*")


@query(
    "block_zero_pointers",
    f"SELECT c_custkey, upper('{b'BLENDER-v400'.hex()}' || '4f420000' || '03000000' || repeat('0', 16) || '0100000002000000' || '616263' || '{b'ENDB'.hex()}' || repeat('00', 24)) AS hex FROM customer",
)
def block_zero_pointers(spark, sf_dir):
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: scenes.canonical_blocks(bytes(b), zero=True))

    rows = _customers(spark, sf_dir).select("c_custkey", F.unhex(_block_file(8, "4f420000", F.col("c_custkey"))).alias("raw"))
    return rows.select("c_custkey", F.hex(run("raw")).alias("hex"))


@query("packed_stage_repack", "SELECT c_custkey, true AS stable FROM customer")
def packed_stage_repack(spark, sf_dir):
    def packed(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members:
                z.writestr(zipfile.ZipInfo(name, (2020, 1 + len(body) % 12, 1, 0, 0, 0)), body)
        return out.getvalue()

    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        def one(k):
            members = [("b.usda", f"#usda {k}"), ("a.png", "x" * (k % 40)), ("sub/", "")]
            a, b = (scenes.canonical_stage(packed(m), True) for m in (members, members[::-1]))
            return a == b and scenes.canonical_stage(a, True) == a and zipfile.ZipFile(io.BytesIO(a)).read("b.usda") == f"#usda {k}".encode()

        return keys.map(one)

    return _customers(spark, sf_dir).select("c_custkey", run("c_custkey").alias("stable"))
