"""Repair projects: JSON files that name a source, its recipe and its undo history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 2
APP = "mendframe"

_SCOPE = "struct<kind:string,row:int,col:int,count:int,height:int,width:int,rows:int,cols:int,mask:string>"
_OP = f"struct<type:string,a:int,b:int,scope:{_SCOPE},coefs:string>"
_EDIT = "struct<kind:string,offset:bigint,bit:int,count:bigint,data:string>"
STEP = f"struct<kind:string,enabled:boolean,description:string,ops:array<{_OP}>,edits:array<{_EDIT}>>"
PROJECT = (
    "struct<app:string,formatVersion:int,writtenBy:string,source:string,sourceBytes:bigint,sourceSha256:string,salvageMode:string,"
    "donor:struct<source:string,spliceOffset:bigint,keepOwnTables:boolean,renumberRestarts:boolean,width:int,height:int,restartInterval:int>,"
    f"export:string,steps:array<{STEP}>,history:struct<pool:array<{STEP}>,states:array<array<int>>,index:int>>"
)

# Names used in project files; so are the keys in the types above.
OPS = ["cdelta", "copy", "insert", "delete", "paste", "unitInsert", "unitDelete"]
EDITS = ["deleteBytes", "insertBytes", "flipBit", "deleteBits", "insertBits", "truncate"]


def _in(expr: str, values: list[str]) -> str:
    return f"coalesce({expr}, '') IN ({', '.join(repr(v) for v in values)})"


def step_problem(s: str) -> str:
    """SQL: what is wrong with a step, NULL when it can be replayed."""
    op = f"""CASE WHEN NOT {_in('o.type', OPS)} THEN 'unknown operation'
        WHEN NOT {_in('o.scope.kind', ['run', 'rect', 'mask'])} THEN 'unknown selection kind'
        WHEN o.scope.kind = 'mask' AND (coalesce(o.scope.rows, 0) <= 0 OR coalesce(o.scope.cols, 0) <= 0
             OR coalesce(length(try_to_binary(o.scope.mask, 'base64')), 0) <> o.scope.rows * o.scope.cols) THEN 'mask does not match its grid'
        WHEN o.type = 'paste' AND coalesce(o.coefs, '') = '' THEN 'paste without data' END"""
    edit = f"""CASE WHEN NOT {_in('e.kind', EDITS)} THEN 'unknown byte edit'
        WHEN coalesce(e.offset, 0) < 0 OR coalesce(e.bit, 0) NOT BETWEEN 0 AND 7 OR coalesce(e.count, 0) < 0 THEN 'edit outside the file' END"""
    first = lambda items, var, test: f"get(filter(transform({items}, {var} -> {test}), p -> p IS NOT NULL), 0)"
    return f"""CASE WHEN NOT {_in(f'{s}.kind', ['ops', 'bytes', 'autoColor'])} THEN 'unknown step kind'
        WHEN {s}.kind = 'ops' THEN CASE WHEN coalesce(size({s}.ops), 0) < 1 THEN 'no operations' ELSE {first(f'{s}.ops', 'o', op)} END
        WHEN {s}.kind = 'bytes' THEN CASE WHEN coalesce(size({s}.edits), 0) < 1 THEN 'no edits' ELSE {first(f'{s}.edits', 'e', edit)} END END"""


def parse_projects(raw: DataFrame, app: str = APP) -> DataFrame:
    """`raw` (path, value) with the parsed project `p` and `error`, NULL for a usable one.

    A damaged step makes the project an error row; a damaged history is only
    dropped. Missing options take their defaults: steps are enabled, splice
    options are off, the restart interval is left alone (-1).
    """
    df = raw.withColumn("p", F.from_json("value", PROJECT))
    bad_step = f"get(filter(transform(p.steps, (s, i) -> concat('step ', i + 1, ': ', {step_problem('s')})), x -> x IS NOT NULL), 0)"
    history_ok = (
        f"NOT exists(p.history.pool, s -> ({step_problem('s')}) IS NOT NULL) AND "
        "NOT exists(flatten(p.history.states), r -> r < 0 OR r >= size(p.history.pool))"
    )
    return df.select(
        "path",
        "p",
        F.expr(
            f"""CASE WHEN p IS NULL OR (p.app IS NULL AND p.source IS NULL AND p.steps IS NULL) THEN 'not a readable project'
            WHEN coalesce(p.app, '') <> '{app}' THEN 'not a project of this kind'
            WHEN coalesce(p.formatVersion, 0) > {FORMAT_VERSION} THEN 'written by a newer version'
            WHEN coalesce(p.source, '') = '' THEN 'no source'
            WHEN p.donor IS NOT NULL AND coalesce(p.donor.source, '') = '' THEN 'donor without a source'
            ELSE {bad_step} END"""
        ).alias("error"),
        F.expr(f"CASE WHEN {history_ok} THEN p.history END").alias("history"),
    )


def read_projects(spark: SparkSession, path: str, app: str = APP) -> tuple[DataFrame, DataFrame]:
    """(projects, errors): one row per usable project file below `path`, and path and error of the others."""
    # The metadata column holds an encoded URI; listings hold names as they are.
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(decoded.alias("path"), "value")
    parsed = parse_projects(raw, app)
    return project_rows(parsed), parsed.where("error IS NOT NULL").select("path", "error")


def project_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").select(
        "path",
        F.expr(resolve_expr("path", "p.source")).alias("source_path"),
        F.expr("coalesce(p.sourceBytes, 0)").alias("source_bytes"),
        F.expr("nullif(p.sourceSha256, '')").alias("source_sha256"),
        F.expr("CASE WHEN p.salvageMode = 'readThrough' THEN 'readThrough' ELSE 'truncate' END").alias("salvage_mode"),
        F.expr(f"CASE WHEN p.donor IS NOT NULL THEN {resolve_expr('path', 'p.donor.source')} END").alias("donor_path"),
        F.expr("p.donor.spliceOffset").alias("splice_offset"),
        F.expr("p.donor IS NOT NULL AND coalesce(p.donor.keepOwnTables, false)").alias("keep_own_tables"),
        F.expr("p.donor IS NOT NULL AND coalesce(p.donor.renumberRestarts, p.donor.keepOwnTables IS NOT NULL)").alias("renumber_restarts"),
        F.expr("coalesce(p.donor.restartInterval, -1)").alias("restart_interval"),
        F.expr(f"CASE WHEN coalesce(p.export, '') <> '' THEN {resolve_expr('path', 'p.export')} END").alias("export_path"),
        F.expr("coalesce(p.steps, array())").alias("steps"),
        "history",
    )


def project_steps(projects: DataFrame) -> DataFrame:
    """path, step_no, kind, enabled, description, n_ops, n_edits: one row per step; their content is in the functions below."""
    return projects.select("path", F.posexplode("steps").alias("step_no", "s")).select(
        "path",
        "step_no",
        "s.kind",
        F.expr("coalesce(s.enabled, true)").alias("enabled"),
        F.expr("coalesce(s.description, '')").alias("description"),
        F.expr("coalesce(size(s.ops), 0)").alias("n_ops"),
        F.expr("coalesce(size(s.edits), 0)").alias("n_edits"),
    )


def _operations(s: str) -> str:
    """SQL: the coefficient operations of a step as an array, an automatic correction as one of its own."""
    op = """named_struct('kind', 'ops', 'enabled', coalesce(s.enabled, true), 'op', o.type,
        'row', coalesce(o.scope.row, 0), 'col', coalesce(o.scope.col, 0),
        'h', CASE WHEN o.scope.kind = 'rect' THEN coalesce(o.scope.height, 0) ELSE 0 END,
        'w', CASE o.scope.kind WHEN 'rect' THEN coalesce(o.scope.width, 0) WHEN 'run' THEN coalesce(o.scope.count, 0) ELSE 0 END,
        'a', coalesce(o.a, 0), 'b', coalesce(o.b, 0),
        'mask', CASE WHEN o.scope.kind = 'mask' THEN unbase64(o.scope.mask) END, 'coefs', unbase64(o.coefs))"""
    auto = """named_struct('kind', 'autoColor', 'enabled', coalesce(s.enabled, true), 'op', cast(null as string), 'row', 0, 'col', 0,
        'h', 0, 'w', 0, 'a', 0, 'b', 0, 'mask', cast(null as binary), 'coefs', cast(null as binary))"""
    return f"CASE s.kind WHEN 'ops' THEN transform(s.ops, o -> {op}) WHEN 'autoColor' THEN array({auto}) ELSE slice(array({auto}), 1, 0) END"


def project_operations(projects: DataFrame) -> DataFrame:
    """path, step_no, kind, enabled, op, row, col, h, w, a, b, mask, coefs: what `recipes` takes, densely numbered.

    Masks (one byte per MCU) and pasted coefficients are decoded.
    """
    return projects.select("path", F.posexplode(F.expr(f"flatten(transform(steps, s -> {_operations('s')}))")).alias("step_no", "o")).select(
        "path", "step_no", "o.*"
    )


def project_clips(projects: DataFrame, per_mcu: int) -> DataFrame:
    """path, paste_step, paste_i, unit, coef: the blocks that paste operations write, `per_mcu` of them per MCU.

    A payload is a row of little-endian 16-bit coefficients, 64 per block.
    """
    value = "conv(hex(concat(substring(coefs, 128 * k + 2 * i + 2, 1), substring(coefs, 128 * k + 2 * i + 1, 1))), 16, 10)"
    signed = f"cast(cast({value} as int) - CASE WHEN cast({value} as int) > 32767 THEN 65536 ELSE 0 END as int)"
    blocks = (
        project_operations(projects)
        .where("enabled AND op = 'paste' AND length(coefs) >= 128")
        .select("path", F.col("step_no").alias("paste_step"), "coefs", F.explode(F.expr("sequence(0, length(coefs) div 128 - 1)")).alias("k"))
    )
    return blocks.select(
        "path",
        "paste_step",
        F.expr(f"cast(k div {per_mcu} as bigint)").alias("paste_i"),
        F.expr(f"k % {per_mcu}").alias("unit"),
        F.expr(f"transform(sequence(0, 63), i -> {signed})").alias("coef"),
    )


def project_edits(projects: DataFrame) -> DataFrame:
    """path, edit_no, kind, offset, bit, count, data: the byte edits of enabled steps, densely numbered, for `apply_byte_edits`."""
    listed = "flatten(transform(filter(steps, s -> s.kind = 'bytes' AND coalesce(s.enabled, true)), s -> s.edits))"
    return projects.select("path", F.posexplode(F.expr(listed)).alias("edit_no", "e")).select(
        "path",
        "edit_no",
        "e.kind",
        F.expr("coalesce(e.offset, 0L)").alias("offset"),
        F.expr("coalesce(e.bit, 0)").alias("bit"),
        F.expr("coalesce(e.count, 0L)").alias("count"),
        F.expr("coalesce(unbase64(e.data), X'')").alias("data"),
    )


def project_json(projects: DataFrame, app: str = APP) -> DataFrame:
    """Adds `json`, the project as it is stored; paths relative to the project's folder where they lie below it."""
    body = f"""to_json(named_struct('app', '{app}', 'formatVersion', {FORMAT_VERSION}, 'source', {store_expr('path', 'source_path')},
        'sourceBytes', source_bytes, 'sourceSha256', source_sha256, 'salvageMode', salvage_mode,
        'donor', CASE WHEN donor_path IS NOT NULL THEN named_struct('source', {store_expr('path', 'donor_path')}, 'spliceOffset', splice_offset,
            'keepOwnTables', keep_own_tables, 'renumberRestarts', renumber_restarts,
            'restartInterval', nullif(restart_interval, -1)) END,
        'export', {store_expr('path', 'export_path')}, 'steps', steps, 'history', history))"""
    return projects.withColumn("json", F.expr(body))


def write_projects(projects: DataFrame, folder: str, app: str = APP) -> None:
    """One file per project, below the folders of its path, so that equal base names stay apart."""
    from mendframe.sources.sinks import relative_name, write_files

    named = project_json(projects, app).withColumn("name", F.expr(relative_name("path")))
    write_files(named, folder, content="json")


def folder_expr(path: str) -> str:
    return f"regexp_replace({path}, '/[^/]*$', '')"


def clean_expr(path: str) -> str:
    """SQL: a path without '.', '..' and doubled slashes; scheme and authority stay."""
    root = f"regexp_extract({path}, '^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?/?', 0)"
    parts = f"filter(split(substring({path}, length({root}) + 1), '/'), s -> s <> '' AND s <> '.')"
    stack = (
        f"aggregate({parts}, cast(array() as array<string>), (a, s) -> CASE WHEN s = '..' AND size(a) > 0 AND get(a, size(a) - 1) <> '..' "
        f"THEN slice(a, 1, size(a) - 1) WHEN s = '..' AND {root} <> '' THEN a ELSE concat(a, array(s)) END)"
    )
    return f"concat({root}, array_join({stack}, '/'))"


def resolve_expr(project: str, stored: str) -> str:
    """SQL: a stored path read from the project's folder; absolute ones stay."""
    uri = f"{stored} RLIKE '^[A-Za-z][A-Za-z0-9+.-]*://'"
    joined = f"CASE WHEN startswith({stored}, '/') THEN {stored} ELSE concat({folder_expr(project)}, '/', {stored}) END"
    return f"CASE WHEN {uri} THEN {stored} ELSE {clean_expr(joined)} END"


def store_expr(project: str, path: str) -> str:
    """SQL: relative to the project's folder below it, absolute otherwise."""
    folder = f"concat({folder_expr(project)}, '/')"
    return f"CASE WHEN startswith({path}, {folder}) THEN substring({path}, length({folder}) + 1) ELSE {path} END"


def resolve_paths(df: DataFrame, project: str = "project_path", stored: str = "stored") -> DataFrame:
    """Adds `resolved`."""
    return df.withColumn("resolved", F.expr(resolve_expr(project, stored)))
