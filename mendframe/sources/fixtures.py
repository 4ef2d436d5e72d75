"""Inputs derived from the driver's tables.

One SQL text per fixture serves both Spark and DuckDB: the few functions the
two engines spell differently are filled in by `Dialect`. The operators under
test never use these texts; they only read the resulting tables.

Nothing is sampled or cut: every row of the source table becomes part of the
fixture, and every text is carried whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.functions.blocked import blocked_row_number
from mendframe.functions.lineage import shuffle_partitions
from mendframe.functions.once import once


@dataclass(frozen=True)
class Dialect:
    lines: str  # text column -> array of its lines
    array: str  # array literal function

    def transform(self, arr: str, args: str, body: str) -> str:
        if self.array == "array":
            return f"transform({arr}, ({args}) -> {body})"
        return f"list_transform({arr}, lambda {args}: {body})"

    def join(self, arr: str) -> str:
        return f"array_join({arr}, '')" if self.array == "array" else f"array_to_string({arr}, '')"

    def size(self, arr: str) -> str:
        return f"size({arr})" if self.array == "array" else f"len({arr})"

    def take(self, arr: str, n: str) -> str:
        if self.array == "array":
            return f"slice({arr}, 1, cast({n} as int))"
        return f"list_slice({arr}, 1, {n})"

    def drop(self, arr: str, n: str) -> str:
        """Everything after the first n."""
        if self.array == "array":
            return f"slice({arr}, cast({n} as int) + 1, size({arr}))"
        return f"list_slice({arr}, {n} + 1, len({arr}))"

    def only(self, cond: str, expr: str) -> str:
        """`expr` where it is used; DuckDB computes it for all rows."""
        return f"CASE WHEN {cond} THEN {expr} END" if self.array == "array" else expr

    @property
    def index_base(self) -> int:
        return 0 if self.array == "array" else 1


SPARK = Dialect(lines=r"split(text, '\\n')", array="array")
DUCK = Dialect(lines="string_split(text, chr(10))", array="list_value")


def _hx(v: str, digits: int = 2) -> str:
    return f"lpad(hex(cast({v} as bigint)), {digits}, '0')"


def _u16(v: str, little: bool) -> str:
    hi, lo = _hx(f"floor(({v}) / 256)"), _hx(f"({v}) % 256")
    return f"{lo} || {hi}" if little else f"{hi} || {lo}"


def _u32(v: str, little: bool) -> str:
    parts = [_hx(f"floor(({v}) / {256 ** i}) % 256") for i in range(4)]
    return " || ".join(parts if little else parts[::-1])


def _ascii(s: str) -> str:
    return "'" + s.encode("latin-1").hex().upper() + "'"


def _tiff(little: bool) -> str:
    """IFD0 {make, model, orientation, Exif pointer}, Exif IFD {A002, A003}, IFD1 {0201, 0202}."""
    u16 = lambda v: _u16(str(v), little)
    u32 = lambda v: _u32(str(v), little)

    def entry(tag, kind, count, value, short=False):
        val = f"{u16(value)} || '0000'" if short else u32(value)
        return f"{u16(tag)} || {u16(kind)} || {u32(count)} || {val}"

    parts = [
        "'49492A00'" if little else "'4D4D002A'",
        u32(8),
        u16(4),
        entry(0x010F, 2, 6, 62),
        entry(0x0110, 2, 16, 68),
        entry(0x0112, 3, 1, "1 + doc_id % 9", short=True),
        entry(0x8769, 4, 1, 84),
        f"CASE WHEN has_thumb THEN {u32(114)} ELSE {u32(0)} END",
        "'43616E6F6E00'",
        "hex(model) || '00'",
        u16(2),
        entry(0xA002, 4, 1, "w + (CASE WHEN doc_id % 10 = 4 THEN 16 ELSE 0 END)"),
        entry(0xA003, 3, 1, "h", short=True),
        u32(0),
        "CASE WHEN has_thumb THEN "
        + " || ".join(
            [
                u16(2),
                entry(0x0201, 4, 1, 144),
                entry(0x0202, 4, 1, "length(thumb) / 2"),
                u32(0),
                "thumb",
            ]
        )
        + " ELSE '' END",
    ]
    return " || ".join(f"({p})" for p in parts)


def _segment(code: str, payload: str) -> str:
    """A segment of the given hex payload expression."""
    return f"('FF{code}' || {_hx(f'length({payload}) / 2 + 2', 4)} || {payload})"


# A tiny complete grayscale JPEG (24 x 16) used as a thumbnail.
THUMB = "FFD8FFC0000B08001000180101110" + "0FFDA0008010100003F003132334142434431FFD9"
GUID_HEX = "{36A698B9-D67C-4E07-BE82-0EC5B14B4DF5}".encode().hex().upper()


def files_sql(d: Dialect, table: str = "documents") -> str:
    """(file_id, path, source, hx): one damaged or whole JPEG per document.

    The text is the entropy-coded data; `doc_id % 8` chooses what happened to
    the file: 0 clean, 1 truncated, 2 front zeroed, 3 ransomware footer, 4 a
    second picture appended, 5 an MP4 box appended, 6 an illegal byte pair in
    the data, 7 not a JPEG at all.
    """
    base = d.index_base
    line_hex = (
        f"CASE WHEN has_dri AND i > {base} THEN 'FFD' || cast((i - {base + 1} + "
        f"CASE WHEN doc_id % 9 = 0 AND i > {base + 3} THEN 1 ELSE 0 END) % 8 AS varchar(8)) ELSE '' END || hex(s)"
    )
    if d.array == "array":
        line_hex = line_hex.replace("varchar(8)", "string")
    comps = (
        "CASE WHEN nc = 1 THEN '01' || '01' || samp || '00' "
        "ELSE '03' || '01' || samp || '00' || '021101' || '031101' END"
    )
    sof_payload = f"('08' || {_hx('h', 4)} || {_hx('w', 4)} || {comps})"
    sos_comps = "CASE WHEN nc = 1 THEN '01' || '0100' ELSE '03' || '010002110311' END"
    sos_tail = "CASE WHEN progressive THEN '000001' ELSE '003F00' END"
    sos_payload = f"(({sos_comps}) || ({sos_tail}))"
    dqt = (
        f"('00' || repeat({_hx('2 + doc_id % 4')}, 64) || '01' || repeat({_hx('3 + doc_id % 5')}, 64))"
    )
    dht = (
        "('00' || '00010501010101010100000000000000' || '000102030405060708090A0B' || '10' || "
        "'00010200000000000000000000000000' || CASE WHEN doc_id % 3 = 1 THEN '010203' ELSE '0102F0' END)"
    )
    second = (
        "('FFD8' || 'FFC0000B080020003001011100' || 'FFDA0008010100003F00' || "
        "repeat(hex(source), 400) || 'FFD9')"
    )
    # Texts whose lines stay as they are need not be split.
    lines = d.only("doc_id % 8 <> 7 AND (doc_id % 3 = 0 OR doc_id % 7 = 3 OR doc_id % 8 = 6)", d.lines)
    unsplit = "WHEN lines IS NULL THEN hex(replace(text, chr(10), '')) " if d.array == "array" else ""
    mp_header = "length(app0 || app1 || extra) / 2 + 8"
    mpf_end = "length(app0 || app1 || extra || dqt || sof || dht || dri || sos || data) / 2 + 90 + 2"
    return f"""
    WITH d0 AS (
      SELECT doc_id, text, source, {lines} AS lines,
             16 * (4 + doc_id % 29) AS w, 8 * (3 + doc_id % 17) AS h,
             CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 3 END AS nc,
             CASE doc_id % 5 WHEN 0 THEN '22' WHEN 1 THEN '11' WHEN 2 THEN '21'
                             WHEN 3 THEN '12' ELSE '41' END AS samp,
             doc_id % 7 = 3 AS progressive, doc_id % 3 = 0 AS has_dri, doc_id % 6 = 0 AS has_thumb,
             '{THUMB}' AS thumb,
             rpad((CASE WHEN doc_id % 4 = 0 THEN 'Canon EOS ' ELSE 'Model ' END) || source, 15, ' ') AS model,
             doc_id % 8 AS kind
      FROM {table}),
    d1 AS (
      SELECT *, {d.transform('lines', 's, i', line_hex)} AS hexlines,
             'FFD8FFE000104A46494600010100000100010000' AS app0,
             CASE WHEN doc_id % 4 = 0 THEN {_tiff(True)} WHEN doc_id % 2 = 0 THEN {_tiff(False)}
                  ELSE '' END AS tiff
      FROM d0),
    d2 AS (
      SELECT *,
        CASE WHEN tiff = '' THEN '' ELSE {_segment('E1', "('457869660000' || tiff)")} END AS app1,
        CASE WHEN doc_id % 5 = 1 THEN {_segment('E2', "('4943435F50524F46494C4500' || hex(source))")}
             WHEN doc_id % 5 = 2 THEN {_segment('EE', "('41646F6265' || '00640000000000')")}
             WHEN doc_id % 5 = 3 THEN {_segment('FE', "hex(source)")} ELSE '' END AS extra,
        {_segment('DB', dqt)} AS dqt, {_segment('C4', dht)} AS dht,
        'FFC' || (CASE WHEN progressive THEN '2' ELSE '0' END) || substr({_segment('C0', sof_payload)}, 5) AS sof,
        CASE WHEN has_dri THEN 'FFDD0004' || {_hx('4 + doc_id % 5', 4)} ELSE '' END AS dri,
        {_segment('DA', sos_payload)} AS sos,
        CASE WHEN progressive
             THEN {d.join(d.take('hexlines', f'cast(floor({d.size("hexlines")} / 2) as bigint)'))}
                  || {_segment('C4', "('10' || '00010200000000000000000000000000' || '010203')")}
                  || 'FFDA0008010100010502'
                  || {d.join(d.drop('hexlines', f'cast(floor({d.size("hexlines")} / 2) as bigint)'))}
                  || 'FFDA0008010100013F21' || '4142434445'
             {unsplit}ELSE {d.join('hexlines')} END AS data,
        {d.only('kind = 4', second)} AS second,
        doc_id % 16 = 4 AS has_mpf
      FROM d1),
    d3 AS (
      SELECT *, app0 || app1 || extra AS pre, dqt || sof || dht || dri || sos AS post,
             {d.only('has_mpf', mp_header)} AS mp_header,
             {d.only('has_mpf', mpf_end)} AS mpf_end
      FROM d2),
    d4 AS (
      SELECT *, CASE WHEN has_mpf THEN 'FFE20058' || '4D504600' || '49492A0008000000' || '0300'
          || '00B0' || '0700' || '04000000' || '30313030'
          || '01B0' || '0400' || '01000000' || '02000000'
          || '02B0' || '0700' || '20000000' || '32000000' || '00000000'
          || '00000300' || {_u32('mpf_end', True)} || '00000000' || '00000000'
          || '00000000' || {_u32('length(second) / 2', True)} || {_u32('mpf_end - mp_header', True)} || '00000000'
          ELSE '' END AS mpf
      FROM d3)
    SELECT doc_id AS file_id,
      source || '/' || cast(doc_id AS {'string' if d.array == 'array' else 'varchar'})
        || CASE WHEN kind = 3 THEN '.jpg.djvu' WHEN kind = 7 THEN '.txt' WHEN doc_id % 13 = 0 THEN '.JPEG' ELSE '.jpg' END AS path,
      source,
      CASE kind
        WHEN 0 THEN pre || post || data || 'FFD9'
        WHEN 1 THEN pre || post || data
        WHEN 2 THEN (CASE WHEN doc_id % 16 = 2 THEN repeat('00', cast(length(pre || post) / 2 as int))
                          WHEN doc_id % 48 = 10 THEN repeat('A5FF31', 50)
                          ELSE repeat('00', cast(length(pre) / 2 as int)) || post END) || data || 'FFD9'
        WHEN 3 THEN (CASE WHEN doc_id % 16 = 3 THEN pre || post ELSE repeat('5B', 500) END)
             || data || 'FFD9' || repeat('2D', CASE WHEN doc_id % 16 = 11 THEN 1200 ELSE 300 END)
             || (CASE WHEN doc_id % 24 = 19 THEN '2D41425A' ELSE repeat('7A', 30) || '30313233343536' ||
                   (CASE WHEN doc_id % 3 = 0 THEN '387431' ELSE '383941' END) END)
             || '{GUID_HEX}'
        WHEN 4 THEN pre || mpf || post || data || 'FFD9' || second
        WHEN 5 THEN pre || post || data || 'FFD9'
             || (CASE WHEN doc_id % 16 = 13 THEN repeat('11', 100) ELSE '' END)
             || '0000001866747970' || '6D703432' || '00000000' || '6D70343269736F6D' || hex(source)
        WHEN 6 THEN pre || post || {d.join(d.take('hexlines', '1'))} || 'FF31'
             || {d.join(d.drop('hexlines', '1'))} || 'FFD9'
        ELSE hex(text) END AS hx
    FROM d4"""


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores: one file of a driver table is one split, however long its folds take.

    With a number of partitions, as those without are merged by their bytes, of which the folds are no measure.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), key)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, source, size, mtime, content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = spread(docs, "doc_id")
    built = spark.sql(files_sql(SPARK, "{docs}"), docs=docs)
    return built.select(
        "file_id",
        "path",
        "source",
        F.expr("cast(length(hx) div 2 as bigint)").alias("size"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(file_id as int), 0)").alias("mtime"),
        once("unhex(hx)").alias("content"),
    )


# MCU stream -----------------------------------------------------------------

MCU_WIDTH = 16
_MCU_ORDER = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_shipdate",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


def mcus_sql(table: str = "lineitem") -> str:
    """The DuckDB twin of `mcus`."""
    order = ", ".join(_MCU_ORDER)
    return f"""
    SELECT image_id, m, m // {MCU_WIDTH} AS "row", m % {MCU_WIDTH} AS col, y, cb, cr, bits, anomalies,
           part_id, m * 40 + bits % 7 AS bit_pos
    FROM (SELECT l_suppkey AS image_id, l_partkey AS part_id,
                 row_number() OVER (PARTITION BY l_suppkey ORDER BY {order}) - 1 AS m,
                 CAST(l_quantity AS BIGINT) AS y, CAST(round(100 * l_discount) AS BIGINT) AS cb,
                 CAST(round(100 * l_tax) AS BIGINT) AS cr, CAST(l_quantity AS BIGINT) AS bits,
                 CASE WHEN l_returnflag = 'R' THEN
                   CASE WHEN l_linestatus = 'O' THEN 32 ELSE CAST(1 + l_linenumber AS BIGINT) END
                   ELSE 0 END AS anomalies
          FROM {table})"""


def mcus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, m, row, col, y, cb, cr, bits, anomalies, part_id, bit_pos: one image per supplier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    numbered = blocked_row_number(
        li, ["l_suppkey"], _MCU_ORDER, F.expr("l_orderkey div 4096"), "m"
    )
    return numbered.select(
        F.col("l_suppkey").alias("image_id"),
        "m",
        F.expr(f"m div {MCU_WIDTH}").alias("row"),
        F.expr(f"m % {MCU_WIDTH}").alias("col"),
        F.expr("cast(l_quantity as bigint)").alias("y"),
        F.expr("cast(round(100 * l_discount) as bigint)").alias("cb"),
        F.expr("cast(round(100 * l_tax) as bigint)").alias("cr"),
        F.expr("cast(l_quantity as bigint)").alias("bits"),
        F.expr(
            "CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 32L "
            "ELSE cast(1 + l_linenumber as bigint) END ELSE 0L END"
        ).alias("anomalies"),
        F.col("l_partkey").alias("part_id"),
        F.expr("m * 40 + cast(l_quantity as bigint) % 7").alias("bit_pos"),
    )


# Blocks, quantization and pixels ---------------------------------------------

BLOCKS_PER_MCU = 6
BLOCK_GRID = 4


def blocks_sql(table: str = "embeddings") -> str:
    return f"""
    SELECT vec_id // 96 AS image_id, vec_id % 96 AS unit, (vec_id % 96) // 6 AS m,
           CASE WHEN vec_id % 6 < 4 THEN 0 WHEN vec_id % 6 = 4 THEN 1 ELSE 2 END AS comp,
           list_transform(embedding, lambda x: CAST(round(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS coef
    FROM {table}"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, unit, m, comp, coef: 4x4 MCUs of six 8x8 blocks (4:2:0) per image."""
    e = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id")
    return e.select(
        F.expr("vec_id div 96").alias("image_id"),
        F.expr("vec_id % 96").alias("unit"),
        F.expr("(vec_id % 96) div 6").alias("m"),
        F.expr(
            "CASE WHEN vec_id % 6 < 4 THEN 0 WHEN vec_id % 6 = 4 THEN 1 ELSE 2 END"
        ).alias("comp"),
        F.expr("transform(embedding, x -> cast(round(256 * cast(x as double)) as bigint))").alias("coef"),
    )


def quant_step(comp: str, i: str) -> str:
    """SQL: the quantization step of coefficient i, natural order."""
    return f"(1 + {comp} + ({i}) % 8 + cast(floor(({i}) / 8) as bigint))"


def quant_sql(table: str = "embeddings") -> str:
    step = quant_step("comp", "i")
    return f"""
    SELECT image_id, comp, list_transform(range(64), lambda i: {step}) AS q
    FROM (SELECT DISTINCT vec_id // 96 AS image_id FROM {table}), (SELECT unnest([0, 1, 2]) AS comp)"""


def quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, comp, q."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    step = quant_step("comp", "i")
    return (
        e.select(F.expr("vec_id div 96").alias("image_id"))
        .distinct()
        .withColumn("comp", F.explode(F.expr("array(0, 1, 2)")))
        .withColumn("q", F.expr(f"transform(sequence(0, 63), i -> {step})"))
    )


PIXEL_SIDE = 64


def pixels_sql(table: str = "embeddings") -> str:
    v = lambda k: (
        f"CAST(least(255, greatest(0, round(128 + 256 * CAST(embedding[1 + {k}] AS DOUBLE)))) AS BIGINT)"
    )
    return f"""
    SELECT vec_id // 64 AS image_id, (vec_id % 8) * 8 + i % 8 AS x, ((vec_id % 64) // 8) * 8 + i // 8 AS y,
           {v('i')} AS c0, {v('(63 - i)')} AS c1, {v('(i * 7) % 64')} AS c2
    FROM {table}, (SELECT unnest(range(64)) AS i)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, c0, c1, c2: 64 vectors tile one 64x64 picture."""
    e = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id")
    v = lambda k: (
        f"cast(least(255, greatest(0, round(128 + 256 * cast(embedding[{k}] as double)))) as bigint)"
    )
    return e.withColumn("i", F.explode(F.expr("sequence(0L, 63L)"))).select(
        F.expr("vec_id div 64").alias("image_id"),
        F.expr("(vec_id % 8) * 8 + i % 8").alias("x"),
        F.expr("((vec_id % 64) div 8) * 8 + i div 8").alias("y"),
        F.expr(v("cast(i as int)")).alias("c0"),
        F.expr(v("cast(63 - i as int)")).alias("c1"),
        F.expr(v("cast((i * 7) % 64 as int)")).alias("c2"),
    )
