"""Case-table schema, delimited scans and sinks, snapshots and stores.

The permit table arrives as ``;``-separated text whose headers carry dots,
commas, spaces and Norwegian letters.  At ingest it is renamed to snake_case
through ``SOURCE_NAMES``; ``export_names`` maps back for delimited export.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.functions.clean import parse_number, strip

# Source column names of the permit table, keyed by our name.
SOURCE_NAMES = {
    "case_id": "OBJ.VEGOBJEKT-ID",
    "purpose": "EGS.BRUKSOMRÅDE.1256",
    "case_number": "EGS.SAKSNUMMER.1822",
    "received_date": "EGS.SØKNAD MOTTATT DATO.12048",
    "extra_info": "EGS.TILLEGGSINFORMASJON.11566",
    "decision": "EGS.VEDTAK.10670",
    "decision_date": "EGS.VEDTAKSDATO.11444",
    "valid_to": "EGS.TILLATELSE GJELDER TIL DATO.12049",
    "archive_url": "EGS.ARKIVREFERANSE, URL.12050",
    "geometry": "EGS.GEOMETRI, PUNKT.4753",
    "municipality": "LOK.KOMMUNE",
    "road_ref": "VSR.VEGSYSTEMREFERANSE",
    "aadt_total": "ÅDT, total",
    "long_share": "ÅDT, andel lange kjøretøy",
    "speed_limit": "Fartsgrense",
    "policy_class": "Avkjørsel, holdningsklasse",
    "function_class": "Funksjonsklasse",
    "accesses": "Avkjørsler",
    "accidents": "Trafikkulykker",
    "curve_radius": "Kurvatur, horisontal",
    "gradient": "Kurvatur, stigning",
    "curve_category": "Svingkategori",
    "application_type": "Søknadstype",
    "difficulty": "Vurdering",
}
# Fixed value: alternate header for the curve radius.
ALTERNATE_NAMES = {"curve_radius": ["Kurvatur, horisontalelement"]}

CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("case_number", T.StringType()),
    T.StructField("received_date", T.StringType()),
    T.StructField("extra_info", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("decision_date", T.StringType()),
    T.StructField("valid_to", T.StringType()),
    T.StructField("archive_url", T.StringType()),
    T.StructField("geometry", T.StringType()),
    T.StructField("municipality", T.StringType()),
    T.StructField("road_ref", T.StringType()),
    T.StructField("aadt_total", T.DoubleType()),
    T.StructField("long_share", T.DoubleType()),
    T.StructField("speed_limit", T.DoubleType()),
    T.StructField("policy_class", T.StringType()),
    T.StructField("function_class", T.StringType()),
    T.StructField("accesses", T.LongType()),
    T.StructField("accidents", T.LongType()),
    T.StructField("curve_radius", T.DoubleType()),
    T.StructField("gradient", T.DoubleType()),
    T.StructField("curve_category", T.StringType()),
    T.StructField("application_type", T.StringType()),
    T.StructField("difficulty", T.StringType()),
])

ROAD_OBJECT_SCHEMA = T.StructType([
    T.StructField("object_type", T.IntegerType()),
    T.StructField("object_id", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("properties", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType())]))),
    T.StructField("references", T.ArrayType(T.StructType([
        T.StructField("road", T.StringType()),
        T.StructField("meter", T.DoubleType()),
        T.StructField("meter_to", T.DoubleType())]))),  # end of an extent; NULL for a point
])

# Road-object type ids used by the enrichment steps.
OBJECT_TYPES = {"traffic": 540, "policy_class": 815, "gradient": 825,
                "radius": 639, "access": 46, "accident": 570}


def clean_names(df: DataFrame) -> DataFrame:
    """B2: strip blanks around every header."""
    return df.toDF(*[c.strip() for c in df.columns])


def to_snake(df: DataFrame) -> DataFrame:
    """Rename source headers to snake_case; where an alternate header is
    present it takes the place of the usual one (B3)."""
    back = {v: k for k, v in SOURCE_NAMES.items()}
    out, present = df, set(df.columns)
    for ours, alts in ALTERNATE_NAMES.items():
        for a in [a for a in alts if a in present][:1]:
            out = out.drop(SOURCE_NAMES[ours], ours) if {SOURCE_NAMES[ours], ours} & present else out
            back[a] = ours
    for c in out.columns:
        tgt = back.get(c)
        if tgt and tgt not in out.columns:
            out = out.withColumnRenamed(c, tgt)
    return out


def _typed(name: str, src: T.DataType, to: T.DataType) -> Column:
    """A cell in the schema's type.  Text numbers may carry blanks, a decimal
    comma or, in counts, a zero fraction (``12.0``); others become NULL."""
    cell = F.col(f"`{name}`")
    if isinstance(to, T.StringType) or not isinstance(src, T.StringType):
        return cell.try_cast(to)
    if isinstance(to, (T.DoubleType, T.FloatType)):
        return parse_number(cell).cast(to)
    if isinstance(to, T.IntegralType):
        number = parse_number(cell)
        whole = F.transform(F.array(number), lambda n: F.when(n == F.floor(n), n).try_cast(to))[0]   # parsed once
        return F.coalesce(strip(cell).try_cast(to), whole)
    return cell.try_cast(to)


def conform(df: DataFrame, schema: T.StructType = CASE_SCHEMA,
            keep_extra: bool = True) -> DataFrame:
    """Cast present columns to the schema, add absent ones as NULL.

    Cells that do not parse become NULL, never NaN; ``failed_cells`` counts them.
    """
    present = {f.name.lower(): f for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        src = present.get(f.name.lower())
        cols.append((F.lit(None).cast(f.dataType) if src is None else _typed(src.name, src.dataType, f.dataType)).alias(f.name))
    names = {f.name.lower() for f in schema.fields}
    if keep_extra:
        cols += [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*cols)


def failed_cells(df: DataFrame, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """(column_name, failed): non-blank cells that ``conform`` cannot type."""
    present = {f.name.lower(): f for f in df.schema.fields}
    typed = [(f.name, present[f.name.lower()], f.dataType) for f in schema.fields if f.name.lower() in present]
    counts = df.agg(*[F.count_if((strip(F.col(f"`{s.name}`").cast("string")) != "") & _typed(s.name, s.dataType, t).isNull()).alias(n)
                      for n, s, t in typed])
    return counts.unpivot([], [n for n, *_ in typed], "column_name", "failed")


#: text of a row whose cells do not match the header
BAD_RECORD = "_bad_record"
# Reasons given for such rows.
TOO_FEW, TOO_MANY, OPEN_QUOTE = "too few cells", "too many cells", "open quote"


def _csv(spark: SparkSession, sep: str):
    """Quotes are doubled inside quotes, which may also hold line breaks."""
    return (spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("inferSchema", False))


def scan(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Every row as it is in the files: all columns as text (headers trimmed),
    ``_bad_record`` (the row's text where its cells do not match the header,
    else NULL) and ``_file``.  A quoted cell may hold line breaks, so a file is
    read by one task: large tables come as many files."""
    names = _csv(spark, sep).csv(path).columns
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField(BAD_RECORD, T.StringType())])
    rows = _csv(spark, sep).schema(schema).option("enforceSchema", True).option("columnPruning", False).option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD).csv(path)
    # Spark does not scan the record's text alone: it comes with the row's first cell
    record = F.when(F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0, F.col(BAD_RECORD)).alias(BAD_RECORD)
    return rows.select(*[F.col(f"`{c}`").alias(c.strip()) for c in names], record, F.col("_metadata.file_path").alias("_file"))


def _reason(record: Column, n_cells: int, sep: str) -> Column:
    """Why a row's cells do not match; NULL for a row that does."""
    plain = F.regexp_replace(record, r'"([^"]|"")*"', "")
    cells = F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1
    return (F.when(record.isNull(), F.lit(None)).when(plain.contains('"'), F.lit(OPEN_QUOTE))
            .when(cells < n_cells, F.lit(TOO_FEW)).when(cells > n_cells, F.lit(TOO_MANY)))


def bad_rows(rows: DataFrame, sep: str = ";") -> DataFrame:
    """(file, reason, record): the rows of ``scan`` whose cells do not match the header."""
    n = len(rows.columns) - 2
    return rows.withColumn("reason", _reason(F.col(BAD_RECORD), n, sep)).where("reason is not null").select(
        F.col("_file").alias("file"), "reason", F.col(BAD_RECORD).alias("record"))


def read_raw(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A2/A4: every column as text; headers trimmed.  A row with too few cells
    has NULL in the others; one with too many cells or an open quote cannot be
    told apart into columns and is left to ``bad_rows``, which lists all three."""
    rows = scan(spark, path, sep)
    reason = _reason(F.col(BAD_RECORD), len(rows.columns) - 2, sep)
    return rows.where(reason.isNull() | (reason == TOO_FEW)).drop(BAD_RECORD, "_file")


def read_cases(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A1/A3: delimited scan with header; typed through ``conform``."""
    return conform(to_snake(read_raw(spark, path, sep)))


def export_names(df: DataFrame) -> DataFrame:
    """Rename snake_case columns back to the source headers."""
    return df.select(*[F.col(c).alias(SOURCE_NAMES.get(c, c)) for c in df.columns])


def write_cases(df: DataFrame, path: str, sep: str = ";",
                quote_strings: bool = False, source_names: bool = True) -> None:
    """Delimited sink.  Quotes inside quotes are doubled; white space stays.
    With ``quote_strings`` all cells but numbers (and NULLs) are quoted, as are
    the headers; every file has them."""
    out = export_names(df) if source_names else df
    if not quote_strings:
        (out.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        return
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.coalesce(F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.NumericType) else quoted(F.col(f"`{f.name}`").cast("string")),
                        F.lit("")) for f in out.schema.fields]
    header = sep.join('"' + c.replace('"', '""') + '"' for c in out.columns)

    def with_header(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    out.select(F.concat_ws(sep, *cells).alias("value")).mapInArrow(with_header, "value string").write.mode("overwrite").text(path)


def export_ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """Listed columns first (present ones only, no duplicates), then the rest."""
    seen, cols = set(), []
    for c in first + df.columns:
        if c in df.columns and c not in seen:
            seen.add(c)
            cols.append(c)
    return df.select(*cols)


def read_road_objects(spark: SparkSession, path: str) -> DataFrame:
    """Road-object snapshot (JSON lines) with a fixed schema."""
    return spark.read.schema(ROAD_OBJECT_SCHEMA).json(path)


THRESHOLD_SCHEMA = "stage int, class string, threshold double, target_precision double"


def write_thresholds(df: DataFrame, path: str) -> None:
    """Threshold table (stage, class, threshold, target_precision)."""
    df.select("stage", "class", "threshold", "target_precision") \
      .write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(THRESHOLD_SCHEMA).json(path)


def append_run(spark: SparkSession, path: str, run_id: str, record: dict) -> None:
    """A10: append one run record (JSON text) to the runs table."""
    row = [(run_id, json.dumps(record, default=str, ensure_ascii=False))]
    spark.createDataFrame(row, "run_id string, record string") \
         .write.mode("append").parquet(path)


def write_stats(df: DataFrame, path: str, table: str, partition: list[str] | None = None) -> None:
    """Statistic tables (describe, frequencies, correlations, top-k) in
    long form, one folder per table, partitioned by statistic columns."""
    out = df.withColumn("stat_table", F.lit(table))
    w = out.write.mode("overwrite")
    if partition:
        w = w.partitionBy(*partition)
    w.parquet(f"{path.rstrip('/')}/{table}")
