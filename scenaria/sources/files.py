"""File sources and sinks.

* CSV with several missing-value markers: each file's columns are bound by that file's own header, all are read as text
  (no inference pass), markers become null, numbers go through ``try_cast`` (bad text -> null). Lines that do not fit
  their header are kept apart, with their file, and counted.
* CSV with preamble lines: read with a fixed positional schema; lines up to the header line are told by
  their content. No line counting, so the file stays splittable across tasks. What is not read is counted, too.
* Sheet tables: a workbook sheet exported as CSV or Parquet, read by sheet name with a declared schema.
* Indexed export: a consecutive row index in an explicit order, computed per partition with offsets from
  per-partition counts; no step funnels the rows through one task. Exports are published by one rename.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenaria.functions.text import NA_TOKENS, to_number
from scenaria.operators.project import normalise_header


def with_source_order(df: DataFrame, name: str = "source_order") -> DataFrame:
    """Row order of a freshly scanned file: (file name, position). Must be applied right after the scan."""
    return df.withColumn(
        name, F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"))
    )


#: Most different headers in one folder; each is a branch of the reading expression.
MOST_HEADERS = 200


class Lines:
    """The lines of CSV files, with each file's header: what ``read_csv_na_tokens`` reads, and what it leaves.

    ``fit`` holds the read columns as text, ``rejects`` (file, line, reason) the lines that do not fit their file's header.
    The number of lines and of rejects is observed whenever ``fit`` is run and then stands in ``counts()``."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], order_col: str | None = None):
        from pyspark.sql import Observation

        text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                            F.monotonically_increasing_id().alias("pos"), "value").where("trim(value) <> ''")
        # a file's first line lies in its first block; one line for each file leaves a task
        heads = text.where("at = 0").groupBy("file").agg(F.min_by("value", "pos").alias("head"))
        self.headers = [r["head"] for r in heads.select("head").distinct().limit(MOST_HEADERS + 1).collect()]
        if len(self.headers) > MOST_HEADERS:
            raise ValueError(f"{path}: more than {MOST_HEADERS} different headers")
        names = {h: self._names(h) for h in self.headers}
        for h, own in names.items():
            missing = [c for c in columns if c not in own]
            if missing:
                file = heads.where(F.col("head") == h).agg(F.min("file")).first()[0]
                raise ValueError(f"{path}: no column {missing} in the header {own} of {file}")
        lines = text.join(heads.withColumnRenamed("file", "of"), F.col("file") == F.col("of")).where("value <> head")
        row = F.lit(None)
        for h, own in names.items():
            schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(own))] + [T.StructField("_bad", T.StringType())])
            got = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
            cells = [got[f"c{own.index(c)}"].alias(f"v{i}") for i, c in enumerate(columns)]
            row = F.when(F.col("head") == h, F.struct(*cells, got["_bad"].isNotNull().alias("bad"))).otherwise(row)
        self._seen = Observation()
        parsed = lines.withColumn("row", row) if names else lines.withColumn("row", F.struct(*[F.lit("").alias(f"v{i}") for i in range(len(columns))], F.lit(False).alias("bad")))
        kept = parsed.observe(self._seen, F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("row.bad"), 1)).alias("rejected")).where("not row.bad")
        out = [F.col(f"row.v{i}").alias(c) for i, c in enumerate(columns)]
        if order_col:
            out.append(F.struct("file", "pos").alias(order_col))
        self.fit = kept.select(*out)
        self.rejects = parsed.where("row.bad").select("file", F.col("value").alias("line"), F.lit("number of fields differs from the header's").alias("reason"))

    @staticmethod
    def _names(header: str) -> list[str]:
        import csv

        return next(csv.reader([header.lstrip("\ufeff")], escapechar="\\"))

    def counts(self) -> dict[str, int]:
        """Lines read (headers apart) and rejected in the first run of ``fit``; waits for it."""
        return self._seen.get


def read_csv_na_tokens(
    spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str] = (),
    na_tokens: Sequence[str] = NA_TOKENS, header: bool = True, normalise: bool = True, order_col: str | None = None,
) -> DataFrame:
    """CSV with a header; ``columns`` are the header names to read, in any order (all read as text).

    The files of a folder may have their columns in different orders, or further columns: each is bound by its own header. A
    header without one of ``columns`` is an error that names its file. Lines with more or fewer fields than their header
    are left out; the result's attribute ``lines`` (``Lines``) has them as a table, and their number after the first run.
    A line equal to its file's header is a header again. Names are normalised to snake case; ``numeric`` columns (normalised
    names) become doubles. The headers are found in a pass over the lines that sends one line for each file.
    """
    lines = None
    if header:
        lines = Lines(spark, path, columns, order_col)
        df = lines.fit
    else:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
        df = spark.read.csv(path, header=False, schema=schema, enforceSchema=True)
        if order_col:
            df = with_source_order(df, order_col)
    if normalise:
        df = df.toDF(*[normalise_header(c) if c != order_col else c for c in df.columns])
    numeric = set(numeric)
    out = []
    for c in df.columns:
        if c == order_col:
            out.append(F.col(c))
        elif c in numeric:
            out.append(to_number(c, tuple(na_tokens)).alias(c))
        else:
            s = F.trim(F.col(c))
            out.append(F.when(s.isin(*na_tokens), F.lit(None)).otherwise(F.col(c)).alias(c))
    result = df.select(*out)
    result.lines = lines
    return result


def read_csv_skip_preamble(
    spark: SparkSession, path: str, columns: Sequence[str], key: str, key_pattern: str = r"^[A-Z]{3}$",
    numeric: Sequence[str] = (), rejects: bool = False,
) -> DataFrame:
    """CSV whose first lines are a preamble and a header (``read.csv(skip = 3)``).

    ``columns`` is the positional schema; lines with fewer fields are padded with nulls by the reader. Lines whose
    ``key`` field does not match ``key_pattern`` are the preamble, the header, or bad data: with ``rejects`` these
    lines are returned instead of the others. Else the result's attribute ``observed`` counts them in its first run
    (``observed.get`` gives ``lines`` and ``rejected``), so that nothing vanishes unseen.
    """
    from pyspark.sql import Observation

    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    df = spark.read.csv(path, header=False, schema=schema, mode="PERMISSIVE")
    fits = F.coalesce(F.col(key).rlike(key_pattern), F.lit(False))
    numeric = set(numeric)
    out = [to_number(c).alias(c) if c in numeric else F.col(c) for c in columns]
    if rejects:
        return df.filter(~fits).select(*out)
    seen = Observation()
    result = df.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(F.when(~fits, 1)).alias("rejected")).filter(fits).select(*out)
    result.observed = seen
    return result


def read_sheet_table(
    spark: SparkSession, root: str, sheet: str, schema: T.StructType, fmt: str = "parquet",
) -> DataFrame:
    """A workbook sheet exported as ``{root}/{sheet}`` in CSV (with header) or Parquet."""
    path = f"{root.rstrip('/')}/{sheet}"
    if fmt == "csv":
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", header).csv(path)
    elif fmt == "text":
        w.text(path)
    else:
        w.parquet(path)


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index",
                   partitions: int | None = None) -> DataFrame:
    """A consecutive 1-based index in ``order_by`` order (ties broken by the other columns).

    Ranges number their own rows, and the rows of the ranges before are added (``operators.scan.ranked``). The rows are
    stored before, as range partitioning samples its input: read twice rather than computed twice.
    """
    from scenaria.operators.scan import ranked
    from scenaria.session import scratch_path

    order_by = list(order_by)
    rest = [c for c in df.columns if c not in order_by]
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order_by + rest]
    path = scratch_path(df.sparkSession, "to-index")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return ranked(stored, keys, name, partitions).select(name, *[F.col(f"`{c}`") for c in df.columns])


MANIFEST = "_manifest.json"


def _hadoop(spark: SparkSession, path: str):
    """(Hadoop path, its file system) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an export: the folder that holds it, its format and number of rows; None before the first one."""
    import json

    p, fs = _hadoop(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()


def publish(df: DataFrame, path: str, fmt: str = "csv") -> dict:
    """Write ``df`` as the export at ``path``: into a folder of its own first, then a new manifest that names it takes the old
    one's place by one rename. A job that is killed on the way leaves the old export whole, and readers see the old or the
    new one. Folders that the new manifest and the one before do not name are deleted afterwards."""
    import json
    import uuid

    from pyspark.sql import Observation

    spark, root = df.sparkSession, path.rstrip("/")
    before = published(spark, root)
    data, seen = f"data-{uuid.uuid4().hex}", Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{root}/{data}", fmt)
    manifest = {"data": data, "format": fmt, "rows": seen.get["rows"]}
    staged, fs = _hadoop(spark, f"{root}/{MANIFEST}-{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(staged, _hadoop(spark, f"{root}/{MANIFEST}")[0], how)
    for s in fs.listStatus(staged.getParent()):
        name = s.getPath().getName()
        if name.startswith("data-") and name not in (data, (before or {}).get("data")):
            fs.delete(s.getPath(), True)
    return manifest


def read_published(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The export at ``path`` as its manifest has it now."""
    m = published(spark, path)
    if m is None:
        raise FileNotFoundError(f"no export at {path}")
    reader = spark.read.schema(schema)
    at = f"{path.rstrip('/')}/{m['data']}"
    return reader.csv(at, header=True) if m["format"] == "csv" else reader.parquet(at)


def export_indexed(df: DataFrame, path: str, order_by: Sequence[str], fmt: str = "csv",
                   name: str = "row_index") -> DataFrame:
    """``write.csv(df)``: a header and a leading row-number column, published at ``path`` at once (``publish``;
    ``read_published`` reads it). Returns the indexed frame. Numbering stores the rows twice before (``with_row_index``)."""
    indexed = with_row_index(df, order_by, name)
    publish(indexed, path, fmt)
    return indexed
