"""Reading sources as lazy DataFrames, and numbering their rows.

Engine columns carry the prefix ``__`` while rows are under way, so no source column can clash with them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.errors import ConnectorError, ExtractError
from spindrift.spec import ExtractSpec, Format, Status, resolve_format
from spindrift.staging import staged


def read(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    """The source's columns in their order, with the types that its reader infers.

    Whole numbers are longs; dates in CSV stay text; JSON columns come in the order of the first object.
    """
    try:
        return _READERS[kind](spark, path)
    except PySparkException as e:
        raise ExtractError(f"Failed to extract from {path}: {e}") from e


def _csv(spark: SparkSession, path: str) -> DataFrame:
    options = {"header": True, "multiLine": True, "escape": '"'}
    inferred = spark.read.options(inferSchema=True, **options).csv(path).schema
    kinds = {T.IntegerType: T.LongType(), T.DateType: T.StringType(), T.TimestampType: T.StringType(), T.TimestampNTZType: T.StringType()}
    schema = T.StructType([T.StructField(f.name, kinds.get(type(f.dataType), f.dataType)) for f in inferred])
    return spark.read.options(**options).schema(schema).csv(path)


def _json(spark: SparkSession, path: str) -> DataFrame:
    return _in_order(spark.read.option("multiLine", True).json(path), path)


def _jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _in_order(spark.read.json(path), path)


#: Bytes of a JSON source that are read to learn the order of its columns.
HEAD_BYTES = 1 << 20


def _in_order(df: DataFrame, path: str) -> DataFrame:
    """The columns in the order in which the first object has them, then any others; as inferred if that object is larger than ``HEAD_BYTES``."""
    files = df.inputFiles()
    text = _head(df.sparkSession, min(files)).lstrip("\ufeff \t\r\n[") if files else ""
    try:
        keys = list(json.JSONDecoder().raw_decode(text)[0]) if text.startswith("{") else []
    except ValueError:
        keys = []
    return df.select(*[F.col(f"`{c}`") for c in [*[k for k in keys if k in df.columns], *[c for c in df.columns if c not in keys]]])


def _head(spark: SparkSession, path: str) -> str:
    """The first ``HEAD_BYTES`` of a file, unpacked if its name says that it is packed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    opened = file.getFileSystem(conf).open(file)
    try:
        source = codec.createInputStream(opened) if codec else opened
        return bytes(source.readNBytes(HEAD_BYTES)).decode("utf-8", "ignore")
    finally:
        opened.close()


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_READERS: dict[Format, Callable[[SparkSession, str], DataFrame]] = {Format.CSV: _csv, Format.JSON: _json, Format.JSONL: _jsonl, Format.PARQUET: _parquet}


#: Rows of the table of first places that are broadcast, one a file or split of some 16 bytes; a larger table is joined as Spark sees fit.
MOST_BROADCAST = 1_000_000


def numbered(df: DataFrame, name: str = "__row_index") -> DataFrame:
    """``df`` with each row's place from 0, in the order of the source's files and splits, without a sort or a single partition.

    Rows of Parquet files are placed by their index in the file and the files' row counts. Other plain sources are placed by
    split, which depends on nothing but the files. Rows that come out of a join or another shuffle lie elsewhere each
    time the plan runs, so they are written to the shared folder first and numbered there.
    """
    nodes, parquet = _plan_of(df)
    if not nodes <= {"Project", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range"}:
        typed = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if isinstance(f.dataType, T.NullType)})
        return numbered(staged(typed, "numbered"), name)
    if parquet:
        marked = df.withColumns({"__file": F.col("_metadata.file_path"), "__in_file": F.col("_metadata.row_index")})
        order = [F.length("part"), F.col("part")]
    else:
        mono = F.monotonically_increasing_id()
        marked = df.withColumn("__mono", mono).withColumns({"__file": F.shiftright("__mono", 33), "__in_file": F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__mono")
        order = [F.col("part")]
    counts = marked.groupBy(F.col("__file").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    first = F.coalesce(F.sum("rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(counts.select(F.xxhash64("part").alias("__at"), first.alias("__first")), "first-places")
    starts = F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts
    joined = marked.withColumn("__at", F.xxhash64("__file")).join(starts, "__at")
    return joined.withColumn(name, F.col("__first") + F.col("__in_file")).drop("__at", "__file", "__in_file", "__first")


def _plan_of(df: DataFrame) -> tuple[set[str], bool]:
    """The kinds of nodes in a plan, and whether its one relation is read from Parquet files."""
    nodes, todo, parquet = set(), [df._jdf.queryExecution().analyzed()], False
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        nodes.add(kind)
        if kind == "LogicalRelation":
            parquet = node.relation().toString() == "parquet"
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return nodes, parquet


def as_records(df: DataFrame, source: str, kind: str) -> DataFrame:
    """``df`` with ``__record_id``, the place as text, ``__source``, ``__source_type``, ``__row_index`` and ``__status``."""
    marks = {"__record_id": F.col("__row_index").cast("string"), "__source": F.lit(source), "__source_type": F.lit(str(kind)), "__status": F.lit(str(Status.EXTRACTED)), "__error": F.lit(None).cast("string")}
    return numbered(df).withColumns(marks)


def extract(spark: SparkSession, spec: ExtractSpec) -> DataFrame:
    """The records of a definition's source: a file, a query with named parameters, or a registered connector's ``scheme://``."""
    if spec.query:
        return as_records(query(spark, spec.query, spec.params), spec.source, "sql")
    scheme = re.match(r"(\w+)://", spec.source)
    if scheme and scheme[1] in _connectors:
        return as_records(_connectors[scheme[1]](spark, spec.source), spec.source, scheme[1])
    kind = resolve_format(spec.source_type, spec.source, "source")
    return as_records(read(spark, spec.source, kind), spec.source, kind)


def part_of(records: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The records from ``offset`` on, ``limit`` of them at most; 0 or None means all, a negative offset counts from the end."""
    if offset < 0:
        offset = max(0, records.count() + offset)
    place = F.col("__row_index")
    return records.where(place >= offset) if not limit else records.where((place >= offset) & (place < offset + limit))


def query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """A query over the session's tables; ``{{ name }}`` and ``:name`` both stand for a parameter, never for pasted text."""
    try:
        return spark.sql(re.sub(r"'?\{\{\s*(\w+)\s*\}\}'?", r":\1", sql), args=params or {})
    except AnalysisException as e:
        raise ExtractError(f"Failed to extract by query: {e}") from e


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, dict]:
    """A page in a total order, and the total, whether there is more, and the next cursor (None on the last page)."""
    total = df.count()
    more = offset + limit < total
    return df.orderBy(*order).offset(offset).limit(limit), {"total": total, "has_more": more, "next_cursor": str(offset + limit) if more else None}


def table_of(sql: str) -> str:
    """The first table that a query names, else ``unknown``."""
    found = re.search(r"FROM\s+(\w+)", sql, re.I)
    return found[1] if found else "unknown"


def jdbc(spark: SparkSession, url: str, sql: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A query of a database, read in ``parts`` ranges of a numeric column where one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({sql}) q", **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Whole objects under a path as ``key``, ``content`` and ``size``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("key"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))


_connectors: dict[str, Callable[[SparkSession, str], DataFrame]] = {"s3": lambda spark, uri: objects(spark, uri.replace("s3://", "s3a://", 1))}


def register_connector(scheme: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    _connectors[scheme] = reader


def connector(scheme: str) -> Callable[[SparkSession, str], DataFrame]:
    if scheme not in _connectors:
        raise ConnectorError(f"no connector for {scheme}://")
    return _connectors[scheme]


def uri_parts(uri: str) -> tuple[str, str, str]:
    """Scheme, bucket or host, and the rest of a URI."""
    found = re.fullmatch(r"(\w+)://([^/]*)/?(.*)", uri)
    if not found:
        raise ConnectorError(f"{uri!r} is no URI")
    return found[1], found[2], found[3]


def from_rows(spark: SparkSession, rows: DataFrame | Iterable[dict]) -> DataFrame:
    """Records from a DataFrame or mappings at hand."""
    return as_records(rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows)), "memory", "memory")
