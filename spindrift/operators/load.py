"""The load stage: which rows go out, as which columns, and how they are written."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.errors import LoadError
from spindrift.operators.evaluate import score_column
from spindrift.spec import EvaluateSpec, Format, LoadSpec, Status, resolve_format
from spindrift.staging import delete, new_path


def loadable() -> Column:
    return F.col("__status").isin(str(Status.PASSED), str(Status.EVALUATED))


def projected(records: DataFrame, spec: EvaluateSpec, prefix: str = "etl_", compact: bool = False) -> DataFrame:
    """The source's columns, then record id, text, gate and scores; one of these wins over a source column of its name, in its place.

    ``compact`` drops the columns of scorers that scored no row.
    """
    names = list(dict.fromkeys(e.name for e in spec.evaluators))
    if compact:
        seen = records.agg(*[F.count(f"`{score_column(n)}`").alias(n) for n in names]).first()
        names = [n for n in names if seen[n]]
    out = {"record_id": "__record_id", "transformed_data": "__text", "quality_gate_passed": "__gate"} | {f"score_{n}": score_column(n) for n in names}
    chosen = {f"{prefix}{new}": F.col(f"`{old}`") for new, old in out.items()}
    source = [c for c in records.columns if not c.startswith("__")]
    columns = [(chosen.pop(c) if c in chosen else F.col(f"`{c}`")).alias(c) for c in source]
    return records.select(*columns, *[c.alias(n) for n, c in chosen.items()])


def with_schema(rows: DataFrame, schema: dict[str, str], text: str) -> DataFrame:
    """``rows`` with the fields of a JSON text as columns of stated types; a text that is no such JSON gives nulls, and a field wins over a column of its name."""
    read = F.from_json(text, T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in schema.items()]))
    return rows.withColumns({k: read.getField(k) for k in schema})


def load(records: DataFrame, spec: LoadSpec, of: EvaluateSpec, prefix: str = "etl_", single_file: bool = False, key: str | None = None) -> int:
    """Write the loadable rows and return how many they are; where there are none, nothing is touched."""
    kind = resolve_format(spec.destination_type, spec.destination, "destination")
    rows = projected(records.where(loadable()), of, prefix)
    if spec.schema:
        rows = with_schema(rows, spec.schema, f"{prefix}transformed_data")
    if rows.isEmpty():
        return 0
    return write(rows, spec.destination, kind, spec.mode, single_file, key)


def write(rows: DataFrame, path: str, kind: Format, mode: str = "append", single_file: bool = False, key: str | None = None) -> int:
    """Write rows as a folder of files, or as one file; return their number.

    A path that doesn't exist is written in any mode. Append wants the same names, order and types. Upsert needs a key: rows
    whose key comes again are replaced. Overwriting the path that the rows are read from is safe.
    """
    spark = rows.sparkSession
    there = exists(spark, path)
    try:
        if not there or mode == "overwrite":
            return _replaced(rows, path, kind, single_file)
        if mode == "append":
            held = _read_back(spark, path, kind, rows)
            if single_file or not _is_folder(spark, path):
                before = held.count()
                return _replaced(held.unionByName(rows), path, kind, True) - before
            return _counted(rows, lambda df: _writer(df, kind, "append").save(path))
        if mode == "upsert" and key:
            held = _read_back(spark, path, kind, rows)
            merged = held.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
            n = rows.count()
            _replaced(merged, path, kind, single_file)
            return n
    except PySparkException as e:
        raise LoadError(f"Failed to load into {path}: {e}") from e
    raise LoadError(f"Unsupported load mode: {mode}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _writer(df: DataFrame, kind: Format, mode: str):
    if kind == Format.CSV:
        return df.write.mode(mode).options(header=True, escape='"').format("csv")
    return df.write.mode(mode).option("ignoreNullFields", False).format("parquet" if kind == Format.PARQUET else "json")


def _counted(rows: DataFrame, save) -> int:
    from pyspark.sql import Observation

    seen = Observation()
    save(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def _replaced(rows: DataFrame, path: str, kind: Format, single_file: bool) -> int:
    """Write beside the path, then move into its place, so that rows read from the path itself are safe."""
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}.new"
    delete(spark, beside)
    if single_file and kind == Format.JSON:
        rows = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)
        rows = rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"), F.count(F.lit(1)).alias("n"))
        n = rows.first()["n"]
        rows.select("value").write.text(beside)
    else:
        n = _counted(rows.coalesce(1) if single_file else rows, lambda df: _writer(df, kind, "overwrite").save(beside))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = fs_path(beside)
    if single_file:
        part = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
        source = part
    target, aside = fs_path(path), fs_path(f"{path.rstrip('/')}.old")
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    # What was there is moved aside and deleted last: at no moment are both versions gone.
    held = fs.exists(target)
    if held:
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise LoadError(f"{path} can't be moved aside")
    if not fs.rename(source, target):
        if held:
            fs.rename(aside, target)
        raise LoadError(f"{beside} can't be moved to {path}")
    if held:
        fs.delete(aside, True)
    if single_file:
        fs.delete(fs_path(beside), True)
    return n


def _read_back(spark: SparkSession, path: str, kind: Format, rows: DataFrame) -> DataFrame:
    """What a path holds, by the schema of what is to join it; other names, another order or values that don't fit its types are an error.

    The names of JSON columns have no order. Text files hold no types, so every value is read by the new rows' type, and one that can't
    be is an error, never a null. JSON tells text from numbers, so a text column joins no numbers there.
    """
    if kind == Format.PARQUET:
        held = spark.read.parquet(path)
        if held.dtypes != rows.dtypes:
            raise LoadError(f"{path} has other columns: {held.dtypes} and not {rows.dtypes}")
        return held
    if kind == Format.CSV:
        reader = spark.read.options(header=True, escape='"', multiLine=True)
        names = reader.csv(path).columns
        if names != rows.columns:
            raise LoadError(f"{path} has other columns: {names} and not {rows.columns}")
    else:
        reader = spark.read.option("multiLine", kind == Format.JSON and not _is_folder(spark, path))
        found = dict(reader.json(path).dtypes)
        if set(found) != set(rows.columns):
            raise LoadError(f"{path} has other columns: {list(found)} and not {rows.columns}")
        # An inferred text fits dates and the like; whether it does is told by reading it.
        odd = [c for c, t in rows.dtypes if t == "string" and found[c] in ("bigint", "double", "boolean")]
        if odd:
            raise LoadError(f"{path} has other types: {[(c, found[c]) for c in odd]} and not string")
    bad = "__unfit"
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema]
    told = reader.option("columnNameOfCorruptRecord", bad).schema(T.StructType([*fields, T.StructField(bad, T.StringType())]))
    held = told.csv(path) if kind == Format.CSV else told.json(path)
    unfit = held.where(F.col(bad).isNotNull()).head(1)
    if unfit:
        raise LoadError(f"{path} holds rows that don't fit {rows.dtypes}, as {unfit[0][bad]!r}")
    return held.drop(bad)


def to_database(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def scratch(spark: SparkSession, label: str) -> str:
    return new_path(spark, label)
