"""Reading and writing tables, and the validation of incoming files."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import file_ext
from ..operators.filters import stored_comparison
from ..operators.roles import col, nan_to_null
from .records import LATIN, csv_records, file_encodings

MAX_BYTES = 104_857_600
EXTENSIONS = (".csv", ".json", ".parquet")
CORRUPT = "_corrupt_record"
#: Different first records that the files of one table may have.
HEADERS = 100


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             encoding: str | None = None, multiline: bool = False, **options) -> DataFrame:
    """CSV with a header. Types are inferred unless a schema saves that extra pass.

    Without ``encoding`` every file is read as UTF-8 if all its bytes are, else as ISO-8859-1;
    a given encoding saves the scan that finds out.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    if encoding is not None:
        return nan_to_null(reader.option("encoding", encoding).csv(path))
    kinds = file_encodings(spark, path)
    found = {r["latin"] for r in kinds.select("latin").distinct().collect()}
    if len(found) < 2:
        return nan_to_null(reader.option("encoding", LATIN if True in found else "utf-8").csv(path))
    parts = []
    for latin, name in ((False, "utf-8"), (True, LATIN)):
        # names of files, as the driver lists them for every read
        files = [unquote(r["file"]) for r in kinds.filter(F.col("latin") == latin).select("file").collect()]
        parts.append(reader.option("encoding", name).csv(files))
    return nan_to_null(parts[0].unionByName(parts[1]))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).json(path))


def read_parquet(spark: SparkSession, path: str, where: Sequence[tuple] = ()) -> DataFrame:
    """Parquet with NaN as null. Comparisons in ``where`` (column, op, value) are made on the
    stored columns, so that they also skip row groups for float columns."""
    df = spark.read.parquet(path)
    for column, op, value in where:
        df = df.filter(stored_comparison(column, df.schema[column].dataType, op, value))
    return nan_to_null(df)


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType,
                          sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the text of those that do not with their file.

    Records are parsed as values, so that every field is checked whatever columns
    are selected later; the file reader would skip fields nobody asks for. They may
    hold line breaks in quotes. The header of each file, quoted or not, says which column is
    which; columns beyond the schema are left out, absent ones are null, and a first record that names no column
    of the schema is a row in the schema's order. Each file is UTF-8 or else ISO-8859-1.
    """
    records, heads = csv_records(spark, path, sep)
    texts = sorted(r["record"] for r in heads.select("record").distinct().limit(HEADERS + 1).collect())
    if len(texts) > HEADERS:
        raise ValueError(f"the files have more than {HEADERS} different first records")
    names = schema.fieldNames()
    rows = records.join(F.broadcast(heads.select("file", F.col("record").alias("_text"))), "file")
    # a file without a header is told by its place: orders[0] is the schema's own
    orders, headed = [names], []
    for text in texts:
        named = [n.strip() for n in next(csv.reader([text.lstrip("\ufeff")], delimiter=sep))]
        if not set(named) & set(names):
            continue
        doubled = {n for n in named if n in names and named.count(n) > 1}
        if doubled:
            raise ValueError(f"a header names {sorted(doubled)} more than once")
        headed.append(text)
        orders.append(named)
    which = F.lit(0)
    for i, text in enumerate(headed, 1):
        which = F.when(F.col("_text") == text, i).otherwise(which)
    rows = rows.withColumn("_which", which).filter(~(F.col("first") & (F.col("_which") > 0)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "sep": sep}
    used = [i for i in range(len(orders)) if i or len(headed) < len(texts) or not texts]
    for i in used:
        wide = T.StructType([T.StructField(f"_{j}", schema[n].dataType if n in names else T.StringType())
                             for j, n in enumerate(orders[i])] + [T.StructField(CORRUPT, T.StringType())])
        rows = rows.withColumn(f"_row{i}", F.when(F.col("_which") == i, F.from_csv("record", wide.toDDL(), options)))
    value = lambda n: F.coalesce(*[F.col(f"_row{i}")[f"_{orders[i].index(n)}"] if n in orders[i]
                                   else F.lit(None).cast(schema[n].dataType) for i in used])
    broken = F.coalesce(*[F.col(f"_row{i}")[CORRUPT] for i in used]).isNotNull()
    good = rows.filter(~broken).select(*[value(n).alias(n) for n in names])
    return nan_to_null(good), rows.filter(broken).select(F.element_at(F.split("file", "/"), -1).alias("file"), "record")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, length and time of every file; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                               "length", F.col("modificationTime").alias("modified")))


def check_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES,
                extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """One status per file of a directory: ok, bad_extension or too_large. Spark leaves out files without a byte."""
    ext = file_ext(F.col("name"))
    status = (F.when(~ext.isin(list(extensions)), "bad_extension").when(F.col("length") > max_bytes, "too_large")
              .otherwise("ok"))
    return list_files(spark, path).select("name", ext.alias("extension"), "length", status.alias("status"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_many(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """All tables below one directory."""
    out = []
    for name, df in tables.items():
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out
