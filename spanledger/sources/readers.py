"""Reading stored tables and report records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.sources.schemas import LISTS, MATRICES, TABLES


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, source: str = "parquet") -> DataFrame:
    """One of ``TABLES`` from ``folder``, with its fixed schema and only ``columns``.

    ``source`` is any file format of Spark. Columns that the files lack are null.
    """
    df = spark.read.schema(TABLES[name]).format(source).load(f"{folder.rstrip('/')}/{name}")
    return df.select(*columns) if columns else df


def record_schema(fields: list[str]) -> T.StructType:
    """The schema of report records with these text fields and the fixed lists and matrices."""
    matrix = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    texts = [T.StructField(f, T.StringType()) for f in fields if f not in {*LISTS, *MATRICES, "photo_coords"}]
    return T.StructType(
        [
            *texts,
            *[T.StructField(f, T.ArrayType(T.StringType())) for f in LISTS],
            T.StructField("photo_coords", T.ArrayType(T.ArrayType(T.DoubleType()))),
            *[T.StructField(f, matrix) for f in MATRICES],
        ]
    )


def read_report_records(spark: SparkSession, path: str, fields: list[str], key: str = "session_id") -> DataFrame:
    """Report records, one JSON object per file, named by their file.

    A damaged file gives one row with nulls instead of failing the read.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    records = spark.read.schema(record_schema(fields)).option("multiLine", True).json(path)
    return records.select(name.alias(key), "*")


def record_defects(records: DataFrame, key: str) -> DataFrame:
    """The matrices as rows: key, tbl, element, elem_ord, defect, obs."""
    each = F.array(*[F.struct(F.lit(m).alias("tbl"), F.col(m).alias("matrix")) for m in MATRICES])
    tables = records.select(key, F.inline(each))
    elements = tables.select(key, "tbl", F.posexplode("matrix").alias("elem_ord", "element", "row"))
    return elements.select(key, "tbl", "element", "elem_ord", F.explode("row").alias("defect", "obs"))


def record_photos(records: DataFrame, key: str) -> DataFrame:
    """The four photo lists as rows: key, ord, path, title, category, coord (x, y)."""
    zipped = F.arrays_zip("photos", "photo_titles", "photo_categories", "photo_coords")
    p = F.col("p")
    coord = F.when(
        F.size(p["photo_coords"]) >= 2,
        F.struct(F.get(p["photo_coords"], 0).alias("x"), F.get(p["photo_coords"], 1).alias("y")),
    )
    return records.select(key, F.posexplode(zipped).alias("ord", "p")).select(
        key, "ord", p["photos"].alias("path"), p["photo_titles"].alias("title"),
        p["photo_categories"].alias("category"), coord.alias("coord"),
    )
