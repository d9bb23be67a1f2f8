"""Readers of surfaces and writers of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETER = "struct<name:string,type:string,optional:boolean,variadic:boolean>"
SYMBOLS = (
    "version string, qualified_name string, name string, kind string, visibility string, file string, package string, import_path string, "
    "line int, has_signature boolean, parameters array<" + PARAMETER + ">, return_type string, "
    "type_parameters array<struct<name:string,constraint:string,default:string>>, is_async boolean, extends string, implements array<string>, "
    "is_abstract boolean, is_readonly boolean, is_static boolean, accessor_kind string, parent_qname string, ordinal int"
)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Surfaces as JSON lines; missing fields are null."""
    return spark.read.schema(SYMBOLS).json(path)


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Source files as ``file``, ``content``."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def exported_declarations(files: DataFrame) -> DataFrame:
    """Exported declarations of TypeScript sources: ``file``, ``kind``, ``name``, found line by line.

    A pattern, not a parser: declarations that span lines before their name are missed.
    """
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    pattern = r"^\s*export\s+(?:declare\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"
    found = lines.where(F.col("line").rlike(pattern))
    return found.select("file", (F.col("line_no") + 1).alias("line"), F.regexp_extract("line", pattern, 1).alias("kind"), F.regexp_extract("line", pattern, 2).alias("name"))


def imports(files: DataFrame) -> DataFrame:
    """Named imports: ``file``, ``symbol``, ``module``."""
    pattern = r"import\s+(?:type\s+)?\{([^}]*)\}\s+from\s+['\"]([^'\"]+)['\"]"
    each = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("names"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("module"))
    rows = files.select("file", F.inline(each))
    return rows.select("file", F.explode(F.split("names", ",")).alias("s"), "module").select("file", F.regexp_replace(F.trim("s"), r"\s+as\s+.*$", "").alias("symbol"), "module").where("symbol <> ''")
