"""Delimited files and file listings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stateweave.operators.projection import lowercase_keys

CORRUPT = "_corrupt_record"

# Encoding names in definitions -> Java charset names.
_ENCODINGS = {"latin-1": "ISO-8859-1", "utf-8": "UTF-8"}


def charset(name: str) -> str:
    return _ENCODINGS.get(name.lower(), name)


def scan_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "UTF-8",
    columns: list[str] | None = None,
    flag_wrong_width: bool = False,
    header: bool = True,
) -> DataFrame:
    """Delimited file, every column text, quotes doubled inside quoted fields.

    Short rows are padded with NULL.  Naming the ``columns`` saves the pass that
    reads the header; with ``flag_wrong_width`` the raw text of a row with too few
    or too many fields is kept in ``_corrupt_record``.
    """
    reader = (
        spark.read.option("header", header)
        .option("sep", delimiter)
        .option("encoding", charset(encoding))
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
    )
    if columns is not None:
        fields = [T.StructField(c, T.StringType()) for c in columns]
        if flag_wrong_width:
            fields.append(T.StructField(CORRUPT, T.StringType()))
            # A pruned parser would count only the fields a query asks for.
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
        # The header was given, so it need not match the file's spelling.
        reader = reader.schema(T.StructType(fields)).option("enforceSchema", True)
    elif flag_wrong_width:
        raise ValueError("flag_wrong_width needs the column names")
    return reader.csv(path)


def scan_configured(spark: SparkSession, path: str, read_config: Mapping[str, object]) -> DataFrame:
    """Delimited scan as a definition's reader section asks for it."""
    kind = str(read_config.get("file_type") or read_config.get("filetype") or "CSV")
    if kind.upper() != "CSV":
        raise ValueError(f"file type {kind!r} must be exported to delimited text first")
    df = scan_csv(
        spark,
        path,
        delimiter=str(read_config.get("delimiter") or read_config.get("separator") or ","),
        encoding=str(read_config.get("encoding") or "UTF-8"),
    )
    for name in read_config.get("operators") or []:
        if name != "lowercase_keys":
            raise ValueError(f"unknown reader operator {name!r}")
        df = lowercase_keys(df)
    return df


def scan_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """One row per file below the root: name (path below the root), length and time; contents stay unread."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # A path reads scheme:/…/root/name; only the part below the root is the object's name.
    base = root.rstrip("/") + "/"
    below = F.substring(F.col("path"), F.instr(F.col("path"), base) + len(base), F.length("path"))
    df = listed.select(below.alias("name"), "length", "modificationTime")
    return df if pattern is None else filter_files(df, pattern)


def filter_files(df: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Rows whose path matches a definition's ``file_filter`` expression, anywhere from the start."""
    return df.where(F.col(column).rlike("^(?:" + pattern + ")"))
