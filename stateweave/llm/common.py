"""Helpers the operators here share: Arrow passes that keep the other columns, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from stateweave.session import shared_path, staged

__all__ = ["append_column", "arrow_schema", "shared_path", "staged", "texts", "text_key"]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A batch's strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def arrow_schema(schema: StructType) -> pa.Schema:
    """The Arrow schema of rows that a task gives back to Spark."""
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def append_column(df: DataFrame, column: str, name: str, kind: DataType, each: Callable[[list[str]], list]) -> DataFrame:
    """Add a column that ``each`` makes from a batch of texts. An input column called ``name`` is replaced."""
    base = df.drop(name)
    schema = StructType([*base.schema.fields, StructField(name, kind)])
    made = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            result = pa.array(each(texts(batch, column)), made)
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, name])

    return base.mapInArrow(run, schema)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))
