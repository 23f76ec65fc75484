"""Query scans: a named database over JDBC, or tables and views Spark already knows."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Store type -> JDBC driver class and URL shape.
_KINDS = {
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}"),
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "sqlserver": (
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
    ),
}


@dataclass(frozen=True)
class Partitioning:
    """Parallel read: a numeric, date or timestamp column, its bounds and the number of readers.

    The bounds only place the cuts; rows outside them are still read.
    """

    column: str
    lower: str
    upper: str
    readers: int


def jdbc_options(store: Mapping[str, object]) -> dict[str, str]:
    """JDBC options of a store: ``type`` with host, port and database, or a ready ``url``."""
    if "url" in store:
        options = {"url": str(store["url"])}
        if "driver" in store:
            options["driver"] = str(store["driver"])
    else:
        kind = str(store["type"])
        if kind not in _KINDS:
            raise ValueError(f"store type {kind!r} cannot be queried")
        driver, url = _KINDS[kind]
        options = {"driver": driver, "url": url.format(**store)}
    for ours, theirs in (("username", "user"), ("password", "password")):
        if store.get(ours) is not None:
            options[theirs] = str(store[ours])
    return options


def scan_options(
    store: Mapping[str, object], sql: str, partition: Partitioning | None = None, fetch_size: int = 10_000
) -> dict[str, str]:
    """All reader options of a query scan.

    Without a partitioning the database answers on one connection; with it the
    query becomes a derived table each reader cuts its own range from.
    """
    options = jdbc_options(store) | {"fetchsize": str(fetch_size)}
    text = sql.strip().rstrip(";")
    if partition is None:
        return options | {"query": text}
    return options | {
        "dbtable": f"({text}) q",
        "partitionColumn": partition.column,
        "lowerBound": partition.lower,
        "upperBound": partition.upper,
        "numPartitions": str(partition.readers),
    }


def scan_query(
    spark: SparkSession, store: Mapping[str, object], sql: str, partition: Partitioning | None = None
) -> DataFrame:
    """Run a definition's SQL in its own database and read the rows."""
    return spark.read.format("jdbc").options(**scan_options(store, sql, partition)).load()


def scan_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL over frames given by name (and over tables of the catalog).

    A schema-qualified name such as ``cadastre.parcel`` may be given; it is read
    through a view whose name has the dot replaced.
    """
    for name, df in (views or {}).items():
        view = name.replace(".", "__")
        df.createOrReplaceTempView(view)
        if view != name:
            # The whole name only, not a longer one it begins or ends.
            sql = re.sub(rf"(?<![\w.]){re.escape(name)}(?!\w)", view, sql)
    return spark.sql(sql.strip().rstrip(";"))
