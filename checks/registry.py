"""Register of queries: a name, a function of the tables, and the equal SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stateweave.session import tune

CHECKS: dict[str, Check] = {}


class Tables:
    """The tables of one folder as attributes, each read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Check:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(tune(spark), folder))


def check(name: str, sql: str | None = None):
    """Register the decorated query under a name."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"query {name} exists")
        CHECKS[name] = Check(name, build, sql)
        return build

    return add
