"""Import definitions: parsing one, and finding the right one among many with a join."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

NOT_FOUND = "no definition"
AMBIGUOUS = "several applications, none is the default"


class DefinitionError(ValueError):
    """A definition is missing, ambiguous or malformed."""


def _lines(query: object) -> str | None:
    if query is None:
        return None
    return query if isinstance(query, str) else "\n".join(line.rstrip("\n") for line in query)


@dataclass(frozen=True)
class Definition:
    """One import definition.  Unknown keys are ignored."""

    catalogue: str
    entity: str
    application: str
    source_name: str
    entity_id: str
    mapping: Mapping[str, Mapping]
    default: bool = False
    min_rows: int = 1
    query: str | None = None
    recent: str | None = None
    merge: Mapping | None = None
    enrich: Mapping[str, Mapping] = field(default_factory=dict)
    read_config: Mapping = field(default_factory=dict)
    file: str | None = None
    not_provided: Sequence[str] = ()

    @classmethod
    def from_dict(cls, d: Mapping, folder: str | None = None) -> Definition:
        """Build from parsed JSON; the attribute mapping is the one key that ends in ``mapping``.

        A query that names a ``.sql`` file is read from the folder, and a missing
        file is an error.
        """
        mappings = [v for k, v in d.items() if k.endswith("mapping")]
        if len(mappings) != 1:
            raise DefinitionError("a definition has exactly one attribute mapping")
        try:
            source = d["source"]
            query = source.get("query")
            if isinstance(query, str) and query.endswith(".sql"):
                if folder is None:
                    raise DefinitionError(f"no folder given to find {query}")
                query = (Path(folder) / query).read_text(encoding="utf-8")
            return cls(
                catalogue=d["catalogue"],
                entity=d["entity"],
                application=source["application"],
                source_name=source["name"],
                entity_id=source["entity_id"],
                mapping=mappings[0],
                default=bool(d.get("default")),
                min_rows=d.get("min_rows", 1),
                query=_lines(query),
                recent=_lines(source.get("recent")),
                merge=source.get("merge"),
                enrich=source.get("enrich") or {},
                read_config=source.get("read_config") or {},
                file=(source.get("application_config") or {}).get("filename"),
                not_provided=tuple(d.get("not_provided_attributes") or ()),
            )
        except (KeyError, FileNotFoundError) as missing:
            raise DefinitionError(f"definition lacks {missing}") from missing

    @classmethod
    def from_json(cls, text: str, folder: str | None = None) -> Definition:
        return cls.from_dict(json.loads(text), folder)

    def sql(self, recent: bool = False) -> str:
        """Query text, with the extra predicate of a partial load when asked for."""
        if self.query is None:
            raise DefinitionError(f"{self.catalogue}.{self.entity} has no query")
        return f"{self.query}\n{self.recent}" if recent and self.recent else self.query

    @property
    def table(self) -> str:
        return f"{self.catalogue}.{self.entity}"


def read_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """All definitions of a folder: (catalogue, entity, application, is_default, file, body)."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    v = F.try_parse_json("value")
    pick = lambda path, type_="string": F.try_variant_get(v, path, type_)
    return texts.select(
        pick("$.catalogue").alias("catalogue"),
        pick("$.entity").alias("entity"),
        pick("$.source.application").alias("application"),
        F.coalesce(pick("$.default", "boolean"), F.lit(False)).alias("is_default"),
        F.input_file_name().alias("file"),
        F.col("value").alias("body"),
    )


def find_definitions(requests: DataFrame, definitions: DataFrame, take: str = "file") -> DataFrame:
    """Answer each request (catalogue, entity, application or NULL) with a definition or an error.

    A named application must exist.  Without one the default wins, then the only
    application there is; several without a default are an error.
    """
    pairs = definitions.groupBy("catalogue", "entity").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.when(F.col("is_default"), F.col(take))).alias("__default"),
        F.min(take).alias("__any"),
    )
    named = definitions.groupBy("catalogue", "entity", "application").agg(F.min(take).alias("__named"))
    joined = requests.join(pairs, ["catalogue", "entity"], "left").join(
        named, ["catalogue", "entity", "application"], "left"
    )
    implicit = F.coalesce(F.col("__default"), F.when(F.col("__n") == 1, F.col("__any")))
    asked = F.col("application").isNotNull()
    found = F.when(asked, F.col("__named")).otherwise(implicit)
    error = F.when(found.isNull(), F.when(~asked & (F.col("__n") > 1), F.lit(AMBIGUOUS)).otherwise(F.lit(NOT_FOUND)))
    return joined.select(*requests.columns, found.alias(take), error.alias("error"))


def get_definition(
    spark: SparkSession, folder: str, catalogue: str, entity: str, application: str | None = None
) -> Definition:
    """One definition of a folder; its query file is looked for in the same folder."""
    request = spark.range(1).select(
        F.lit(catalogue).alias("catalogue"),
        F.lit(entity).alias("entity"),
        F.lit(application).cast("string").alias("application"),
    )
    answer = find_definitions(request, read_definitions(spark, folder), take="body").first()
    if answer["error"]:
        raise DefinitionError(f"{catalogue} {entity} {application}: {answer['error']}")
    return Definition.from_json(answer["body"], folder)
