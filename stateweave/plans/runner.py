"""Run one import definition: scan, merge, validate, map, enrich, compare.

An extract feeds several results (entity, quarantine, guard, changes), and a
database should answer its query once.  The runner therefore stages the merged
extract and the entity in the shared folder; with ``stage=False`` all results
stay lazy plans over the source, except that ``autoid`` pins the order of its
new values.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stateweave.functions import convert
from stateweave.functions.evaluate import once
from stateweave.functions.text import null_if_empty
from stateweave.operators import changes, identity, lookups, mapping, projection, protect, quality, relations, spatial
from stateweave.operators.joining import same
from stateweave.plans.definition import Definition
from stateweave.session import staged
from stateweave.sources import databases, files

SYSTEM = ("_id", "_source", "_application", "_source_id", "_expiration_date", "datum_actueel_tot")


@dataclass(frozen=True)
class Load:
    """What one run yields; each frame is lazy."""

    entity: DataFrame
    quarantine: DataFrame
    guard: DataFrame
    changes: DataFrame | None


def scan(
    spark: SparkSession,
    definition: Definition,
    store: Mapping[str, object] | None = None,
    path: str | None = None,
    views: Mapping[str, DataFrame] | None = None,
    recent: bool = False,
    partition: databases.Partitioning | None = None,
) -> DataFrame:
    """The extract of a definition: its query in a database or over views, or its file."""
    if store is not None:
        return databases.scan_query(spark, store, definition.sql(recent), partition)
    if views is not None:
        return databases.scan_sql(spark, definition.sql(recent), views)
    if path is None:
        raise ValueError("give a store, views or a path")
    config = definition.read_config
    if "file_filter" in config and not (config.get("file_type") or config.get("filetype")):
        return files.scan_files(spark, path, str(config["file_filter"]))
    return files.scan_configured(spark, path, config)


def _checked_values(extract: DataFrame, specs: Mapping[str, Mapping], types: Mapping[str, str]):
    """(path, text or list of texts, type, format) of all that an attribute reads as text and whose type is known.

    Attributes are walked into objects and references, and values are taken as
    their filters leave them.
    """
    for name, spec in specs.items():
        source = spec["source_mapping"]
        if isinstance(source, Mapping):
            yield from mapping.nested_values(extract, name, spec, types)
            continue
        type_ = mapping.text_type(spec, types.get(name))
        if type_ is None or type_ == "manyreference" or source.startswith("="):
            continue
        value = mapping.source_value(extract, source)
        if isinstance(extract.select(value.alias("v")).schema["v"].dataType, T.StringType):
            yield name, mapping.apply_filters(value, spec.get("filters") or []), type_, spec.get("format")


def _with_errors(extract: DataFrame, specs: Mapping[str, Mapping], types: Mapping[str, str]) -> DataFrame:
    """The extract with the bad values of each row and their paths (``ref.begin``, ``refs[2].begin``, from 0); protected ones are masked."""

    def error(path: Column, value: Column, type_: str, fmt: str | None) -> Column:
        shown = protect.masked(value) if type_.startswith(protect.SECURE) else value
        return F.when(convert.is_bad(value, type_, fmt), F.struct(path.alias("attribute"), shown.alias("value")))

    def errors(path: str, values: Column, type_: str, fmt: str | None) -> Column:
        head, tail = path.split("[]")
        place = lambda i: F.concat(F.lit(f"{head}["), i.cast("string"), F.lit(f"]{tail}"))
        return F.transform(values, lambda x, i: error(place(i), x, type_, fmt))

    values = list(_checked_values(extract, specs, types))
    single = [error(F.lit(path), *rest) for path, *rest in values if "[]" not in path]
    lists = [errors(path, *rest) for path, *rest in values if "[]" in path]
    empty = F.array().cast("array<struct<attribute:string,value:string>>")
    found = [*([F.array(*single)] if single else []), *(F.coalesce(x, empty) for x in lists)]
    return once(extract, "_errors", F.array_compact(F.concat(*found)) if found else empty)


def _split(checked: DataFrame, key: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows to load and the quarantine, which has a row for each bad value and for each row of a key that comes more than once.

    Keys are counted before any row is refused.  A row whose state number is
    bad has no key to be counted by.
    """
    columns = list(key)
    sound = ~F.exists("_errors", lambda e: F.array_contains(F.lit(list(key.values())), e["attribute"]))
    doubled = quality.duplicate_keys(checked.where(sound), columns)
    marked = checked.alias("c").join(doubled.alias("d"), same("c", "d", columns), "left").select("c.*", (F.col("d.n").isNotNull() & sound).alias("__twice"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in columns])
    twice = F.when(F.col("__twice"), F.array(F.struct(F.lit("_key").alias("attribute"), name.alias("value")))).otherwise(F.array())
    bad = marked.select(*[F.col(k).alias(n) for k, n in key.items()], F.explode(F.concat("_errors", twice)).alias("e"))
    valid = marked.where((F.size("_errors") == 0) & ~F.col("__twice")).drop("_errors", "__twice", *[k for k in columns if k != "__id"])
    return valid, bad.select(*key.values(), "e.attribute", "e.value")


def _sources(spec: Mapping) -> list[str]:
    source = spec["source_mapping"]
    values = [v for k, v in source.items() if k != "format"] if isinstance(source, Mapping) else [source]
    return [v for v in values if not v.startswith("=")]


def _protected(extract: DataFrame, specs: Mapping[str, Mapping], types: dict[str, str], salt: str | None) -> tuple[DataFrame, dict, dict]:
    """Pseudonyms in place of what protected attributes read, before anything is written.

    The column in clear stays only where another attribute reads it too.
    """
    secure = {n: s for n, s in specs.items() if types.get(n, "").startswith(protect.SECURE)}
    if not secure:
        return extract, dict(specs), types
    if salt is None:
        raise ValueError(f"protected attributes {sorted(secure)} need a salt")
    read = {v for s in secure.values() for v in _sources(s) if v in extract.columns}
    elsewhere = {v.split(".")[0] for n, s in specs.items() if n not in secure for v in _sources(s)} | {"_errors"}
    name = lambda v: f"__secure_{v}" if v in read else v
    extract = extract.withColumns({name(v): protect.pseudonym(null_if_empty(F.col(f"`{v}`").cast("string")), salt) for v in sorted(read)})
    extract = extract.drop(*[v for v in read if v not in elsewhere])

    def renamed(spec: Mapping) -> dict:
        source = spec["source_mapping"]
        new = {k: name(v) if k != "format" else v for k, v in source.items()} if isinstance(source, Mapping) else name(source)
        return {**{k: v for k, v in spec.items() if k not in ("format", "filters")}, "source_mapping": new}

    specs = {n: renamed(s) if n in secure else s for n, s in specs.items()}
    kinds = {n: t for n, t in types.items() if n not in secure}
    return extract, specs, kinds


def _key(definition: Definition) -> list[str]:
    return ["_id", *(["volgnummer"] if "volgnummer" in definition.mapping else [])]


def _geounion(
    entity: DataFrame, key: list[str], spec: Mapping, out: str, members: Mapping[str, DataFrame]
) -> DataFrame:
    """Union of the latest geometries of the members each state refers to."""
    attribute, _ = spec["on"].split(".")
    dataset, column = spec["from"].rsplit(".", 1)
    refs = relations.explode_references(entity, attribute, key).where(F.col(mapping.REF).isNotNull())
    refs = refs.select(F.struct(*key).alias("__area"), mapping.REF).distinct()
    states = members[dataset].where(F.col(column).isNotNull())
    states = states.select(column, *[c for c in ("volgnummer",) if c in states.columns], spec["geometrie"])
    latest = lookups.latest_one(states, [column], [c for c in states.columns if c == "volgnummer"])
    joined = refs.join(latest, F.col(mapping.REF) == F.col(column)).select("__area", spec["geometrie"])
    union = spatial.geometry_union(joined, "__area", spec["geometrie"], out="__union").drop("parts")
    placed = entity.drop(out).withColumn("__area", F.struct(*key))
    return placed.join(union, "__area", "left").drop("__area").withColumnRenamed("__union", out)


def _missing_sources(definition: Definition, extract: DataFrame) -> set[str]:
    """Attributes that read a column the extract lacks."""
    present = {c.lower() for c in extract.columns}
    lacks = lambda v: v.lower() not in present and v.split(".")[0].lower() not in present
    return {name for name, spec in definition.mapping.items() if any(map(lacks, _sources(spec)))}


def run(
    definition: Definition,
    extract: DataFrame,
    types: Mapping[str, str] | None = None,
    merge_with: DataFrame | None = None,
    registry: DataFrame | None = None,
    members: Mapping[str, DataFrame] | None = None,
    current: DataFrame | None = None,
    mode: str = "full",
    stage: bool = True,
    lenient: bool = False,
    salt: str | None = None,
) -> Load:
    """Turn an extract into its entity and compare it with the current snapshot.

    ``types`` declares attribute types, ``registry`` holds identifiers given out
    before, ``members`` the datasets a geometry union draws on.  An attribute that
    reads a column the extract lacks is an error, or NULL when ``lenient``.

    Rows with a bad value, in a reference or an object as well, and all rows of a
    key that comes more than once go to the quarantine: they are not loaded, and
    their states are not deleted either.
    When the extract has fewer rows than the definition asks for, the guard says
    so and there are no changes.  Attributes of ``secure_*`` types are replaced
    with pseudonyms under ``salt`` before anything is written.
    """
    types = dict(types or {})
    if definition.merge and merge_with is not None:
        extract = lookups.merge_dataset(extract, merge_with, definition.merge["on"], definition.merge["copy"])
    left_out = dict.fromkeys(definition.not_provided)
    if lenient:
        left_out |= dict.fromkeys(sorted(_missing_sources(definition, extract)))
    specs = {n: s for n, s in definition.mapping.items() if n not in left_out}
    absent = {n: convert.SPARK_TYPES.get(types.get(n, "string"), "string") for n in left_out}
    key = _key(definition)
    checked = _with_errors(extract, specs, types).withColumn("__id", F.col(f"`{definition.entity_id}`").cast("string"))
    places = {"__id": "_id"}
    if "volgnummer" in key:
        checked = checked.withColumn("__number", mapping.attribute(extract, definition.mapping["volgnummer"], types.get("volgnummer")))
        places["__number"] = "volgnummer"
    checked, specs, types = _protected(checked, specs, types, salt)
    if stage:
        checked = staged(checked, "extract")
    valid, quarantine = _split(checked, places)
    guard = quality.row_guard({definition.table: (checked, definition.min_rows)})

    entity = mapping.map_entity(valid, specs, types, keep=[F.col("__id").alias("_id")])
    entity = projection.add_not_provided(entity, absent)
    lineage = {"_source": definition.source_name, "_application": definition.application}
    entity = entity.withColumns({n: F.lit(v) for n, v in lineage.items()})

    for name, spec in definition.enrich.items():
        if spec["type"] == "autoid":
            if name not in entity.columns:
                entity = entity.withColumn(name, F.lit(None).cast("string"))
            entity = identity.autoid(entity, spec["on"], name, spec["template"], registry)
        elif spec["type"] == "geounion":
            entity = _geounion(entity, _key(definition), spec, name, members or {})
        else:
            raise ValueError(f"unknown enrichment {spec['type']!r}")

    if stage:
        entity = staged(entity, "entity")
    diff = None
    if current is not None:
        compared = [c for c in entity.columns if c not in (*key, *SYSTEM)]
        # A refused state spares itself; one whose number is not known spares the record.
        known = reduce(and_, [F.col(k).isNotNull() for k in key[1:]], F.lit(True))
        diff = changes.snapshot_diff(
            current, entity, key, compare=compared, mode=mode, source="_source",
            loaded_sources=[definition.source_name], seen=quarantine.where(known), seen_key=key,
        )
        if len(key) > 1:
            diff = changes.spare(diff, quarantine.where(~known), ["_id"])
        diff = diff.where(guard.agg(F.min("ok").alias("ok")).scalar())
    return Load(entity, quarantine, guard, diff)


def write_entity(entity: DataFrame, root: str, definition: Definition) -> str:
    """Write the entity as Parquet below ``root/catalogue.entity`` and return the path."""
    path = f"{root.rstrip('/')}/{definition.table}"
    entity.write.mode("overwrite").parquet(path)
    return path
