"""Attribute mapping: source columns to typed attributes, references, structs and lists.

A mapping builds Columns from a definition and the extract's schema, so one
``select`` maps a whole entity: no shuffle, no Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stateweave.functions import convert
from stateweave.functions.text import null_if_empty

REF = "bronwaarde"


# --- values ---------------------------------------------------------------

def literal(text: str) -> Column:
    """Constant of a ``=text`` mapping."""
    return F.lit(text[1:])


def _type_of(df: DataFrame, name: str) -> T.DataType:
    # Only the name is looked up; the schema is already resolved.
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f.dataType
    raise KeyError(name)


def _has(df: DataFrame, name: str) -> bool:
    return any(c.lower() == name.lower() for c in df.columns)


def path_get(df: DataFrame, path: str) -> Column:
    """Field at a dotted path: in a struct, or in JSON text of unknown schema (as text)."""
    head, *steps = path.split(".")
    kind, c = _type_of(df, head), F.col(f"`{head}`")
    if isinstance(kind, T.StringType):
        return F.try_variant_get(F.try_parse_json(c), "$." + ".".join(steps), "string")
    for step in steps:
        if isinstance(kind, T.ArrayType):
            return path_get_all(df, path)
        c, kind = c[step], kind[step].dataType
    return c


def path_get_all(df: DataFrame, path: str) -> Column:
    """Field at a dotted path of every element of an array of objects."""
    head, *steps = path.split(".")
    kind, c = _type_of(df, head), F.col(f"`{head}`")
    if isinstance(kind, T.StringType):
        items = F.from_json(c, "array<string>")
        field = "$." + ".".join(steps)
        return F.transform(items, lambda e: F.try_variant_get(F.try_parse_json(e), field, "string"))

    def dig(e):
        for step in steps:
            e = e[step]
        return e

    return F.transform(c, dig)


def looks_like_list(c: Column) -> Column:
    return F.ltrim(c).startswith("[")


def path_list(df: DataFrame, path: str) -> Column:
    """Field at a dotted path as a list: of every element of an array, or of the one object."""
    head = path.split(".")[0]
    if isinstance(_type_of(df, head), T.StringType):
        one = path_get(df, path)
        return F.when(looks_like_list(F.col(f"`{head}`")), path_get_all(df, path)).otherwise(
            F.when(one.isNotNull(), F.array(one))
        )
    return source_value(df, path)


def source_value(df: DataFrame, source: str) -> Column:
    """A literal (``=text``), a column, or a dotted path."""
    if source.startswith("="):
        return literal(source)
    if _has(df, source):
        return F.col(f"`{source}`")
    if "." in source:
        head = source.split(".")[0]
        if isinstance(_type_of(df, head), T.ArrayType):
            return path_get_all(df, source)
        return path_get(df, source)
    raise KeyError(f"the extract has no column {source!r}")


def apply_filters(c: Column, chain: Sequence[Sequence[str]]) -> Column:
    """Closed set of value filters: ``re.sub`` and ``upper``."""
    for name, *args in chain:
        if name == "re.sub":
            pattern, replacement = args
            # Group references are written \2 in the definition and $2 in Java.
            java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
            c = F.regexp_replace(c, pattern, java)
        elif name == "upper":
            c = F.upper(c)
        else:
            raise ValueError(f"unknown filter {name!r}")
    return c


# --- structs and references ---------------------------------------------------

def struct_of(parts: Mapping[str, Column]) -> Column:
    """Struct of the parts; NULL when every part is NULL."""
    any_known = F.coalesce(*[c.cast("string") for c in parts.values()]).isNotNull()
    return F.when(any_known, F.struct(*[c.alias(k) for k, c in parts.items()]))


def json_object(parts: Mapping[str, Column]) -> Column:
    """JSON text with one key per part; a part that is JSON text itself is nested, not quoted."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)

    def rendered(c):
        text = c.cast("string")
        return F.coalesce(convert.to_json(text), F.when(text.isNotNull(), quoted(text)), F.lit("null"))

    keys = [F.concat(F.lit(f'"{k}":'), rendered(c)) for k, c in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *keys), F.lit("}"))


def reference(value: Column, **extra: Column) -> Column:
    """Single reference; NULL (or '') refers to nothing."""
    value = null_if_empty(value.cast("string"))
    return F.when(value.isNotNull(), F.struct(value.alias(REF), *[c.alias(k) for k, c in extra.items()]))


def split_items(c: Column, separator: str) -> Column:
    """Items of a separator string, trimmed of blanks; empty ones keep their place."""
    return F.transform(F.split(c, re.escape(separator)), lambda x: F.trim(x))


def split_values(c: Column, separator: str) -> Column:
    """Items of a separator string, trimmed of blanks; empty ones (a trailing separator) left out."""
    return F.filter(split_items(c, separator), lambda x: x != "")


def _list_of(values: Column, name: str) -> Column:
    return F.transform(values, lambda x: F.struct(x.alias(name)))


def many_reference(value: Column, separator: str | None = None, name: str = REF) -> Column:
    """List of references from a separator string, a JSON array, or one single string."""
    if separator is not None:
        return _list_of(split_values(value, separator), name)
    listed = F.from_json(value, "array<string>")
    single = F.when(null_if_empty(value).isNotNull(), F.array(value))
    return _list_of(F.when(looks_like_list(value), listed).otherwise(single), name)


def zipped_reference(values: Column, **lists: Column) -> Column:
    """References zipped with parallel lists (their own start dates); '' in a list means none."""
    names = [REF, *lists]
    zipped = F.arrays_zip(values, *lists.values())
    cell = lambda e, i: null_if_empty(e[str(i)] if i else e["0"])
    pairs = F.transform(zipped, lambda e: F.struct(*[cell(e, i).alias(n) for i, n in enumerate(names)]))
    return F.filter(pairs, lambda e: e[REF].isNotNull())


def force_list(values: Mapping[str, Column], kinds: Mapping[str, T.DataType]) -> Column:
    """List of objects: lists are zipped element by element, one single value makes one object."""
    arrays = {
        k: c if isinstance(kinds[k], T.ArrayType) else F.when(c.isNotNull(), F.array(c))
        for k, c in values.items()
    }
    names = list(arrays)
    if len(names) == 1:
        return _list_of(arrays[names[0]], names[0])
    zipped = F.arrays_zip(*[F.coalesce(a, F.array()) for a in arrays.values()])
    any_list = F.coalesce(*[F.size(a) for a in arrays.values()]).isNotNull()
    rows = F.transform(zipped, lambda e: F.struct(*[e[str(i)].alias(n) for i, n in enumerate(names)]))
    return F.when(any_list, rows)


def force_list_scalar(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, T.ArrayType) else F.when(c.isNotNull(), F.array(c))


# --- whole entity -----------------------------------------------------------------

def marker_of(spec: Mapping) -> str | None:
    """What a reference is found by instead of a delivered value: the name after ``=`` in its ``bronwaarde``."""
    source = spec["source_mapping"]
    value = source.get(REF) if isinstance(source, Mapping) else None
    return value[1:] if isinstance(value, str) and value.startswith("=") else None


# Parts of a reference that are moments by their name (fixed values).
MOMENTS = ("begin_geldigheid", "eind_geldigheid")


def part_formats(spec: Mapping) -> dict[str, str]:
    """Formats of the parts of an object: named in the attribute's ``format``, or in that of its source mapping."""
    named = [f for f in (spec["source_mapping"].get("format"), spec.get("format")) if isinstance(f, Mapping)]
    return {part: fmt for f in named for part, fmt in f.items() if part != "split" and fmt}


def part_type(name: str, part: str, spec: Mapping, types: Mapping[str, str]) -> str | None:
    """Type that a part of an object is read as: declared under its path, implied by its format, or by its name."""
    declared = types.get(f"{name}.{part}")
    implied = text_type({"format": part_formats(spec).get(part)})
    return declared or implied or ("datetime" if part in MOMENTS and REF in spec["source_mapping"] else None)


def nested_values(df: DataFrame, name: str, spec: Mapping, types: Mapping[str, str]):
    """(path, value, type, format) of the parts of an object attribute whose type is known; ``value`` is text or a list of texts.

    In a path a list is marked ``[]``: ``refs[].begin_geldigheid``.
    """
    source, formats = spec["source_mapping"], part_formats(spec)
    separator = _split_of(source.get("format")) or _split_of(spec.get("format"))
    several = separator is not None or types.get(name) == "manyreference"
    for part, origin in source.items():
        kind = part_type(name, part, spec, types) if part != "format" else None
        if kind is None or origin.startswith("="):
            continue
        chains = spec.get("filters") or {}
        value = source_value(df, origin)
        value = apply_filters(value, chains[part]) if part in chains else value
        found = _kind(df, value)
        if isinstance(found, T.ArrayType) and isinstance(found.elementType, T.StringType):
            yield f"{name}[].{part}", value, kind, formats.get(part)
        elif isinstance(found, T.StringType) and several:
            yield f"{name}[].{part}", split_items(value, separator or ";"), kind, formats.get(part)
        elif isinstance(found, T.StringType):
            yield f"{name}.{part}", value, kind, formats.get(part)


def _read_items(items: Column, fmt: str) -> Column:
    """Items read by their format, as text in the standard form."""
    return F.transform(items, lambda x: convert.convert(x, text_type({"format": fmt}), fmt).cast("string"))


def _split_of(spec: object) -> str | None:
    return spec.get("split") if isinstance(spec, Mapping) else None


def _kind(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("v")).schema["v"].dataType


def _object_attribute(df: DataFrame, source: Mapping, spec: Mapping, type_: str | None) -> Column:
    source, formats = dict(source), part_formats(spec)
    separator = _split_of(source.pop("format", None)) or _split_of(spec.get("format"))
    chains = spec.get("filters") or {}
    listed = spec.get("force_list") or type_ == "manyreference"

    def value(v: str) -> Column:
        dotted = "." in v and not v.startswith("=") and not _has(df, v)
        return path_list(df, v) if listed and dotted else source_value(df, v)

    # A marker is no value: the relation is found later.
    marked = marker_of(spec) is not None
    parts = {
        k: F.lit(None).cast("string") if marked and k == REF else apply_filters(value(v), chains[k]) if k in chains else value(v)
        for k, v in source.items()
    }
    kinds = {k: _kind(df, c) for k, c in parts.items()}
    several = separator is not None or type_ == "manyreference"
    for k, fmt in formats.items():
        # A part with a format becomes what the format says; items of a list are read after they are told apart.
        if isinstance(kinds[k], T.StringType) and not several:
            parts[k] = convert.convert(parts[k], text_type({"format": fmt}), fmt)
            kinds[k] = _kind(df, parts[k])
    if spec.get("force_list"):
        return force_list(parts, kinds)
    if separator is not None or type_ == "manyreference":
        if len(parts) == 1:
            (name, c), = parts.items()
            return _list_of(c if isinstance(kinds[name], T.ArrayType) else split_values(c, separator or ";"), name)
        # Parallel lists are zipped with their empty items; pairs without a reference go then.
        lists = {k: c if isinstance(kinds[k], T.ArrayType) else split_items(c, separator or ";") for k, c in parts.items()}
        for k, fmt in formats.items():
            lists[k] = _read_items(lists[k], fmt)
        return zipped_reference(lists.pop(REF), **lists)
    if any(isinstance(t, T.ArrayType) for t in kinds.values()):
        return force_list(parts, kinds)
    if type_ == "json":
        return json_object(parts)
    if REF in parts:
        value = parts.pop(REF)
        return reference(value, **parts)
    return struct_of(parts)


def text_type(spec: Mapping, type_: str | None = None) -> str | None:
    """Type that text of an attribute is read as: the declared one, else what its format implies."""
    fmt = spec.get("format")
    if type_ is not None or not isinstance(fmt, str):
        return type_
    if fmt in convert.BOOLEAN_FORMATS:
        return "boolean"
    return "datetime" if "%H" in fmt else "date"


def attribute(df: DataFrame, spec: Mapping, type_: str | None = None) -> Column:
    """Column of one attribute from its mapping entry.

    ``type_`` is the declared attribute type; without it a date format makes a
    timestamp (a date when it has no time part), a boolean format a boolean and
    anything else stays as delivered.
    """
    source, fmt = spec["source_mapping"], spec.get("format")
    if isinstance(source, Mapping):
        return _object_attribute(df, source, spec, type_)
    c = apply_filters(source_value(df, source), spec.get("filters") or [])
    if spec.get("force_list"):
        return force_list_scalar(c, _kind(df, c))
    kind = _kind(df, c)
    if type_ is None and isinstance(fmt, str) and fmt in convert.BOOLEAN_FORMATS:
        type_ = "boolean"
    if type_ in ("reference", "manyreference") and not isinstance(kind, (T.StructType, T.ArrayType)):
        return reference(c) if type_ == "reference" else many_reference(c.cast("string"))
    if type_ == "boolean" and isinstance(kind, T.NumericType):
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
    if not isinstance(kind, T.StringType):
        return c if type_ is None else c.try_cast(convert.SPARK_TYPES[type_])
    type_ = text_type(spec, type_)
    return c if type_ is None else convert.convert(c, type_, fmt)


def map_entity(
    df: DataFrame,
    mapping: Mapping[str, Mapping],
    types: Mapping[str, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Map an extract to its entity in one projection; ``keep`` passes columns through."""
    types = types or {}
    out = [attribute(df, spec, types.get(name)).alias(name) for name, spec in mapping.items()]
    return df.select(*out, *keep)


def with_system_columns(
    df: DataFrame, key: str, source: str, application: str, source_id: str | None = None, expiry: str | None = None
) -> DataFrame:
    """Append key, lineage, source row id and expiry columns."""
    return df.select(
        "*",
        F.col(key).cast("string").alias("_id"),
        F.lit(source).alias("_source"),
        F.lit(application).alias("_application"),
        (F.col(source_id).cast("string") if source_id else F.lit(None).cast("string")).alias("_source_id"),
        (F.col(expiry) if expiry else F.lit(None)).cast("timestamp").alias("_expiration_date"),
        (F.col(expiry) if expiry else F.lit(None)).cast("timestamp").alias("datum_actueel_tot"),
    )
