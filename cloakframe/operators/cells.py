"""Flattening nested records into cells and writing cells back.

The schema is walked once on the driver.  The result is one SQL expression per
record, so flattening needs no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ROOT_PATH, FieldPath, cell_text, identifier, quoted

CELLS_TYPE = "array<struct<path:string,name:string,text:string,name_bits:int>>"
NO_CELLS = f"cast(array() as {CELLS_TYPE})"

TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)
_UNSCANNED = (T.BinaryType, T.NullType)

# Turns a leaf (SQL expression, type) into the text to look at; None leaves it out.
LeafText = Callable[[str, T.DataType], "str | None"]
# Facts about a field name as bits: (fixed name, None), (None, SQL of a map key) or (None, None).
NameBits = Callable[["str | None", "str | None"], str]


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEXT_TYPES)


def is_leaf(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.VariantType):
        raise TypeError("a VARIANT has no static fields; give it a schema first (see sources.json) "
                        "or list it with operators.cells.variant_cells")
    return not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def any_text(value: str, dtype: T.DataType) -> str | None:
    """Text of every scalar except binary."""
    return None if isinstance(dtype, _UNSCANNED) else cell_text(value, dtype)


def field_of(value: str, name: str) -> str:
    return f"{value}.{identifier(name)}"


def static_leaves(value: str, dtype: T.DataType, path: FieldPath = FieldPath(), name: str | None = None):
    """Leaves reachable through structs only, in field order: ``(expression, type, path, name)``.

    Arrays and maps are returned whole, as one entry of their own type.
    """
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            yield from static_leaves(field_of(value, f.name), f.dataType, path.key(f.name), f.name)
    else:
        yield value, dtype, path, name


def _no_bits(name: str | None, key: str | None) -> str:
    return "0"


def cells(value: str, dtype: T.DataType, leaf_text: LeafText = any_text, path: FieldPath = FieldPath(),
          name: str | None = None, key: str | None = None, name_bits: NameBits = _no_bits, depth: int = 0) -> str | None:
    """Depth-first cells of a value, as SQL text; null cells included.

    ``name`` (fixed) or ``key`` (data) is the last path part when that is a
    key; list items have neither.  None when nothing below is a candidate.
    """
    x, i, e = f"x{depth}", f"i{depth}", f"e{depth}"
    if isinstance(dtype, T.StructType):
        parts = [cells(field_of(value, f.name), f.dataType, leaf_text, path.key(f.name), f.name, None,
                       name_bits, depth) for f in dtype.fields]
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    if isinstance(dtype, T.ArrayType):
        inner = cells(x, dtype.elementType, leaf_text, path.index(i), None, None, name_bits, depth + 1)
        return inner and f"coalesce(flatten(transform({value}, ({x}, {i}) -> {inner})), {NO_CELLS})"
    if isinstance(dtype, T.MapType):
        k = f"cast({e}.key as string)"
        inner = cells(f"{e}.value", dtype.valueType, leaf_text, path.data_key(k), None, k, name_bits, depth + 1)
        return inner and f"coalesce(flatten(transform(map_entries({value}), {e} -> {inner})), {NO_CELLS})"
    is_leaf(dtype)
    text = leaf_text(value, dtype)
    if text is None:
        return None
    shown = quoted(name) if name is not None else key if key is not None else "cast(null as string)"
    return (f"cast(array(named_struct('path', {path.sql()}, 'name', {shown}, 'text', {text}, "
            f"'name_bits', {name_bits(name, key)})) as {CELLS_TYPE})")


def record_text(dtype: T.DataType, content: str = "content") -> str:
    """A record as text (SQL): one line per top-level value, a missing one spelled ``None``; texts as they are."""
    if not isinstance(dtype, T.StructType):
        return content
    lines = []
    for f in dtype.fields:
        value = field_of(content, f.name)
        text = cell_text(value, f.dataType) if is_leaf(f.dataType) else f"to_json({value})"
        lines.append(f"coalesce({text}, 'None')")
    return f"concat_ws('\\n', {', '.join(lines)})"


def cell_table(records: DataFrame) -> DataFrame:
    """One row per non-null scalar: ``source_id, record_index, field_ordinal, field_path, field_name, value``."""
    found = cells("content", records.schema["content"].dataType) or NO_CELLS
    return (
        records.select("source_id", "record_index", F.posexplode_outer(F.expr(found)).alias("field_ordinal", "cell"))
        .filter(F.col("cell.text").isNotNull())
        .select("source_id", "record_index", "field_ordinal", F.col("cell.path").alias("field_path"),
                F.col("cell.name").alias("field_name"), F.col("cell.text").alias("value"))
    )


def _variant_is(value: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


_OPEN = """
CASE WHEN startswith(schema_of_variant(cell.value), 'OBJECT') THEN
  transform(map_entries(try_variant_get(cell.value, '$', 'map<string,variant>')), (e, i) -> named_struct(
    'path', if(cell.path = '', e.key, concat(cell.path, '.', e.key)), 'name', e.key,
    'value', e.value, 'ordinal', concat(cell.ordinal, array(i))))
WHEN startswith(schema_of_variant(cell.value), 'ARRAY') THEN
  transform(try_variant_get(cell.value, '$', 'array<variant>'), (v, i) -> named_struct(
    'path', concat(cell.path, '[', cast(i as string), ']'), 'name', cast(null as string),
    'value', v, 'ordinal', concat(cell.ordinal, array(i))))
ELSE array(cell) END
"""


def variant_depth(records: DataFrame) -> int:
    """Deepest nesting of objects and lists in a VARIANT ``content``, measured on the executors.

    Brackets of the printed value are followed, outside its texts; the schema
    of a list of mixed kinds would hide what lies below.
    """
    plain = F.regexp_replace(F.to_json("content"), r"\\\\.", "")
    marks = F.filter(F.split(F.regexp_replace(plain, r'"[^"]*+"|[^\[\]{}]', ""), ""), lambda c: c != "")
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda acc, c: F.struct(
        (acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"),
        F.greatest(acc["most"], acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")))["most"]
    return records.agg(F.max(depth)).first()[0] or 0


def variant_cells(records: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``cell_table`` for a ``content`` of type VARIANT, whose keys are data.

    Every level opens objects and lists one step and passes scalars on; all
    levels are narrow.  Without ``max_depth`` the depth is measured first, so
    containers are opened until none is left, whatever their shape.  Content
    nested deeper than a given ``max_depth`` raises, so no cell is lost
    silently.
    """
    max_depth = variant_depth(records) if max_depth is None else max_depth
    frame = records.select("source_id", "record_index", F.expr(
        "named_struct('path', '', 'name', cast(null as string), 'value', content, "
        "'ordinal', cast(array() as array<int>))").alias("cell"))
    for _ in range(max_depth):
        frame = frame.select("source_id", "record_index", F.explode_outer(F.expr(_OPEN)).alias("cell"))
    value = F.col("cell.value")
    text = F.try_variant_get(value, "$", "string")
    too_deep = F.raise_error(F.lit(f"content is nested deeper than {max_depth} levels")).cast("string")
    return frame.select(
        "source_id", "record_index", F.col("cell.ordinal").alias("field_ordinal"),
        F.when(F.col("cell.path") == "", ROOT_PATH).otherwise(F.col("cell.path")).alias("field_path"),
        F.col("cell.name").alias("field_name"),
        F.when(_variant_is(value, "OBJECT") | _variant_is(value, "ARRAY"), too_deep)
        .when(_variant_is(value, "BOOLEAN"), F.initcap(text)).otherwise(text).alias("value"),
    ).filter(F.col("value").isNotNull())


# Gives a leaf its new value: (expression, type, path, ordinal of its static leaf) -> expression, or None to leave it.
LeafRewrite = Callable[[str, T.DataType, FieldPath, int], "str | None"]


def rewrite(value: str, dtype: T.DataType, change: LeafRewrite, path: FieldPath = FieldPath(), depth: int = 0,
            ordinal: int | None = None, ordinals: Iterator[int] | None = None) -> str:
    """SQL text that rebuilds a nested value with changed leaves, keeping nulls and field order.

    ``ordinals`` counts the leaves in the order of ``static_leaves``; what lies
    inside a list or map has the ordinal of the whole.
    """
    ordinals = ordinals or count()
    if ordinal is None and not isinstance(dtype, T.StructType):
        ordinal = next(ordinals)
    x, i, k = f"x{depth}", f"i{depth}", f"k{depth}"
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return value
        fields = [f"{quoted(f.name)}, " + rewrite(field_of(value, f.name), f.dataType, change, path.key(f.name), depth, ordinal, ordinals)
                  for f in dtype.fields]
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({', '.join(fields)}) END"
    if isinstance(dtype, T.ArrayType):
        inner = rewrite(x, dtype.elementType, change, path.index(i), depth + 1, ordinal)
        return f"transform({value}, ({x}, {i}) -> {inner})"
    if isinstance(dtype, T.MapType):
        inner = rewrite(x, dtype.valueType, change, path.data_key(f"cast({k} as string)"), depth + 1, ordinal)
        return f"transform_values({value}, ({k}, {x}) -> {inner})"
    is_leaf(dtype)
    changed = change(value, dtype, path, ordinal)
    return value if changed is None else changed
