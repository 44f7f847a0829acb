"""Canonical JSON of nested columns: keys sorted at every depth, no blanks, and only strings, whole numbers, booleans,
nulls, arrays, structs and maps of them."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SHORT = {"\b": r"\b", "\t": r"\t", "\n": r"\n", "\f": r"\f", "\r": r"\r"}


def json_string(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    control = escaped
    for n in range(32):
        control = F.replace(control, F.lit(chr(n)), F.lit(_SHORT.get(chr(n), f"\\u{n:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), control).otherwise(escaped), F.lit('"'))


def canonical_value(value: Column, kind: T.DataType, path: str = "$") -> Column:
    """Canonical JSON text of a column of a type, null as `null`. An unsupported type or a key beyond ASCII is a TypeError that tells its path."""
    if isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, (*_WHOLE, T.BooleanType)) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        text = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_value(x, kind.elementType, f"{path}[]")), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        if any(not n.isascii() for n in kind.names):
            raise TypeError(f"non-ASCII key at {path}")
        parts = [F.concat(F.lit(f"{'{,'[i > 0]}" + json.dumps(f.name) + ":"), canonical_value(value.getField(f.name), f.dataType, f"{path}.{f.name}")) for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        text = F.when(value.isNotNull(), F.concat(*parts, F.lit("}")) if parts else F.lit("{}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        stop = F.raise_error(F.concat(F.lit(f"non-ASCII key at {path}: "), F.array_join(F.map_keys(value), ","))).cast("string")
        entry = lambda e: F.concat(json_string(e["key"]), F.lit(":"), canonical_value(e["value"], kind.valueType, f"{path}.*"))
        entries = F.array_join(F.transform(F.array_sort(F.map_keys(value)), lambda k: entry(F.struct(k.alias("key"), F.element_at(value, k).alias("value")))), ",")
        text = F.when(F.exists(F.map_keys(value), lambda k: k.rlike(r"[^\x00-\x7F]")), stop).otherwise(F.concat(F.lit("{"), entries, F.lit("}")))
    else:
        raise TypeError(f"unsupported canonical value {kind.simpleString()} at {path}")
    return F.coalesce(text, F.lit("null"))
