"""Canonical JSON as a column expression: keys sorted at every level, numbers rounded, so that equal values are equal texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiersight.functions.numbers import half_up


def _number(x: Column, decimals: int) -> Column:
    """A rounded number without zeros at its end; null for what JSON has no number for."""
    written = half_up(x, decimals).cast(f"decimal(38,{max(decimals, 1)})").cast("string")
    return F.when(F.abs(x) < 1e15, F.regexp_replace(written, r"\.?0+$", "")).when(F.isnan(x) | (F.abs(x) == float("inf")), "null").otherwise(x.cast("string"))


def _text(s: Column) -> Column:
    """A string in quotes, escaped."""
    row = F.to_json(F.array(s))
    return F.substring(row, F.lit(2), F.length(row) - 2)


def canonical_json(value: Column, kind: T.DataType, decimals: int = 1, finer: Mapping[str, int] | None = None, key: str = "") -> Column:
    """The canonical JSON of a value of a type.

    Numbers are rounded to `decimals`, those under a key of `finer` to its number of decimals. Fields
    of structs that are null are left out, as absent ones are; other nulls are written.
    """
    finer = finer or {}

    def of(x: Column, t: T.DataType, k: str = "") -> Column:
        if isinstance(t, T.StructType):
            fields = sorted(t.fields, key=lambda f: f.name)
            pairs = [F.when(x[f.name].isNotNull(), F.concat(_text(F.lit(f.name)), F.lit(":"), of(x[f.name], f.dataType, f.name))) for f in fields]
            out = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
        elif isinstance(t, T.ArrayType):
            out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: of(e, t.elementType)), ","), F.lit("]"))
        elif isinstance(t, T.MapType):
            entries = F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_text(e["key"].cast("string")), F.lit(":"), of(e["value"], t.valueType))), ","), F.lit("}"))
        elif isinstance(t, T.BooleanType):
            out = x.cast("string")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out = x.cast("string")
        elif isinstance(t, T.NumericType):
            out = _number(x.cast("double"), finer.get(k, decimals))
        else:
            out = _text(x.cast("string"))
        return F.coalesce(out, F.lit("null"))

    return of(value, kind, key)
