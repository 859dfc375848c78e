"""Text of nested JSON values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?'


def nesting(text: Column) -> Column:
    """How deep the brackets of a JSON text go."""
    brackets = F.regexp_extract_all(F.regexp_replace(text, STRING, ""), F.lit(r"[\[\]{}]"), 0)
    deeper = lambda acc, b: F.when(b.isin("{", "["), F.struct(
        (acc["now"] + 1).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))).otherwise(
        F.struct((acc["now"] - 1).alias("now"), acc["most"].alias("most")))
    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper, lambda acc: acc["most"])


def _own_text(value: Column) -> Column:
    """Text of a value that is not taken apart: scalars, and objects with a text or content of their own; null for the rest."""
    kind = F.schema_of_variant(value)
    field = lambda name: F.when(
        F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))
    is_object, is_array = F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY"))
    flag = F.try_variant_get(value, "$", "boolean")
    return (F.when(kind == "VOID", "").when(kind == "BOOLEAN", F.when(flag, "True").otherwise("False"))
            .when(is_object, F.coalesce(field("text"), field("content"))).when(~is_array, F.try_variant_get(value, "$", "string")))


def nested_text(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, text): the text of JSON values of any depth, one line per part.

    ``keys`` identify a row. A string is its own text, numbers and flags are
    written out, null is empty; an object gives its ``text``, else its
    ``content``, if that is a string, else the texts of all its values (in
    the order of their names); an array those of its items. What is no JSON
    is text as it stands, null is empty.

    The depth of the deepest value is asked once; so many times containers
    are exploded, on the JVM, each part keeping its path for the final order.
    """
    depth = df.agg(F.max(nesting(F.col(column)))).first()[0] or 0
    parsed = F.try_parse_json(column)
    rows = df.select(*keys, parsed.alias("_v"), F.array().cast("array<int>").alias("_path"),
                     F.when(parsed.isNull(), F.coalesce(column, F.lit(""))).otherwise(_own_text(parsed)).alias("_t"))
    names = ", ".join(f"`{k}`" for k in keys)
    for _ in range(depth):
        # parts that have their text give the outer explode nothing and pass as they are
        step = df.sparkSession.sql(
            f"SELECT {names}, _t, _path, e.pos AS _pos, e.value AS _value "
            "FROM {rows}, LATERAL variant_explode_outer(CASE WHEN _t IS NULL THEN _v END) e", rows=rows)
        rows = step.select(
            *keys, F.col("_value").alias("_v"), F.concat("_path", F.array(F.coalesce("_pos", F.lit(0)))).alias("_path"),
            # an empty container is an empty text
            F.when(F.col("_t").isNotNull(), F.col("_t")).when(F.col("_pos").isNull(), "").when(F.col("_value").isNull(), "").otherwise(
                _own_text(F.col("_value"))).alias("_t"))
    parts = F.array_sort(F.collect_list(F.struct("_path", F.coalesce("_t", F.lit("")).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))
