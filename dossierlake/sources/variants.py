"""JSON as VARIANT: parsed once on the JVM, flattened level by level, without Python.

A text that isn't JSON gives no lines; of equal keys in one object Spark's parser takes none, so such a text isn't JSON
here. Numbers have six significant digits; nulls and empty containers give no line of a value. Levels are as many as
the deepest text has; each is one job over the rows that are still containers, so work follows the nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.workspace import materialize


def general_number(value: Column) -> Column:
    """A double in six significant digits, in the shorter of plain and scientific form, without zeros at its end.

    Rounded from the double's shortest form, halves to even; so one whose seventh and last digit is a 5, but whose exact
    value lies just beside that half (99999.95), can differ in its last digit from what a C stream prints.
    """
    long_form = F.format_string("%.16e", F.abs(value))
    raw = F.replace(F.substring_index(long_form, "e", 1), F.lit("."), F.lit(""))
    head, rest = F.substring(raw, 1, 6).cast("long"), F.substring(raw, 7, 11).cast("long")
    half = 5 * 10**10
    rounded = head + ((rest > half) | ((rest == half) & (head % 2 == 1))).cast("long")
    digits = F.substring(rounded.cast("string"), 1, 6)
    power = F.substring_index(long_form, "e", -1).cast("int") + (rounded == 1_000_000).cast("int")
    cut = lambda s: F.regexp_replace(s, r"\.?0*$", "")
    scientific = F.concat(cut(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.lit("e"), F.format_string("%+03d", power))
    whole = cut(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6))))
    small = cut(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    text = F.when((power < -4) | (power >= 6), scientific).when(power >= 0, whole).otherwise(small)
    return F.when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), text))


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, or a scalar's type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def scalar_text(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind_of(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), general_number(number)).otherwise(text)


def leaves(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """``key``, order, part, line: of each text a line ``key: path`` for each field and ``path: value`` for each scalar.

    ``order`` and ``part`` put a text's lines in order: fields by name, array items by place, a field before its value.
    """
    start = rows.select(F.col(key).alias("owner"), F.try_parse_json(text).alias("v")).where("v is not null")
    level = start.select("owner", "v", F.lit("").alias("at"), F.array().cast("array<string>").alias("order"))
    found: list[DataFrame] = []
    while True:
        level = materialize(level.withColumn("kind", kind_of(F.col("v"))), "variants")
        line = F.concat("at", F.lit(": "), scalar_text(F.col("v")))
        scalars = level.where(~F.col("kind").isin("OBJECT", "ARRAY", "VOID"))
        found.append(scalars.select("owner", "order", F.lit(1).alias("part"), line.alias("line")))
        inner = level.where(F.col("kind").isin("OBJECT", "ARRAY")).withColumnRenamed("v", "outer_value").drop("kind")
        if inner.isEmpty():
            break
        each = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("outer_value").outer()))
        named = F.when(F.col("at") == "", F.col("key")).otherwise(F.concat("at", F.lit("."), F.col("key")))
        below = F.when(F.col("key").isNull(), F.concat("at", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(named)
        step = F.coalesce("key", F.lpad(F.col("pos").cast("string"), 10, "0"))
        level = each.select("owner", F.col("value").alias("v"), below.alias("at"), F.concat("order", F.array(step)).alias("order"), F.col("key").isNotNull().alias("is_field"))
        level = materialize(level, "variant-level")
        found.append(level.where("is_field").select("owner", "order", F.lit(0).alias("part"), F.concat(F.lit("key: "), F.col("at")).alias("line")))
        level = level.drop("is_field")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("owner", key)


def flattened(rows: DataFrame, key: str, text: Column, name: str = "text") -> DataFrame:
    """``key`` and all lines of its JSON as one text; no longer than a few times the JSON itself."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("order", "part", "line"))), lambda x: F.concat(x.line, F.lit("\n")))
    return leaves(rows, key, text).groupBy(key).agg(F.array_join(listed, "").alias(name))
