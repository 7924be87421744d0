"""Record shaping: decode, flatten, filter, enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType


def _read(item: StructField, text: Column | None = None) -> Column:
    """A field of the decoded object, or the given text of it, in its type; NULL where it does not fit."""
    if text is None:
        text = F.try_element_at("_parsed", F.lit(item.name))
    if isinstance(item.dataType, (StructType, ArrayType, MapType)):
        return F.from_json(text, item.dataType)
    return text.try_cast(item.dataType)


def merge_json(df: DataFrame, column: str, schema: StructType, keep: bool = False, rest: str = "_rest") -> DataFrame:
    """Decode a JSON string column and put its fields at the root.

    Text that is not a JSON object is kept as ``message``. Fields win over root columns of
    the same name when they are present. Each field is read on its own: one that does not
    have its type is NULL and stays, like the keys outside of the schema, in the column
    ``rest``, a JSON object (NULL if nothing is left over).
    """
    parsed = df.withColumn("_parsed", F.from_json(F.col(column), "map<string,string>"))
    is_object = F.col("_parsed").isNotNull()
    columns = {}
    for item in schema.fields:
        value = _read(item)
        columns[item.name] = F.coalesce(value, F.col(item.name)) if item.name in df.columns else value
    raw = F.when(is_object, F.lit(None)).otherwise(F.col(column))
    columns["message"] = F.coalesce(columns["message"], raw) if "message" in columns else raw
    # keys that no field took: each key is held against its own field only
    def untaken(key: Column, text: Column) -> Column:
        test = F
        for item in schema.fields:
            test = test.when(key == F.lit(item.name), _read(item, text).isNull())
        return test.otherwise(F.lit(True)) if schema.fields else F.lit(True)

    left = F.map_filter("_parsed", untaken)
    columns[rest] = F.when(F.size(left) > 0, F.to_json(left))
    out = [c for c in df.columns if c not in columns and (keep or c != column)]
    return parsed.select(*out, *[value.alias(name) for name, value in columns.items()])


def lift(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Replace a struct column by its fields, each with a prefix. Absent columns change nothing."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, StructType):
        return df
    fields = df.schema[column].dataType.fieldNames()
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[name].alias(prefix + name) for name in fields])


def skip_long_lines(df: DataFrame, limit: int, column: str = "value") -> DataFrame:
    """Drop lines of more than ``limit`` bytes."""
    return df.where(F.octet_length(column) <= limit)


def route(df: DataFrame, pattern: str, tag: str = "tag") -> DataFrame:
    """Keep records whose tag matches a pattern in which ``*`` stands for anything."""
    like = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")
    return df.where(F.col(tag).like(like))


def path_tag(path: Column, head: str = "kube") -> Column:
    """Tag of a file: the head, then its path with dots for slashes."""
    return F.concat(F.lit(head + "."), F.translate(F.regexp_replace(path, "^[a-z]+:/+|^/+", ""), "/", "."))


def enrich(df: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a dimension table.

    No hint: the dimension is broadcast when its size is below the session's limit. Beyond
    that it is a sort-merge join whose hot keys adaptive execution splits. Of several rows with
    one key the first by its other columns counts, so records are never multiplied.
    """
    others = [c for c in dimension.columns if c not in on]
    if not others:
        return df.join(dimension.distinct(), on, "left")
    single = dimension.groupBy(*on).agg(F.min(F.struct(*others)).alias("_row")).select(*on, "_row.*")
    return df.join(single, on, "left")
