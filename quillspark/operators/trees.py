"""JSON of any depth as tables: every node by its path, search by key, and comparison of trees.

Trees are VARIANT values.  They are opened level by level, all documents at once, until no container is left: as many rounds as
the deepest tree has levels, and no round looks again at what is done.  A path is a JSON pointer (``/a/0/b``); ``~`` and ``/`` in
keys are ``~0`` and ``~1``.

Edge cases: a null or unreadable text has no nodes; an empty object or array is a node without children; a JSON null is a node of
kind ``null``; of keys that an object repeats the reader of JSON decides (here: the text is unreadable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


#: Kinds by the first word of a VARIANT's type; all others are numbers.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _kind(v: Column) -> Column:
    # By a table, so that the type, which looks at all that is below, is worked out once.
    known = F.create_map(*(F.lit(x) for kind in KINDS.items() for x in kind))
    return F.coalesce(known[F.substring_index(F.schema_of_variant(v), "<", 1)], F.lit("number"))


def nodes(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """``keys, path, parent, name, kind, value`` of every node; ``name`` is its key or position, ``value`` its JSON text where it holds no others."""
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.col(tree).alias("v")).where("v is not null")
    inner = F.col("kind").isin("object", "array")
    found: DataFrame | None = None
    while True:
        # A leaf is written as its text, only what holds others as a tree.
        typed = level.withColumn("kind", _kind(F.col("v")))
        level = materialize(typed.select(*keys, "path", "parent", "name", "kind", F.when(~inner, F.to_json("v")).alias("value"), F.when(inner, F.col("v")).alias("v")), "tree-level")
        done = level.drop("v")
        found = done if found is None else found.unionByName(done)
        open_ = level.where(inner)
        if open_.isEmpty():
            return found
        below = open_.select(*keys, F.col("path").alias("parent"), "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce("key", F.col("pos").cast("string"))
        pointer = F.concat("parent", F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        level = below.select(*keys, pointer.alias("path"), "parent", name.alias("name"), F.col("value").alias("v"))


def collect_key(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys, path, kind, value`` of the members of every array that stands under ``name``, wherever, in the order of their paths."""
    arrays = found.where((F.col("kind") == "array") & (F.col("name") == name)).select(*keys, F.col("path").alias("parent"))
    inside = found.join(arrays.hint("merge"), [*keys, "parent"], "left_semi")
    return inside.select(*keys, "parent", F.col("name").cast("int").alias("position"), "kind", "value")


def holders(found: DataFrame, keys: list[str], name: str, kind: str = "array") -> DataFrame:
    """Paths of the objects that have a member ``name`` of that kind (``keys, path``)."""
    objects = found.where("kind = 'object'").select(*keys, "path")
    members = found.where((F.col("name") == name) & (F.col("kind") == kind)).select(*keys, F.col("parent").alias("path"))
    return objects.join(members.hint("merge"), [*keys, "path"], "left_semi")


def subset_faults(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, fault``: where an expected tree (nodes) is not a part of the actual one.

    Objects may hold more than is expected; arrays agree in length and by position; all else agrees in kind and value, numbers
    by value.  Of a missing or different node its descendants are not told again.
    """
    keyed = lambda df, s: df.select(*keys, "path", F.col("parent").alias(f"parent_{s}"), F.col("kind").alias(f"kind_{s}"), F.col("value").alias(f"value_{s}"))
    # Nodes repeat their keys and paths, so their files are a fraction of the rows: joins are by sorting, never a broadcast.
    sorted_ = lambda df: df.hint("merge")
    both = keyed(expected, "e").join(sorted_(keyed(actual, "a")), [*keys, "path"], "left")
    number = lambda s: F.col(f"value_{s}").try_cast("double")
    same = F.when(F.col("kind_e") == "number", number("e") == number("a")).otherwise(F.col("value_e").eqNullSafe(F.col("value_a")))
    fault = F.when(F.col("kind_a").isNull(), "MISSING").when(F.col("kind_e") != F.col("kind_a"), "KIND").when(~F.coalesce(same, F.lit(False)), "VALUE")
    told = both.withColumn("fault", fault).where("fault is not null").select(*keys, "path", F.col("parent_e").alias("parent"), "fault")
    # What an array has beyond the expected one.
    arrays = expected.where("kind = 'array'").select(*keys, F.col("path").alias("parent"))
    more = actual.join(sorted_(arrays), [*keys, "parent"], "left_semi").join(sorted_(expected.select(*keys, "path")), [*keys, "path"], "left_anti").select(*keys, "path", "parent", F.lit("EXTRA").alias("fault"))
    every = told.unionByName(more)
    # A parent that is missing, or of another kind, stands for what is below it.
    roots = every.where("fault in ('MISSING', 'KIND')").select(*keys, F.col("path").alias("parent"))
    return every.join(sorted_(roots), [*keys, "parent"], "left_anti").select(*keys, "path", "fault")
