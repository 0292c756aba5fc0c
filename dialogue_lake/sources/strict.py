"""Strict reading of JSON texts: every departure from a shape is a row with its path.

A text is parsed once to a VARIANT and walked level by level, each level one lateral
explode, so a long array is many rows and not one nested fold. A shape maps path patterns,
``$.words[].start``, to what may stand there. Rules found: ``invalid_json``,
``repeated_field``, ``missing_field``, ``unknown_field``, ``wrong_type``, ``not_finite``,
``too_many_items``, ``not_allowed``, ``blank_text``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogue_lake.session import checkpointed


@dataclass(frozen=True)
class Place:
    """What may stand at a path: JSON types, and limits for arrays and strings."""

    types: tuple[str, ...]
    required: bool = True
    most: int | None = None
    values: tuple[str, ...] = ()
    filled: bool = False


@dataclass
class Shape:
    places: dict[str, Place] = field(default_factory=dict)

    def add(self, path: str, *types: str, **limits) -> Shape:
        self.places[path] = Place(types, **limits)
        return self

    def children(self) -> dict[str, list[str]]:
        """Required fields of each object pattern."""
        out: dict[str, list[str]] = {}
        for path, place in self.places.items():
            parent, _, name = path.rpartition(".")
            if parent and not name.endswith("[]") and place.required:
                out.setdefault(parent, []).append(name)
        return out

    def depth(self) -> int:
        return max(path.count(".") + path.count("[]") for path in self.places)


KINDS = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number", T.DecimalType: "number",
         T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer"}


def shape_of(schema: T.DataType, optional: tuple[str, ...] = (), path: str = "$", shape: Shape | None = None) -> Shape:
    """The shape of a Spark type; nullable fields may be null but not missing, unless ``optional`` names them."""
    shape = shape or Shape().add("$", "object")
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            inner = f"{path}.{f.name}"
            kind = "object" if isinstance(f.dataType, T.StructType) else "array" if isinstance(f.dataType, T.ArrayType) else KINDS.get(type(f.dataType), "string")
            shape.add(inner, kind, *(["null"] if f.nullable else []), required=inner not in optional)
            shape_of(f.dataType, optional, inner, shape)
    elif isinstance(schema, T.ArrayType):
        inner = f"{path}[]"
        element = schema.elementType
        kind = "object" if isinstance(element, T.StructType) else "array" if isinstance(element, T.ArrayType) else KINDS.get(type(element), "string")
        shape.add(inner, kind)
        shape_of(element, optional, inner, shape)
    return shape


def kind_of(value: Column) -> Column:
    """The JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
        .when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").otherwise("number"))


def nodes(df: DataFrame, keys: list[str], payload: str, depth: int) -> DataFrame:
    """(*keys, path, pattern, value, kind): every value down to ``depth``.

    The text is wrapped in an array first, so that anything after the document is seen.
    """
    parsed = df.select(*keys, F.col(payload).alias("_text"), F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))).alias("_v"))
    one = F.coalesce(F.json_array_length(F.to_json("_v")) == 1, F.lit(False))
    root = F.when(one, F.expr("variant_get(_v, '$[0]', 'variant')"))
    level = parsed.select(*keys, F.lit("$").alias("path"), F.lit("$").alias("pattern"), root.alias("value"), "_text")
    level = level.withColumn("kind", F.when(F.col("value").isNotNull(), kind_of(F.col("value"))))
    # A level is read by the rules and by the next level: each is computed once.
    levels = [checkpointed(level)]
    for _ in range(depth):
        below = levels[-1].filter(F.col("kind").isin("object", "array")).select(*keys, "path", "pattern", F.col("value").alias("_parent"))
        below = below.lateralJoin(below.sparkSession.tvf.variant_explode(F.col("_parent").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key"))
        levels.append(checkpointed(below.select(
            *keys, F.concat("path", F.coalesce(step, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"),
            F.concat("pattern", F.coalesce(step, F.lit("[]"))).alias("pattern"), "value", F.lit(None).cast("string").alias("_text"),
            kind_of(F.col("value")).alias("kind"))))
    return reduce(DataFrame.unionByName, levels)


def violations(df: DataFrame, keys: list[str], payload: str, shape: Shape) -> DataFrame:
    """(*keys, path, rule) of everything in ``payload`` that departs from ``shape``."""
    rows = nodes(df, keys, payload, shape.depth() + 1)

    def looked_up(values: dict, kind: str) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
        return F.try_element_at(F.create_map(*pairs), F.col("pattern")) if pairs else F.lit(None).cast(kind)

    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    places = shape.places
    types = looked_up({p: strings(x.types) for p, x in places.items()}, "array<string>")
    most = looked_up({p: F.lit(x.most) for p, x in places.items() if x.most is not None}, "int")
    allowed = looked_up({p: strings(x.values) for p, x in places.items() if x.values}, "array<string>")
    filled = F.col("pattern").isin([p for p, x in places.items() if x.filled]) if any(x.filled for x in places.values()) else F.lit(False)
    required = looked_up({p: strings(x) for p, x in shape.children().items()}, "array<string>")
    kind, text = F.col("kind"), F.expr("try_variant_get(value, '$', 'string')")
    number = F.expr("try_variant_get(value, '$', 'double')")
    broken = F.col("pattern") == "$"
    repeated = F.get_json_object("_text", "$").isNotNull() & F.json_array_length(F.concat(F.lit("["), "_text", F.lit("]"))).eqNullSafe(1)
    fits = F.array_contains("_types", kind) | (F.array_contains("_types", F.lit("number")) & (kind == "integer"))
    known = rows.withColumn("_types", types)
    rules = F.array_compact(F.array(
        F.when(broken & kind.isNull(), F.when(repeated, "repeated_field").otherwise("invalid_json")),
        F.when(F.col("_types").isNull(), "unknown_field"), F.when(kind.isNotNull() & ~fits, "wrong_type"),
        F.when(fits & (kind == "number") & (F.isnan(number) | (F.abs(number) == float("inf"))), "not_finite"),
        F.when(fits & (kind == "array") & (F.json_array_length(F.to_json("value")) > most), "too_many_items"),
        F.when(fits & (kind == "string") & ~F.array_contains(allowed, text), "not_allowed"),
        F.when(fits & (kind == "string") & filled & (F.trim(text) == ""), "blank_text")))
    found = known.select(*keys, "path", "pattern", F.explode(rules).alias("rule"))
    # An unknown field is one row, however much is inside: it stands in a known object.
    parent = F.regexp_extract("pattern", r"^(.*)\.[^.\[\]]*$", 1)
    objects = [p for p, x in places.items() if "object" in x.types]
    found = found.filter((F.col("rule") != "unknown_field") | parent.isin(objects)).select(*keys, "path", "rule")
    absent = F.explode(F.array_except(required, F.json_object_keys(F.to_json("value"))))
    missing = known.filter(kind == "object").select(*keys, "path", absent.alias("_name")).select(
        *keys, F.concat_ws(".", "path", "_name").alias("path"), F.lit("missing_field").alias("rule"))
    return found.unionByName(missing)


def accepted(df: DataFrame, keys: list[str], payload: str, shape: Shape) -> DataFrame:
    """The rows of ``df`` whose text is exactly of the shape; ``keys`` name a row."""
    bad = violations(df, keys, payload, shape).select(*keys).distinct()
    return df.join(bad, keys, "left_anti")
