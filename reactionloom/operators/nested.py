"""Deeply nested semi-structured records turned into related flat tables.

A record is a VARIANT. Each collection of objects inside it (an array of objects, or an object that maps keys to objects)
becomes a child table: one row per member with the record's id, the surrogate key of the parent row, its ordinal in the
collection, its key and its value. Children of a child follow the same way, level by level, until no level has a collection.
For each level the merged schema of its members' plain fields is inferred from all rows with ``schema_of_variant_agg``;
array fields of objects found there become child tables by themselves, collections stored as objects by key have to be
declared because nothing in the data tells such an object from a plain one.

Texts are parsed once and each level is written once, from the level above it. All work is parsing, exploding and grouping
in Spark; the driver only sees the merged schemas.

Defined results:

* a null document gives no rows, a text that is no JSON gives one row in ``broken``; a JSON string is decoded once more;
* a document of any other shape, an absent, null or empty collection, and members that are null give no rows;
* a member of an array whose key is missing has key null; a member that is a plain value keeps it as its value;
* repeated members stay separate rows (ordinals differ), also when their keys are equal; the ordinal of a member of an
  object by key is its rank among the sorted keys;
* of fields with one name in one object the last counts;
* a level with more than ``MAX_FIELDS`` field names has no typed columns: its rows keep their objects whole in ``f__rest``,
  and its arrays of objects together are one child table, named ``*``, with the field's name in ``collection``;
* other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactionloom.storage import written

#: Typed columns that one level may have. More field names mean that they are keys of a collection that was not declared.
MAX_FIELDS = 2_000
#: The parser refuses an object that has a name twice unless this is set; then the last one counts.
REPEATED_NAMES = "spark.sql.variant.allowDuplicateKeys"


@dataclass(frozen=True)
class Collection:
    """A collection in its parent object: the field's name, the member field holding the key, and what is nested in it."""

    name: str
    key: str
    children: tuple[Collection, ...] = field(default=())


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


#: Follows the text inside a list, so that the parser, which ignores what comes after a value, is made to read all of it.
END = "end of text 5f0c1e64"


def _whole(text: Column) -> Column:
    """The text as one VARIANT, null unless all of it is one JSON value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{END}"]')))
    complete = F.try_variant_get(listed, "$[1]", "string") == END
    return F.when(complete, F.try_variant_get(listed, "$[0]", "variant"))


def parsed(texts: DataFrame, record_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents, broken): `documents` has (record, doc) with doc a VARIANT object or array, `broken` the records' ids.

    A text may be encoded once more as a JSON string; it is broken if either layer is. Both are read from one table that is
    written here, so that each text is parsed once and the setting on repeated names holds while it is.
    """
    conf = texts.sparkSession.conf
    before = conf.get(REPEATED_NAMES)
    conf.set(REPEATED_NAMES, "true")
    try:
        first = texts.where(F.col(text).isNotNull()).select(F.col(record_id).alias("record"), _whole(F.col(text)).alias("v"))
        inner = _whole(F.try_variant_get("v", "$", "string"))
        doc = F.when(F.schema_of_variant("v") == "STRING", inner).otherwise(F.col("v"))
        table = written(first.select("record", doc.alias("doc")), "documents")
    finally:
        conf.set(REPEATED_NAMES, before)
    return table.where(F.col("doc").isNotNull()), table.where(F.col("doc").isNull()).select("record")


#: The columns of every level.
_LINKS = ["record", "parent_path", "parent_key", "path", "ordinal", "key"]


def _exploded(held: DataFrame, name: Column, key: str) -> DataFrame:
    """Members of `held` (record, parent_path, parent_key, held and perhaps more): one row each, `name` being the collection's."""
    # What is needed of the collection as a whole is taken before it is exploded: no member carries a copy of it.
    held = held.withColumn("shape", F.substring(F.schema_of_variant("held"), 1, 5)).where(F.col("shape").isin("ARRAY", "OBJEC"))
    each = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("held").outer()).alias("m"))
    own_key = F.try_variant_get("m.value", _path(key), "string")
    return each.where(F.schema_of_variant("m.value") != "VOID").select(
        "record",
        "parent_path",
        "parent_key",
        F.concat_ws("/", "parent_path", name, F.col("m.pos").cast("string")).alias("path"),
        F.col("m.pos").alias("ordinal"),
        F.when(F.col("shape") == "ARRAY", own_key).otherwise(F.col("m.key")).alias("key"),
        name.alias("collection"),
        F.col("m.value").alias("value"),
    )


def members(parents: DataFrame, collection: Collection) -> DataFrame:
    """The members of one collection of `parents` (record, path, key, value): (record, parent_path, parent_key, path, ordinal, key, collection, value)."""
    held = parents.select("record", F.col("path").alias("parent_path"), F.col("key").alias("parent_key"), F.try_variant_get("value", _path(collection.name), "variant").alias("held"))
    return _exploded(held, F.lit(collection.name), collection.key)


def members_of_any(parents: DataFrame, skip: set[str], key: str) -> DataFrame:
    """The members of all arrays of objects that `parents` hold in fields of whatever name but `skip`."""
    objects = parents.where(F.schema_of_variant("value").startswith("OBJECT")).select("record", F.col("path").alias("parent_path"), F.col("key").alias("parent_key"), "value")
    fields = objects.lateralJoin(parents.sparkSession.tvf.variant_explode(F.col("value").outer()).alias("f"))
    fields = fields.where(F.schema_of_variant("f.value").startswith("ARRAY<OBJECT"))
    if skip:
        fields = fields.where(~F.col("f.key").isin(*skip))
    return _exploded(fields.select("record", "parent_path", "parent_key", F.col("f.key").alias("name"), F.col("f.value").alias("held")), F.col("name"), key)


def merged_fields(level: DataFrame, skip: set[str] = frozenset(), most: int = MAX_FIELDS) -> dict[str, str] | None:
    """Field name -> merged variant type over all members of a level, without the fields in `skip`; None if there are more than `most`."""
    spark = level.sparkSession
    objects = level.where(F.schema_of_variant("value").startswith("OBJECT"))
    fields = objects.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).alias("f"))
    found = (
        fields.where(~F.col("f.key").isin(*skip) if skip else F.lit(True))
        .groupBy(F.col("f.key").alias("name"))
        .agg(F.schema_of_variant_agg("f.value").alias("kind"))
        .limit(most + 1)
        .collect()
    )
    if len(found) > most:
        return None
    return {r["name"]: r["kind"] for r in sorted(found, key=lambda r: r["name"])}


def sql_type(kind: str) -> str:
    """The column type for a merged variant type: decimals become doubles, nested objects structs, nulls strings."""
    import re

    kind = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", kind).replace("OBJECT<", "STRUCT<").replace("FLOAT", "DOUBLE")
    return re.sub(r"\bVOID\b", "STRING", kind)


def typed(level: DataFrame, fields: dict[str, str] | None) -> DataFrame:
    """The level with one typed column ``f_<name>`` for each merged field, in place of the variant.

    A member that is a plain value rather than an object has it, as text, in ``f__value``. Without merged fields (None)
    the whole member stays in ``f__rest``.
    """
    columns: list[Column] = [F.try_variant_get("value", _path(n), sql_type(k)).alias(f"f_{n}") for n, k in (fields or {}).items()]
    plain = F.when(~F.schema_of_variant("value").rlike("^(ARRAY|OBJECT)"), F.try_variant_get("value", "$", "string"))
    rest = [F.col("value").alias("f__rest")] if fields is None else []
    return level.select(*[c for c in (*_LINKS, "collection") if c in level.columns], plain.alias("f__value"), *columns, *rest)


@dataclass
class Flattened:
    """What `flatten` gives: levels by dotted name, the merged fields of each, and ids of records that are no JSON."""

    levels: dict[str, DataFrame]
    fields: dict[str, dict[str, str] | None]
    broken: DataFrame

    def table(self, name: str) -> DataFrame:
        """Level `name` with typed columns."""
        return typed(self.levels[name], self.fields[name])


def flatten(documents: DataFrame, broken: DataFrame, root: Column, collections: tuple[Collection, ...], array_key: str = "bigg_id", max_fields: int = MAX_FIELDS) -> Flattened:
    """Every nested level below `root` (a variant expression over ``doc``) as its own table, of whatever depth.

    `collections` are the declared ones; arrays of objects that the merged schemas show besides are exploded too, their
    members' key being `array_key`. Levels are named by their path, like ``reactions.segments``.
    """
    start = documents.select("record", F.lit("").alias("path"), F.lit("").alias("key"), root.alias("value")).where(F.col("value").isNotNull())
    out = Flattened({"": start}, {}, broken)
    todo: list[tuple[str, tuple[Collection, ...]]] = [("", collections)]
    while todo:
        name, declared = todo.pop(0)
        level, names = out.levels[name], {c.name for c in declared}
        below = lambda child: f"{name}.{child}" if name else child
        fields = merged_fields(level, names, max_fields)
        out.fields[name] = fields
        own: tuple[Collection, ...] = ()
        if fields is None:
            found = written(members_of_any(level, names, array_key), "level")
            if not found.isEmpty():
                out.levels[below("*")] = found
                todo.append((below("*"), ()))
        else:
            own = tuple(Collection(n, array_key) for n, k in fields.items() if k.startswith("ARRAY<OBJECT"))
            out.fields[name] = {n: k for n, k in fields.items() if n not in {c.name for c in own}}
        for c in (*declared, *own):
            out.levels[below(c.name)] = written(members(level, c), "level")
            todo.append((below(c.name), c.children))
    return out
