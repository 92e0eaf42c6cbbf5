"""References to rows that do not exist, or did not at the time.

Two steps. A Bloom filter over all parent keys is broadcast; a reference whose key is not in the filter certainly has no
parent and is settled without any shuffle. Only references that pass the filter are verified exactly, against the
lifetimes of the parent that they name.

The filter is made of blocks of ``BLOCK`` 64-bit words, one row each: a key's first hash picks the block and a word in it,
its second sets ``BITS_PER_KEY`` bits of the word. Building it is one ``bit_or`` aggregation with map-side combine, probing
it is a hash join on the block number, so both stay in generated JVM code and no Python or driver memory is involved. The
number of blocks follows the number of distinct parent keys (``BITS_PER_ROW`` bits for each, counted by a sketch), so the
share of references that it settles does not fall as the parents grow. A filter of up to ``BROADCAST_BYTES`` is broadcast.
A larger one stays spread over the cluster by its blocks, and references go to the task that has their block: of a filter
of any size, one task holds its share of the blocks, the bytes of the filter over the number of shuffle partitions.

The exact step is an as-of join without pairs: parent rows and references of one key are sorted by time, and the latest end
of all lifetimes begun so far tells whether one stood. References to one key are salted by their number, so a key that a
third of all references name is split; its lifetimes, first merged by their begin, go to each part.

Defined results:

* a reference that is null or blank (only white space of any kind) is no reference;
* a reference that is not a whole number, or has a null group key, has no parent: ``missing``;
* an empty parent table makes every reference ``missing``; an empty child table gives no rows;
* a child without a time is in no parent's lifetime: ``missing`` without a parent row, else ``deleted``, period null;
* a parent row without `since` never stood; repeated child or parent rows count once;
* other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BITS_PER_KEY = 5
BITS_PER_ROW = 16
#: Words of a block, 512 bytes.
BLOCK = 64
#: A filter of at most so many bytes is broadcast, that of 16 million parent keys.
BROADCAST_BYTES = 32 << 20
#: References to one key that are verified in one task.
VERIFIED_ROWS = 100_000


def whole_number(text: Column) -> Column:
    """A number written as text: white space around it, leading zeros and a zero fraction do not matter. Else null."""
    return F.regexp_extract(text, r"^[\s\p{Z}]*([+-]?\d+)(?:\.0*)?[\s\p{Z}]*$", 1).try_cast("bigint")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(r"[^\s\p{Z}]")


def _place(group: Column, key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, word in it) of a key."""
    at = F.xxhash64(group, key)
    return F.pmod(at, F.lit(blocks)), F.shiftrightunsigned(at, 58).cast("int")


def _mask(group: Column, key: Column) -> Column:
    bits = F.xxhash64(key, group, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for i in range(BITS_PER_KEY):
        at = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def filter_blocks(distinct_keys: int) -> int:
    """Blocks for that many distinct keys."""
    return max(1, -(-distinct_keys * BITS_PER_ROW // (BLOCK * 64)))


def bloom_filter(parents: DataFrame, group: str, key: str, blocks: int) -> DataFrame:
    """The filter as a table (block, words), the words by their number in the block."""
    block, word = _place(F.col(group), F.col(key), blocks)
    words = parents.select(block.alias("block"), word.alias("word"), _mask(F.col(group), F.col(key)).alias("mask")).groupBy("block", "word").agg(F.bit_or("mask").alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))  # at most BLOCK entries
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint"))).alias("words"))


def with_filter_result(refs: DataFrame, filter_table: DataFrame, group: str, key: str, blocks: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`refs` with `may_exist`: false proves that no parent has the key."""
    block, word = _place(F.col(group), F.col(key), blocks)
    mask = _mask(F.col(group), F.col(key))
    small = blocks * BLOCK * 8 <= broadcast_bytes
    table = filter_table.withColumnsRenamed({"block": "_block", "words": "_words"})
    probed = refs.withColumn("_block", block).join(F.broadcast(table) if small else table.hint("merge"), "_block", "left")
    hit = F.coalesce(F.get("_words", word).bitwiseAND(mask) == mask, F.lit(False))
    return probed.withColumn("may_exist", hit & F.col(key).isNotNull() & F.col(group).isNotNull()).drop("_block", "_words")


def references(children: DataFrame, group: str, row_id: str, fields: list[str], at: str) -> DataFrame:
    """One row (group, row, at, field, key) for each reference of `children` that is not blank."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return (
        children.select(F.col(group).alias("group"), F.col(row_id).alias("row"), F.col(at).alias("at"), F.expr(f"stack({len(fields)}, {pairs}) as (field, ref)"))
        .where(~is_blank(F.col("ref")))
        .select("group", "row", "at", "field", whole_number(F.col("ref")).alias("key"))
    )


def probed_references(refs: DataFrame, rows: DataFrame, blocks: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`refs` (group, row, at, field, key) with `may_exist` by a filter over `rows` (group, key), sized by their distinct keys."""
    if blocks is None:
        blocks = filter_blocks(rows.agg(F.approx_count_distinct(F.xxhash64("group", "key"), 0.02)).first()[0])
    return with_filter_result(refs, bloom_filter(rows, "group", "key", blocks), "group", "key", blocks, broadcast_bytes)


def verified(refs: DataFrame, rows: DataFrame, per_task: int = VERIFIED_ROWS) -> DataFrame:
    """`refs` that no parent row (group, key, since, until) stands for at their time, with the `reason`; copies stay copies."""
    key = ["group", "key"]
    parts = refs.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > per_task).select(*key, F.ceil(F.col("_n") / per_task).cast("int").alias("_parts"))
    # Rows that begin together are one: where one of them is not deleted it has no end, else the latest end counts.
    ends = F.max(F.struct(F.col("until").isNull().alias("open"), "until"))
    lives = rows.where("group is not null and key is not null").groupBy(*key, "since").agg(ends.alias("life"))
    lives = lives.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    asked = refs.join(parts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("row", "field"), F.col("_parts")).cast("int"), F.lit(0)))
    same = lambda df: df.select(*key, "_part", "time", "is_ref", "life", "row", "at", "field")
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    begun = same(lives.select(*key, "_part", F.col("since").alias("time"), F.lit(False).alias("is_ref"), "life", none("row", refs), none("at", refs), none("field", refs)))
    put = same(asked.select(*key, "_part", F.col("at").alias("time"), F.lit(True).alias("is_ref"), none("life", lives), "row", "at", "field"))
    whole = W.partitionBy(*key, "_part")
    so_far = whole.orderBy(F.asc_nulls_first("time"), "is_ref").rowsBetween(W.unboundedPreceding, -1)
    timed = F.col("time").isNotNull()
    # Of lives and references: the latest end of the lives begun by then, whether any has begun, whether any is there at all.
    x = begun.unionByName(put).select(
        "*",
        F.max(F.when(timed, F.col("life"))).over(so_far).alias("latest"),
        F.max(F.when(~F.col("is_ref"), F.col("time").isNull())).over(whole).alias("undated"),
        F.max(~F.col("is_ref")).over(whole).alias("known"),
    )
    stood = F.coalesce(timed & (F.col("latest.open") | (F.col("time") < F.col("latest.until"))), F.lit(False))
    late = timed & F.col("latest").isNull() & ~F.coalesce("undated", F.lit(False))
    reason = F.when(~F.col("known"), "missing").when(late, "late").otherwise("deleted")
    return x.where("is_ref").where(~stood).select("group", "row", "at", "field", reason.alias("reason"))


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    *,
    group: str,
    row_id: str,
    fields: list[str],
    at: str,
    parent_key: str,
    since: str,
    until: str,
    blocks: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    per_task: int = VERIFIED_ROWS,
) -> DataFrame:
    """References of `children` that name no row of `parents` in the same group that stood at the time `at`.

    Returns (group, row, field, reason, period): `missing` where the group has no such parent, `late` where all its rows
    begin after `at`, else `deleted`; period is the month of `at`. `blocks` sets the size of the filter.
    """
    refs = references(children, group, row_id, fields, at)
    rows = parents.select(F.col(group).alias("group"), F.col(parent_key).cast("bigint").alias("key"), F.col(since).alias("since"), F.col(until).alias("until"))
    probed = probed_references(refs, rows, blocks, broadcast_bytes)
    cols = ["group", "row", "field", "reason", F.date_format("at", "yyyy-MM").alias("period")]
    proven = probed.where(~F.col("may_exist")).withColumn("reason", F.lit("missing"))
    found = verified(probed.where("may_exist").drop("may_exist"), rows, per_task)
    return proven.select(*cols).unionByName(found.select(*cols)).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references and rows that hold them, by field, reason and month."""
    return orphans.groupBy("field", "reason", "period").agg(F.count("*").alias("n_references"), F.countDistinct("group").alias("n_groups"))
