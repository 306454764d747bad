"""Merkle manifest of a dataset: a digest tree per group, one root over all groups, proofs of rows.

A leaf's place is a rank query on a compressed bitmap of its group's ids, so rows are never sorted.
The bitmap of a group keeps 64-bit words that hold an id, 64 words to a box; a box knows which of its
words are there and each word the rows before it (the popcount directory). Boxes add up along four
more levels of 8,192 children each, which spans all 64-bit ids: no level puts more than 8,192 rows of
a key into one task, whatever the ids look like.

Known places make the tree a matter of keys: node ``i`` of a level stands in slot ``i % 729`` of block
``i / 729``. A block is one row with an array of slots, six levels are folded inside it, and its last
node goes to a slot of the next block. Paths come back down the same blocks, so no join meets more
than 729 rows of a key and a group with a third of all rows is like any other.

Rules for odd rows: a null id counts as the smallest 64-bit integer, so it comes first; rows that
repeat an id follow each other by leaf digest, equal rows in any order (their rows are the same but
for the place); a null group is a group of its own and the first. Null and empty texts differ in
their digest. Empty tables give no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import discard, stored

#: A node has three children at most; a block of slots holds six levels of them.
ARITY, STEPS = 3, 6
SLOTS = ARITY**STEPS
LEAST_ID = -(2**63)
#: Children of a directory entry, as a power of two; with 12 bits in a box they cover 64 bits.
FAN_BITS, FANS = 13, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def framed(column: Column) -> Column:
    """A value so that no two rows read alike: its length in bytes, a colon and itself, or ``-``."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row, with some columns replaced by others."""
    return digest(*(framed((changed or {}).get(c, F.col(c))) for c in columns))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal too; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    match = [left[k].eqNullSafe(other[f"{k}_r"]) for k in keys]
    return left.join(other, match, how).drop(*(f"{k}_r" for k in keys))


# -- ranks --------------------------------------------------------------------


def bitmaps(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Boxes of the bitmaps of ``key`` by group: words, their directory, and the rows before the box.

    ``n`` says how often a row counts. Ids that count more than once keep the surplus beside their word.
    """
    ids = rows.groupBy(*group, "key").agg(F.sum("n").alias("n"))
    bit = F.expr("CAST(key & 63 AS INT)")
    more = F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("more")))
    words = ids.groupBy(*group, F.expr("shiftright(key, 6)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(key & 63 AS INT)))").alias("bits"),
        F.sum("n").alias("n"), F.collect_list(more).alias("more"))
    at = F.expr("CAST(word & 63 AS INT)").alias("at")
    boxes = words.groupBy(*group, F.expr("shiftright(word, 6)").alias("box")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(word & 63 AS INT)))").alias("present"),
        F.array_sort(F.collect_list(F.struct(at, "bits", "n", "more"))).alias("words"), F.sum("n").alias("n"))
    before = lambda i: F.aggregate(F.slice("words", 1, i), F.lit(0).cast("long"), lambda s, w: s + w["n"])
    boxes = boxes.withColumn("words", F.transform("words", lambda w, i: F.struct(
        w["bits"].alias("bits"), w["more"].alias("more"), before(i).alias("before"))))

    # The directory above the boxes: counts go up level by level, rows before come down.
    levels = [boxes.select(*group, F.col("box").alias("at0"), "n")]
    for depth in range(1, FANS):
        up = F.expr(f"shiftright(at{depth - 1}, {FAN_BITS})").alias(f"at{depth}")
        levels.append(levels[-1].groupBy(*group, up).agg(F.sum("n").alias("n")))
    top = Window.partitionBy(*group)
    upto = (Window.unboundedPreceding, -1)
    known = levels[-1].withColumns({
        "total": F.sum("n").over(top),
        "start": F.coalesce(F.sum("n").over(top.orderBy(f"at{FANS - 1}").rowsBetween(*upto)), F.lit(0)),
    }).drop("n")
    for depth in range(FANS - 2, -1, -1):
        above = f"at{depth + 1}"
        here = levels[depth].withColumn(above, F.expr(f"shiftright(at{depth}, {FAN_BITS})"))
        inside = Window.partitionBy(*group, above).orderBy(f"at{depth}").rowsBetween(*upto)
        here = here.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n")
        known = same_keys(here, known, [*group, above]).select(
            *group, f"at{depth}", "total", (F.col("start") + F.col("inside")).alias("start"))
    return same_keys(boxes.drop("n"), known.withColumnRenamed("at0", "box"), [*group, "box"])


def ranked(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` with ``first`` (rows of the group whose ``key`` is smaller), ``same`` (those with this
    key) and ``total`` (all of the group), by rank queries on the group's bitmap."""
    keyed = rows.withColumn("box", F.expr(f"shiftright(key, 12)"))
    found = same_keys(keyed, bitmaps(rows, group), [*group, "box"])
    found = found.withColumn("w", F.expr(
        "element_at(words, CAST(bit_count(present & ~shiftleft(-1L, CAST(shiftright(key, 6) & 63 AS INT))) AS INT) + 1)"))
    surplus = "aggregate(w.more, 0L, (s, m) -> s + IF(m.bit {} CAST(key & 63 AS INT), m.more, 0L))"
    return found.withColumns({
        "first": F.expr("start + w.before + bit_count(w.bits & ~shiftleft(-1L, CAST(key & 63 AS INT))) + "
                        + surplus.format("<")),
        "same": F.expr("1L + " + surplus.format("=")),
    }).drop("box", "present", "words", "start", "w")


def placed(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` (group, ``key``, ``leaf``, ``n`` copies) with ``pos``, the first place of its copies in
    the group, and ``total``. Rows that share a key are ranked again by the head of their digest."""
    at = ranked(rows, group)
    alone = at.where("same = n").withColumn("pos", F.col("first")).drop("first", "same")
    shared = at.where("same > n").drop("same").withColumnsRenamed({"key": "id_key", "total": "all", "first": "base"})
    shared = shared.withColumn("key", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    again = ranked(shared, [*group, "id_key"])
    ties = Window.partitionBy(*group, "id_key", "key").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    again = again.withColumn("pos", F.col("base") + F.col("first") + F.coalesce(F.sum("n").over(ties), F.lit(0)))
    again = again.drop("key", "first", "same", "total", "base").withColumnsRenamed({"id_key": "key", "all": "total"})
    return alone.unionByName(again)


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values with ``pos``, their place in ascending order (null first), and ``total``."""
    ranged = stored(rows.repartitionByRange(F.col(column).asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    starts = parts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_first()))
    return ranged.join(F.broadcast(starts), "part").withColumn("pos", F.col("start") + inside - 1).drop("part", "start")


# -- the tree -----------------------------------------------------------------


def _height() -> Column:
    """Levels above ``total`` leaves: the least h with 3**h >= total."""
    steps = F.array(*(F.lit(ARITY**h).cast("long") for h in range(40)))
    return F.size(F.filter(steps, lambda p: p < F.col("total")))


def _folded(blocks: DataFrame, step: int) -> DataFrame:
    """Blocks with the levels of their ``nodes`` (``n0`` to ``n6``) and ``todo``, how many count."""
    out = blocks.withColumns({
        "todo": F.least(F.greatest(_height() - STEPS * step, F.lit(0)), F.lit(STEPS)), "n0": F.col("nodes")})
    for level in range(STEPS):
        here = F.col(f"n{level}")
        runs = F.sequence(F.lit(0), F.floor((F.size(here) - 1) / ARITY).cast("int"))
        up = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(here, i * ARITY + 1, ARITY), ""), 256))
        out = out.withColumn(f"n{level + 1}", F.when(F.col("todo") > level, up).otherwise(here))
    return out.withColumn("top", F.element_at(f"n{STEPS}", 1)).drop("nodes")


def _path(slot: Column) -> Column:
    """Siblings of a slot in its block, level by level, those to the left and to the right."""
    levels = []
    for level in range(STEPS):
        node = F.floor(slot / ARITY**level).cast("int")
        run = F.floor(node / ARITY).cast("int") * ARITY
        levels.append(F.struct(
            F.array_join(F.slice(f"n{level}", run + 1, node - run), "").alias("before"),
            F.array_join(F.slice(f"n{level}", node + 2, run + ARITY - 1 - node), "").alias("after")))
    return F.slice(F.array(*levels), 1, F.col("todo"))


def build(rows: DataFrame, group: Sequence[str], item: Sequence[str]) -> list[DataFrame]:
    """Blocks of every step, the leaves' first; those of the last step hold the group's root in ``top``.

    ``rows`` have group, ``total``, ``pos``, ``n``, ``leaf`` and the columns of ``item``. A row of many
    copies goes to its blocks as one piece each and becomes slots there.
    """
    total = rows.agg(F.max("total")).first()[0] or 0
    pieces = rows.select(*group, "total", "pos", "n", "leaf", *item, F.explode(F.expr(
        f"sequence(pos DIV {SLOTS}, (pos + n - 1) DIV {SLOTS})")).alias("block"))
    start = F.greatest(F.col("pos"), F.col("block") * SLOTS)
    stop = F.least(F.col("pos") + F.col("n"), (F.col("block") + 1) * SLOTS)
    piece = F.struct((start - F.col("block") * SLOTS).alias("at"), (stop - start).cast("int").alias("len"),
                     F.struct("leaf", *item).alias("row"))
    slots = pieces.groupBy(*group, "block").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    slots = slots.withColumn("rows", F.flatten(F.transform("pieces", lambda p: F.array_repeat(p["row"], p["len"]))))
    slots = slots.withColumn("nodes", F.transform("rows", lambda r: r["leaf"])).drop("pieces")
    steps = [stored(_folded(slots, 0))]
    while total > SLOTS**len(steps):
        above = steps[-1].groupBy(*group, F.expr(f"block DIV {SLOTS}").alias("block")).agg(
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), "top"))).alias("nodes"))
        steps.append(stored(_folded(above.withColumn("nodes", F.transform("nodes", lambda x: x["top"])), len(steps))))
    return steps


def paths(steps: list[DataFrame], group: Sequence[str], tops: DataFrame) -> DataFrame:
    """The rows of the leaves with ``path``: siblings up to the group's root, then ``path`` of ``tops``.

    ``tops`` has one row a group, whose other columns go to all rows of the group.
    """
    carried = [c for c in tops.columns if c not in (*group, "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for step in range(len(steps) - 1, -1, -1):
        slots = F.col("rows") if step == 0 else F.col(f"n0")
        joined = same_keys(steps[step], above, [*group, "block"])
        entry = lambda row, i: F.struct(row.alias("row"), i.alias("slot"), _path(i).alias("near"))
        joined = joined.select(*group, "block", "path", *carried, F.explode(F.transform(slots, entry)).alias("e"))
        path = F.concat("e.near", "path").alias("path")
        place = (F.col("block") * SLOTS + F.col("e.slot")).alias("block")
        above = joined.select(*group, place, path, *carried, *([F.col("e.row.*")] if step == 0 else []))
    return above.withColumnRenamed("block", "pos")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["before"], h, p["after"]))


def manifest(
    table: DataFrame, key: str = "doc_id", group: str = "source", columns: Sequence[str] = COLUMNS,
    tampered: dict[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """One row per row of ``table``: key, group, ``pos`` in the group, ``leaf``, ``subroot``, ``root``,
    ``path`` (siblings from the leaf to the root) and ``tampered_leaf``.

    ``tampered_leaf`` is the digest with the columns of ``tampered`` changed in rows for which ``where``
    holds; elsewhere, and where the change alters nothing, it is null.
    """
    leaf, other = leaf_of(columns), leaf_of(columns, tampered) if tampered else F.lit(None).cast("string")
    altered = F.when(F.lit(True) if where is None else where, other) if tampered else other
    digests = table.select(
        F.col(key).alias("id"), F.col(group).alias("group"), leaf.alias("leaf"), altered.alias("tampered_leaf"))
    digests = digests.withColumn("tampered_leaf", F.nullif("tampered_leaf", "leaf"))
    leaves = stored(digests.groupBy("group", "id", "leaf").agg(
        F.first("tampered_leaf").alias("tampered_leaf"), F.count(F.lit(1)).alias("n")))
    places = stored(placed(leaves.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(LEAST_ID))), ["group"]))
    inner = build(places, ["group"], ["id", "tampered_leaf"])
    discard(leaves, places)
    roots = inner[-1].select("group", F.col("top").alias("leaf"), F.lit(1).cast("long").alias("n"))
    outer = build(numbered(roots, "group").withColumn("all", F.lit(0)), ["all"], ["group"])
    whole = outer[-1].select("all", F.col("top").alias("root"), F.expr(
        "CAST(array() AS ARRAY<STRUCT<before: STRING, after: STRING>>)").alias("path"))
    tops = paths(outer, ["all"], whole).select("group", F.col("leaf").alias("subroot"), "root", "path")
    rows = paths(inner, ["group"], tops)
    return rows.select(F.col("id").alias(key), F.col("group").alias(group), "pos", "leaf", "subroot", "root",
                       "path", "tampered_leaf")


def proofs(rows: DataFrame) -> DataFrame:
    """Rows of a manifest with the digest of their siblings, the root they give and its agreement."""
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    return rows.withColumns({
        "proof_sha256": F.sha2(siblings, 256),
        "folded_root": folded(F.col("path"), F.coalesce("tampered_leaf", "leaf")),
    }).withColumn("verified", F.col("folded_root") == F.col("root"))
