"""Prefix trie of conversations: what they share from their first turn on, by depth-band rollup.

A node is a sequence of turns that some conversation starts with. Its key is its depth with 128 bits
made of the digests of its turns and their places, so equal beginnings meet by key and no text is
shuffled. The node's values are told by its smallest member, whose visit to it stands for the node.

Sums over subtrees: conversations are cut into bands of 16 depths. A node adds its values to its
ancestors within its band and to the band's root, 17 rows at most. The roots of the bands form a tree
a sixteenth as deep, which is summed the same way; their totals then go to the ancestors in the band
above. Rounds are the logarithm of the depth to the base 16, and nothing is copied more than 17 times.

No group grows with the data: turns of a long conversation are numbered in ranges (`Series`), digests
run in chunks of 4,096 turns, bands hold 17 rows. Counts of hot nodes are partial aggregates. Parents
with very many children, at most 65,536 of them, are joined by broadcast, so that their children stay
where they are. The ids that end at one node are sorted in chunks of 1,024 and hashed as a stream.

Rules for odd rows: turns go by number, a null number counting as the smallest integer; turns of the
same number by a hash of role and text, equal ones in any order. Null roles and texts are empty, and a
repeated row is a further turn. Rows without a conversation id belong to none and make no node.
An empty table has no root. Other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import discard, stored
from meterflow.operators.series import Series

BAND = 16
CHUNK_BITS = 12
#: Children of a parent that is joined by broadcast, at least; there are at most 2**16 such parents.
MANY_CHILDREN, MOST_HOT = 1 << 14, 1 << 16
ENDS_BITS = 10
KEY = ["depth", "x1", "x2"]
VALUES = ["n_leaves", "saved_tokens"]
LEAST_TURN = -(2**63)


def numbered(conversations: DataFrame, turns_per_chunk: int | None = None) -> DataFrame:
    """Turns with their place ``pos`` (from 1) in the conversation, a digest and the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LEAST_TURN)).alias("turn"),
        digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    ).withColumn("tie", F.xxhash64("digest"))
    layout = Series(["conv_id"], ("turn", "tie"), turns_per_chunk).measure(turns)
    return layout.positions(turns, "pos").select("conv_id", "pos", "digest", "bytes")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visits and lengths of conversations that share nothing but what their turns say."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return turns.withColumnRenamed("pos", "depth"), lengths


def forked(turns: DataFrame, base: Column, shared: Column, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """Visits and lengths of conversations rebuilt as forks.

    A conversation starts with the first ``shared`` turns (at most ``most_shared``) of conversation
    ``base``, as many as there are, and goes on with its own turns after its first ``shared``.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumns({"base": base, "h": shared.cast("long")}))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    forks = counts.join(bases, "base", "left").withColumn(
        "take", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn(
        "length", F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    forks = stored(forks.select("conv_id", "base", "h", "take", "length", "n"))
    # one row for every 65,536 turns, so that a long conversation is no hot key
    parts = forks.select("conv_id", "h", "take", F.explode(F.expr("sequence(0L, shiftright(n, 16))")).alias("part"))
    own = turns.withColumn("part", F.expr("shiftright(pos, 16)")).join(parts, ["conv_id", "part"])
    own = own.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("take")).alias("depth"),
                                      "digest", "bytes")
    first = turns.where(F.col("pos") <= most_shared).withColumnRenamed("conv_id", "base")
    lent = first.join(forks.select("conv_id", "base", "take"), "base").where("pos <= take").select(
        "conv_id", F.col("pos").alias("depth"), "digest", "bytes")
    discard(counts)
    return own.unionByName(lent), forks.select("conv_id", "length")


def _visited(visits: DataFrame) -> DataFrame:
    """Visits with the key of their node (``x1``, ``x2``) and of its parent (``p1``, ``p2``).

    The key is the exclusive or of what all turns up to here hash to at their places; the
    chunks of a long conversation take over what the chunks before them come to.
    """
    marks = visits.withColumns({
        "a1": F.xxhash64(F.lit(1), "depth", "digest"), "a2": F.xxhash64(F.lit(2), "digest", "depth"),
        "chunk": F.expr(f"shiftright(depth - 1, {CHUNK_BITS})")}).drop("digest")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    local = marks.withColumns({
        f"x{i}": F.bit_xor(f"a{i}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for i in (1, 2)})
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("conv_id", "chunk").agg(F.bit_xor("a1").alias("c1"), F.bit_xor("a2").alias("c2"))
    carried = carried.withColumns({f"c{i}": F.bit_xor(f"c{i}").over(before) for i in (1, 2)}).where("chunk > 0")
    out = local.join(carried, ["conv_id", "chunk"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", zero)) for i in (1, 2)})
    return out.select("conv_id", *KEY, *(F.col(f"x{i}").bitwiseXOR(F.col(f"a{i}")).alias(f"p{i}") for i in (1, 2)),
                      "bytes")


def _nodes(visits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every node with its smallest member, its parent's key, its members and its own bytes."""
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in KEY), "conv_id", "n_convs", *(zero.alias(c) for c in ("p1", "p2", "bytes")))
    inner = visits.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("bytes").alias("bytes"))
    return inner.unionByName(root)


def _summed(steps: DataFrame, deepest: int) -> DataFrame:
    """Sums of ``VALUES`` over the subtree of every node, its own included, by ``KEY``.

    ``steps`` has the visits of all conversations at depths 1, 2, ...; a visit holds values where it
    stands for its node, else nulls. The row of depth 0 sums everything below the root.
    """
    row = F.struct("at", "x1", "x2", *VALUES)
    band = F.expr(f"(depth - 1) DIV {BAND}")
    # the last visit of a band is the root of the next one, where it lends its key only
    last = (F.col("depth") % BAND == 0)
    context = steps.where(last).withColumns(
        {"band": F.expr(f"depth DIV {BAND}"), "at": F.lit(0).cast("long"), **{v: F.lit(None).cast("long") for v in VALUES}})
    within = steps.withColumns({"band": band, "at": F.col("depth") - band * BAND})
    packed = within.unionByName(context).groupBy("conv_id", "band").agg(
        F.count(VALUES[0]).alias("n"), F.sort_array(F.collect_list(row)).alias("path")).where("n > 0")
    zero = F.lit(0).cast("long")
    origin = F.struct(zero.alias("at"), zero.alias("x1"), zero.alias("x2"), *(zero.alias(v) for v in VALUES))
    # only the first band has no visit before it; the textless root stands there
    packed = packed.withColumn("path", F.when(F.col("band") == 0, F.concat(F.array(origin), "path")).otherwise(F.col("path")))
    packed = packed.select("conv_id", "band", "path", F.explode("path").alias("e")).where(
        f"e.at > 0 AND e.{VALUES[0]} IS NOT NULL").select(
        "conv_id", "band", "e", F.filter("path", lambda a: a["at"] <= F.col("e")["at"]).alias("up"))
    if deepest > BAND:
        packed = stored(packed)

    def spread(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        each = rows.select("band", F.explode("up").alias("u"), *(c.alias(v) for v, c in values.items()))
        return each.select((F.col("band") * BAND + F.col("u.at")).alias("depth"), "u.x1", "u.x2",
                           (F.col("u.at") == 0).alias("below"), *VALUES)

    near = spread(packed, {v: F.col(f"e.{v}") for v in VALUES})
    near = near.groupBy(*KEY, "below").agg(*(F.sum(v).alias(v) for v in VALUES))
    if deepest <= BAND:
        # the root's own row and nothing else is below a band's root here
        return near.groupBy(*KEY).agg(*(F.sum(v).alias(v) for v in VALUES))
    near = stored(near)
    # the band roots by the visits that stand for them, with what their band holds below them
    heads = packed.where(f"e.at = {BAND}").select(
        "conv_id", ((F.col("band") + 1) * BAND).alias("depth"), "e.x1", "e.x2")
    heads = heads.join(near.where("below"), KEY, "left").select(
        "conv_id", "depth", *(F.coalesce(v, zero).alias(v) for v in VALUES))
    above = steps.where(last).drop(*VALUES).join(heads, ["conv_id", "depth"], "left").withColumn(
        "depth", F.expr(f"depth DIV {BAND}"))
    totals = _summed(stored(above.select("conv_id", *KEY, *VALUES)), deepest // BAND)
    totals = stored(totals.withColumn("depth", F.col("depth") * BAND))
    ends = packed.where(f"e.at = {BAND}").select(
        "band", F.filter("up", lambda a: a["at"] > 0).alias("up"),
        ((F.col("band") + 1) * BAND).alias("depth"), F.col("e.x1").alias("x1"), F.col("e.x2").alias("x2"))
    far = spread(ends.join(totals, KEY).drop(*KEY), {v: F.col(v) for v in VALUES}).drop("below")
    root = near.where("below AND depth = 0").unionByName(totals.where("depth = 0").withColumn("below", F.lit(True)))
    own = near.where("NOT below").unionByName(root).drop("below")
    return own.unionByName(far).groupBy(*KEY).agg(*(F.sum(v).alias(v) for v in VALUES))


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of every key; the rows of a key follow each other in order."""
    held, state, done = None, None, []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

    for batch in batches:
        depths, x1s, x2s, pieces = (batch.column(batch.schema.get_field_index(c)) for c in (*KEY, "piece"))
        for *key, piece in zip(depths.to_pylist(), x1s.to_pylist(), x2s.to_pylist(), pieces.to_pylist()):
            if key != held:
                if held is not None:
                    done.append((*held, state.hexdigest()))
                held, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if len(done) >= 4096:
            yield flushed()
            done.clear()
    if held is not None:
        done.append((*held, state.hexdigest()))
        yield flushed()


def _ends(visits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node, in ascending order."""
    zero = F.lit(0).cast("long")
    parts = lengths.select("conv_id", F.col("length").alias("depth"))
    there = visits.select("conv_id", *KEY).join(parts, ["conv_id", "depth"], "left_semi")
    none = lengths.where("length = 0").select("conv_id", *(zero.alias(c) for c in KEY))
    pieces = there.unionByName(none).groupBy(*KEY, F.expr(f"shiftright(conv_id, {ENDS_BITS})").alias("chunk")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*KEY, "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("piece"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "piece")
    return ordered.mapInArrow(_hash_stream, "depth long, x1 long, x2 long, ends_sha256 string")


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_conv_id``, null for the root."""
    many = max(MANY_CHILDREN, nodes.count() // MOST_HOT)
    inner = nodes.where("depth > 0").withColumn("d1", F.col("depth") - 1)
    match = ["d1", "p1", "p2"]
    parents = nodes.where("n_children > 0").select(
        F.col("depth").alias("d1"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") >= many).drop("n_children"))  # 65,536 rows at most
    cold = parents.where(F.col("n_children") < many).drop("n_children")
    few = inner.join(hot, match, "left_anti").join(cold, match)
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return few.unionByName(inner.join(hot, match)).drop("d1").unionByName(root)


def trie(visits: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: smallest member, depth, parent, members, children, leaves and bytes saved
    below it, and the digest of the ids that end there.

    ``visits`` holds every turn of every conversation (``conv_id``, ``depth``, ``digest``, ``bytes``),
    ``lengths`` every conversation with its number of turns, also those without any.
    """
    visits, lengths = stored(_visited(visits)), stored(lengths)
    nodes = stored(_nodes(visits, lengths))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = stored(known.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_tokens": F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)}))
    discard(nodes)
    values = known.where("depth > 0").select("conv_id", "depth", *VALUES)
    deepest = known.agg(F.max("depth")).first()[0] or 0
    steps = visits.select("conv_id", *KEY).join(values, ["conv_id", "depth"], "left")
    if deepest > BAND:
        steps = stored(steps)
    totals = _summed(steps, deepest).withColumnsRenamed({v: f"all_{v}" for v in VALUES})
    out = _parents(known).join(totals, KEY, "left").join(_ends(visits, lengths), KEY, "left")
    # a root without turns has no row in the sums: it is its own only leaf
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        *(F.coalesce(f"all_{v}", v).alias(v) for v in VALUES),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
