"""Prefix trie of conversations with subtree sums by heavy-path decomposition.

Every distinct sequence of first turns is a node.  A node's largest child (most members) carries its path on; other children
are light and start paths of their own.  A light child has at most half of its parent's members, so paths fall into
classes by the binary logarithm of their top's members, and all light children of a path's nodes are in lower classes.
Rounds go up the classes, one for each that occurs (at most 1 + log2 of the conversations): a round sums the values along its
paths from the bottom, in blocks of depths, and hands each light top's total to the parent, whose path comes in a later round.

Turns leave the first scan as hashes.  A node's name is the hash of a rolling sum (as running sums in two levels), the tops of paths are found
by pointer doubling along heavy edges, where no two nodes that are still under way point to the same one.  So neither a conversation nor a path,
a node's members or its children are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, session_of, small_batches, stored

#: Turn numbers or depths in a block of a running sum.
BLOCK = 256
#: Ids in a chunk of the text that is hashed for a node: 2 to this power.
_ID_BITS = 16
_SUMS = ("h1", "h2", "h3")


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def _root() -> Column:
    return _name(F.lit(0), [F.lit(0)] * len(_SUMS))


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, content, chars): turns in order (null first, then by content), as hash and length; position from 1."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    t = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.md5(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said).cast("binary")).alias("content"),
        F.length(said[1]).cast("long").alias("chars"),
    )
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    sizes = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "content")
    t = t.withColumn("rank", F.row_number().over(inside)).join(sizes, ["conv_id", "block"])
    return t.select("conv_id", (F.col("offset") + F.col("rank")).alias("position"), "content", "chars")


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where conversation c starts with the first h turns of c - c % group; h = crc32(decimal c) % most.

    Its own turns follow after its first h.  ``turns`` (conv_id, position, content, chars); the second table has
    (conv_id, n), also of conversations that have no turn left.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(bases, "base", "left")
    convs = cut(convs.withColumn("k", F.least("h", F.coalesce("of_base", F.lit(0)))).select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    first = turns.where(F.col("position") < most).select(F.col("conv_id").alias("base"), "position", "content", "chars")
    heads = convs.where("k > 0").select("conv_id", "base", "k").join(first, "base").where("position <= k").select("conv_id", "position", "content", "chars")
    tails = turns.where(F.col("position") > h).join(convs.select("conv_id", "h", "k"), "conv_id")
    tails = tails.select("conv_id", (F.col("position") - F.col("h") + F.col("k")).alias("position"), "content", "chars")
    return heads.unionByName(tails), convs.select("conv_id", "n")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars) of every prefix of one turn or more."""
    # 42 bits of each hash: their sums over a conversation of two million turns fit 63 bits
    marks = [F.shiftrightunsigned(F.xxhash64(F.lit(i), "position", "content"), 22).alias(f"m{h}") for i, h in enumerate(_SUMS)]
    t = turns.select("conv_id", F.col("position").alias("depth"), F.floor(F.col("position") / BLOCK).alias("block"), "chars", *marks)
    sums = t.groupBy("conv_id", "block").agg(*[F.sum(f"m{h}").alias(h) for h in _SUMS])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"b{h}") for h in _SUMS])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.sum(f"m{h}").over(inside).alias(h) for h in _SUMS]).join(sums, ["conv_id", "block"])
    here = [F.col(h) + F.col(f"b{h}") for h in _SUMS]
    above = [x - F.col(f"m{h}") for x, h in zip(here, _SUMS, strict=True)]
    return t.select("conv_id", "depth", _name(F.col("depth"), here).alias("node"), _name(F.col("depth") - 1, above).alias("parent"), "chars")


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends`` (node, conv_id): SHA-256 of the ids in order, joined by commas.

    A digest is made in order, so it reads a node's ids one after another; they come to it as texts of 65 536 ids, which
    are made wherever the ids lie.
    """

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        at, digest = None, sha256()
        given = lambda rows: pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], ["node", "ends_sha256"])
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield given(done)
        if at is not None:
            yield given([(at, digest.hexdigest())])

    small_batches(session_of(ends))
    chunks = ends.groupBy("node", F.shiftright("conv_id", _ID_BITS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def _with_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children, top (the first node of its path) and class (binary logarithm of the top's members)."""
    by_size = F.struct(F.col("n_convs").alias("n"), (-F.col("conv_id")).alias("first"), F.col("node").alias("node"))
    families = nodes.where("depth > 0").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"), F.max(by_size)["node"].alias("heavy"))
    families = cut(families)
    out = nodes.join(families.select("of", "n_children"), F.col("node") == F.col("of"), "left").drop("of")
    out = out.join(families.select(F.col("heavy").alias("of"), F.lit(True).alias("heavy")), F.col("node") == F.col("of"), "left").drop("of")
    out = cut(out.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("heavy", F.coalesce("heavy", F.lit(False))))

    # Pointer doubling along heavy edges.  Each parent has one heavy child, so those under way point to different nodes.
    state = out.select("node", F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("node")).alias("to"), (~F.col("heavy")).alias("done"), F.col("n_convs").alias("members"))
    while True:
        target = state.select(F.col("node").alias("t"), F.col("to").alias("t_to"), F.col("done").alias("t_done"), F.col("members").alias("t_members"))
        under_way = state.where("not done").join(target, F.col("to") == F.col("t"))
        under_way = under_way.select("node", F.col("t_to").alias("to"), F.col("t_done").alias("done"), F.when(F.col("t_done"), F.col("t_members")).otherwise(F.col("members")).alias("members"))
        state = cut(state.where("done").unionByName(under_way))
        if not state.where("not done").limit(1).count():
            break
    tops = state.select(F.col("node").alias("of"), F.col("to").alias("top"), (F.length(F.bin("members")) - 1).alias("class"))
    return out.join(tops, F.col("node") == F.col("of")).drop("of")


def _suffix_sums(path_nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``path_nodes`` with each of ``values`` summed from the bottom of the path up to the node, in blocks of depths."""
    t = path_nodes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    sums = t.groupBy("top", "block").agg(*[F.sum(v).alias(v) for v in values])
    below = Window.partitionBy("top").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("top", "block", *[F.coalesce(F.sum(v).over(below), F.lit(0)).alias(f"{v}_below") for v in values])
    inside = Window.partitionBy("top", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        t = t.withColumn(v, F.sum(v).over(inside))
    t = t.join(sums, ["top", "block"])
    return t.select(*path_nodes.columns[: -len(values)], *[(F.col(v) + F.col(f"{v}_below")).alias(v) for v in values])


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` (conv_id, position from 1, content, chars) and ``conversations`` (conv_id, n turns), each conv_id once in the
    second.  Conversations without turns are members of the root alone.  No conversations: no nodes.
    """
    prefixes = cut(_prefixes(turns))
    nodes = prefixes.groupBy("node", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(_root().alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = _with_paths(nodes.unionByName(root))
    own = [F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")]
    values = ("n_leaves", "saved_tokens")
    # Spark splits the children of a node that has very many: both sides are dealt for the join.
    above = nodes.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"), F.col("class").alias("parent_class"))
    held = nodes.join(above, F.col("parent") == F.col("of"), "left").select("node", "depth", "parent", "top", "conv_id", "parent_conv_id", "parent_class", "n_convs", "n_children", "class", *own)
    held = stored(held, "class")
    classes = sorted(r[0] for r in held.select("class").distinct().collect())  # 64 at most
    done, given = [], []
    for k in classes:
        part = held.where(F.col("class") == k).drop("class")
        if given:
            sums = reduce(DataFrame.unionByName, given).where(F.col("parent_class") == k).groupBy(F.col("parent").alias("of")).agg(*[F.sum(v).alias(f"{v}_light") for v in values])
            part = part.join(sums, F.col("node") == F.col("of"), "left")
            part = part.select(*[c for c in held.columns if c not in (*values, "class")], *[(F.col(v) + F.coalesce(f"{v}_light", F.lit(0))).alias(v) for v in values])
        part = cut(_suffix_sums(part, values))
        done.append(part)
        given.append(part.where("node = top and parent is not null").select("parent", "parent_class", *values))
    if not done:
        done.append(held.drop("class"))
    ends = prefixes.join(conversations, "conv_id").where("depth = n").select("node", "conv_id").unionByName(conversations.where("n = 0").select(_root().alias("node"), "conv_id"))
    digests = _ends_digest(ends).withColumnRenamed("node", "of")
    out = reduce(DataFrame.unionByName, done).join(digests, F.col("node") == F.col("of"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt_turns``) of a table (conv_id, turn, role, text).

    Turns are ordered by number (null first); equal numbers by a hash of role and text.  Null role or text counts as empty; rows of a null conv_id
    belong to no conversation and are left out.  Repeated rows are turns of their own.  An empty table gives no nodes.
    Other columns are not read.
    """
    return prefix_trie(*rebuilt_turns(cut(ordered_turns(conversations))))
