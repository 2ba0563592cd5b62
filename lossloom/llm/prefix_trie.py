"""The trie of all prefixes of conversations, from whole sequences that are collapsed first.

Identical conversations become one weighted sequence with the list of those that end there. A sequence that is a proper
prefix of another is no leaf; an anti-join against all proper prefixes finds the leaves. Only one conversation of each
sequence is then spelled out into prefixes, which are aggregated with their weights.

A prefix is known by its length and a 128-bit fingerprint: the exclusive or, over its turns, of a hash of the turn and its
place. That can be put together from any pieces, so no conversation, however long, has to pass through one task: turns are
numbered by sampled ranges and running values are taken inside blocks of ``BLOCK`` turns. Texts are hashed where they are
read and not moved.

Turns are ordered by turn (null first), role and hash of the text; null role or text is empty. Rows without a conversation id
belong to no conversation and are left out. A repeated row is a further turn. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.llm.common import shuffle_parts, stage
from lossloom.llm.ranges import pieces, place, ranged

BLOCK = 4096  # turns whose running values are taken in one window
SHARE = 1000  # a node with more than a 1/SHARE share of all branches is broadcast: there are fewer than SHARE such nodes
CHUNK = 1 << 16  # ids of an end list that are put together at a time

_KEY = ["depth", "a", "b"]


def _halves(hexed: Column) -> list[Column]:
    """The first 128 bits of a hexadecimal digest as two longs."""
    return [F.conv(F.substring(hexed, k, 16), 16, -10).cast("long") for k in (1, 17)]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, digest of role and text, chars of the text, in order: as ``ranged`` gives them."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("_row"),
    )
    return ranged(stage(rows, "turns"), ["conv_id"], ["turn", "role", "digest", "_row"], "turns-in-order").drop("turn", "role", "_row")


def rebuild(conversations: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: turns (conv_id, pos from 0, digest, chars) and all conv_ids, turnless ones too.

    Conversation c is the first h turns of conversation c - c % every and its own turns after its first h, where h is the
    CRC-32 of c's decimal digits modulo ``heads``.
    """
    rows = turn_rows(conversations)
    found = pieces(rows, ["conv_id"])
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long")
    convs = found.groupBy("conv_id").agg(F.first("_total").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    base = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("own").alias("_base_turns"))
    convs = convs.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("_base_turns", F.lit(0))).alias("head"))
    convs = stage(convs, "conversations")
    turns = place(rows, found.join(convs.select("conv_id", "h", "head", "base"), "conv_id"), ["conv_id"])
    turns = stage(turns.select("conv_id", "pos", "digest", "chars", "h", "head", (F.col("conv_id") == F.col("base")).alias("is_base")), "turns-placed")
    tails = turns.where("pos >= h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("pos"), "digest", "chars")
    lead = turns.where(F.col("is_base") & (F.col("pos") < heads - 1)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    led = convs.where("head > 0").select("conv_id", "base", "head").join(lead, "base").where("pos < head")
    return tails.unionByName(led.select("conv_id", "pos", "digest", "chars")), convs.select("conv_id")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 and turn_sha256 (of the last turn's role and text; root: null).

    turns: conv_id, pos (0, 1, ... in each), digest, chars. convs: every conv_id once, also those without turns.
    """
    hexed = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.col("digest")), 256)
    turns = turns.withColumn("_hex", hexed).select(
        "conv_id", "pos", "digest", "chars", F.floor(F.col("pos") / BLOCK).alias("block"), *(c.alias(n) for c, n in zip(_halves(F.col("_hex")), "ab"))
    )
    turns = stage(turns, "rebuilt")
    blocks = stage(
        turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("chars").alias("chars")), "blocks"
    )
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    none = {"depth": 0, "a": 0, "b": 0}
    whole = stage(convs.select("conv_id").distinct().join(whole, "conv_id", "left").fillna(none), "whole")

    sequences = stage(whole.groupBy(*_KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")
    prefixes = stage(_prefixes(turns, blocks, sequences), "prefixes")
    nodes = stage(
        prefixes.groupBy(*_KEY).agg(
            F.min(F.struct("rep", "suffix")).alias("owner"), F.max(F.col("length") > F.col("depth")).alias("proper"),
            F.first("chars").alias("chars"), F.first("digest").alias("digest"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"),
        ),
        "nodes",
    )
    leaves = sequences.where("depth > 0").join(nodes.where("proper").select(*_KEY), _KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    # a sequence owns the nodes whose smallest member it is: all from some depth on, where it leaves the paths of smaller ones
    owned = nodes.groupBy(F.col("owner.rep").alias("rep")).agg(F.min(F.struct("depth", F.col("owner.suffix").alias("suffix"))).alias("_own"))
    facts = (
        sequences.where("depth > 0").select("rep", "weight", F.col("depth").alias("length")).join(leaves, "rep", "left").join(owned, "rep", "left")
        .select("rep", "weight", "length", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("_own.depth", F.col("length") + 1).alias("own_from"), F.coalesce("_own.suffix", F.lit(0)).alias("own_chars"))
    )
    facts = stage(facts, "facts")
    counted = prefixes.drop("weight").join(_spread(facts), ["rep", "block"]).groupBy(*_KEY).agg(
        F.min(F.struct("rep", "own_from"))["own_from"].alias("own_from"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("suffix") - F.when(F.col("depth") >= F.col("own_from"), F.col("suffix")).otherwise(F.col("own_chars"))).alias("saved_tokens"),
    )
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    ends = stage(end_lists(whole), "ends")
    found = nodes.join(counted, _KEY).join(children, _KEY, "left").join(ends, _KEY, "left")
    found = found.select(
        F.col("owner.rep").alias("conv_id"), *_KEY, "up_a", "up_b", "own_from", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("turn_sha256"),
    )
    found = stage(found, "trie")
    top = _root(whole, facts, nodes, prefixes, ends)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_sha256"]
    return _with_parents(found, whole.agg(F.min("conv_id")).first()[0]).select(columns).unionByName(top.select(columns))


_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def _spread(facts: DataFrame) -> DataFrame:
    """facts once per block of their sequence, so that no join has a whole long sequence under one key."""
    last = F.floor((F.col("length") - 1) / BLOCK)
    return facts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).drop("length")


def _prefixes(turns: DataFrame, blocks: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of one conversation of each sequence, with the chars from its last turn to the end of the sequence."""
    reps = sequences.where("depth > 0").select("rep", "weight", F.col("depth").alias("length"))
    own = Window.partitionBy("rep")
    before = own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumnRenamed("conv_id", "rep").join(reps, "rep").select(
        "rep", "block", "weight", "length", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"_{c}") for c in "ab"),
        (F.sum("chars").over(own) - F.coalesce(F.sum("chars").over(before), F.lit(0))).alias("_left"),
    )
    rows = turns.withColumnRenamed("conv_id", "rep").join(offsets, ["rep", "block"])
    inside = Window.partitionBy("rep", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = (F.col(f"_{c}").bitwiseXOR(F.bit_xor(c).over(inside)) for c in "ab")
    return rows.select(
        "rep", "block", "weight", "length", (F.col("pos") + 1).alias("depth"), a.alias("a"), b.alias("b"),
        a.bitwiseXOR(F.col("a")).alias("up_a"), b.bitwiseXOR(F.col("b")).alias("up_b"), "digest", "chars",
        (F.col("_left") - F.sum("chars").over(inside) + F.col("chars")).alias("suffix"),
    )


def _with_parents(found: DataFrame, least: int | None) -> DataFrame:
    """parent_conv_id: a node's parent has the same smallest member unless the node is the first that its member owns.

    Those first nodes, one a sequence at most, are joined to their parents. A parent with a large share of them is broadcast.
    """
    inner = found.where("depth > own_from").withColumn("parent_conv_id", F.col("conv_id"))
    branches = stage(found.where("depth = own_from"), "branches")
    second = branches.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    up = ["up", "up_a", "up_b"]
    deeper = branches.where("depth > 1").withColumn("up", F.col("depth") - 1)
    parents = found.where("n_children > 0").select(F.col("depth").alias("up"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    many = max(1, branches.count() // SHARE)
    crowded = deeper.groupBy(*up).agg(F.count("*").alias("_n")).where(F.col("_n") > many).select(*up)
    crowded = stage(crowded.join(parents, up), "crowded")  # SHARE rows at most
    by_map = deeper.join(F.broadcast(crowded), up)
    by_shuffle = deeper.join(F.broadcast(crowded.select(*up)), up, "left_anti").join(parents, up)
    columns = [*found.columns, "parent_conv_id"]
    return inner.select(columns).union(second.select(columns)).union(by_map.select(columns)).union(by_shuffle.select(columns))


def _root(whole: DataFrame, facts: DataFrame, nodes: DataFrame, prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """The textless root, from totals over everything; no row if there is no conversation."""
    least, members = whole.agg(F.min("conv_id"), F.count("*")).first()
    firsts = nodes.where("depth = 1").count()
    tops = prefixes.where("depth = 1").select("rep", "suffix").join(facts, "rep")
    leaves, saved = tops.agg(F.sum("leaf"), F.sum(F.col("weight") * F.col("suffix") - F.col("own_chars"))).first()
    ended = ends.where("depth = 0").first()
    row = (least, 0, None, members, firsts, leaves if firsts else 1, saved or 0, ended["ends_sha256"] if ended else _EMPTY, None)
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_sha256 string"
    return whole.sparkSession.createDataFrame([row] if members else [], schema)


def end_lists(whole: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256: the digest of the ids of the conversations that are the sequence, ascending.

    The digest of a list can only be taken from its start to its end. So lists are put together in parallel as pieces of a
    range each, and one task streams over the pieces of a list; it holds one piece at a time.
    """
    rows = ranged(whole.select(*_KEY, "conv_id"), _KEY, ["conv_id"], "ends-in-order")
    size = F.floor(F.col("_place") / CHUNK).alias("_chunk")
    chunks = rows.groupBy(*_KEY, "_range", size).agg(F.array_sort(F.collect_list("conv_id")).alias("_ids"))
    chunks = chunks.select(*_KEY, "_range", "_chunk", F.array_join("_ids", ",").alias("ids"))
    parts = shuffle_parts(whole.sparkSession)
    ordered = chunks.repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "_range", "_chunk").select(*_KEY, "ids")
    return ordered.mapInArrow(_digest_lists, "depth long, a long, b long, ends_sha256 string")


def _digest_lists(batches):
    from hashlib import sha256

    import pyarrow as pa

    last, state, out = None, None, []

    def flush():
        rows = list(zip(*out))
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
        for key, ids in zip(keys, batch.column(3).to_pylist()):
            if key != last:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = key, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield flush()
            out = []
    if last is not None:
        out.append((*last, state.hexdigest()))
        yield flush()
