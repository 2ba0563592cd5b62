"""A Merkle manifest of a table, and proofs fetched once per leaf partition (octopus multiproofs).

Leaves stand by group (nulls first, then bytewise) and number (nulls first, ties by leaf). Every 16 consecutive nodes of a
group become one, until one remains; these group roots form a tree of their own in the order of the groups.

A leaf partition is a stretch of the table made of whole subtrees of 16^3 leaves, two to three of them (or smaller groups). To prove leaves of it, the partition lists
the coordinates of all nodes that its proofs need and that its own leaves do not yield, each one once; one join fetches them;
then interiors are derived bottom-up, shared by all leaves below them, and single proofs are cut out of them in place.

H is the hexadecimal SHA-256 of its concatenated inputs; digests go in as hexadecimal text and are stored as 32 bytes.
Repeated rows are leaves like any other. Null cells and empty texts have leaves of their own (see ``leaf_of``). An empty table
has no root and no proofs. Columns that are not named do not take part.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.llm.common import stage
from lossloom.llm.grouping import sorted_groups
from lossloom.llm.ranges import pieces, place, ranged

FAN = 16
LEVELS = 3  # levels that one task derives at a time

GROUPS, TOP = 0, 1  # the two kinds of trees

_NODE = "tree int, sid long, level int, idx long, width long, hash binary"


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: each cell '-' if null, else its length in bytes, ':' and its text."""
    cells = []
    for c in columns:
        value = c.cast("string")
        cells.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*cells), 256))


@dataclass
class Manifest:
    """leaves (place of every row), nodes (all interiors) and roots (one row per group)."""

    leaves: DataFrame  # tree, sid, level 0, idx, width, hash, part, and the columns that were kept
    nodes: DataFrame  # tree, sid, level, idx, width, hash; width is the number of nodes of that level
    roots: DataFrame  # sid, group, n_leaves, hash

    def root(self) -> str | None:
        """The root of the table."""
        tops = self.nodes.where((F.col("tree") == TOP) & (F.col("width") == 1)).select("hash").limit(1).collect()
        if not tops:
            tops = self.roots.select("hash").limit(1).collect()  # one group: its root is the root
        return bytes(tops[0]["hash"]).hex() if tops else None


def build_manifest(docs: DataFrame, columns: list[str], group: str, number: str, keep: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of a table; ``keep`` names further columns to carry beside the leaves.

    Texts are read once, for the leaves. What is shuffled after that is a digest and a few numbers a row.
    """
    subtree = FAN**levels
    rows = docs.select(
        F.col(group).alias("group"), F.col(number).alias("number"), leaf_of([F.col(c) for c in columns]).alias("hash"),
        *(c.alias(n) for n, c in (keep or {}).items()), F.monotonically_increasing_id().alias("_row"),
    )
    rows = ranged(stage(rows, "leaves"), ["group"], ["number", "hash", "_row"], "leaves-in-order")
    found = stage(pieces(rows, ["group"]), "leaf-pieces")
    groups = _numbered(found.groupBy("group").agg(F.sum("_count").alias("n_leaves")))
    found = found.join(groups.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group"))).drop("_group", "n_leaves")
    placed = place(rows, found.withColumn("width", F.col("_total")), ["group"])
    first = F.col("start") + F.floor(F.col("pos") / subtree) * subtree  # of the row's subtree, among all rows
    leaves = placed.select(
        F.lit(GROUPS).alias("tree"), "sid", F.lit(0).alias("level"), F.col("pos").alias("idx"), "width", "hash",
        F.floor(first / (2 * subtree)).alias("part"), "number", *(keep or {}),
    )
    leaves = stage(leaves, "leaves-placed")
    nodes = _interiors(leaves, levels)
    tops = leaves.select(*_names()).union(nodes.select(*_names())).where("width = 1").select("sid", "hash")
    roots = stage(groups.join(tops, "sid").select("sid", "group", "n_leaves", "hash"), "group-roots")
    count = roots.count()
    top = roots.select(
        F.lit(TOP).alias("tree"), F.lit(0).cast("long").alias("sid"), F.lit(0).alias("level"), F.col("sid").alias("idx"), F.lit(count).cast("long").alias("width"), "hash"
    )
    upper = _interiors(top.withColumn("part", F.floor(F.col("idx") / (2 * subtree))), levels)
    return Manifest(leaves, nodes.union(upper), roots)


def _names() -> list[str]:
    return ["tree", "sid", "level", "idx", "width", "hash"]


def _numbered(groups: DataFrame) -> DataFrame:
    """groups with sid (0, 1, ... in order) and start (leaves before the group); sums run inside ranges, then over ranges."""
    rows = ranged(groups, [], ["group"], "groups")
    of = pieces(rows, []).join(rows.groupBy("_range").agg(F.sum("n_leaves").alias("_leaves")), "_range")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("_off", F.coalesce(F.sum("_leaves").over(before), F.lit(0)))
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("n_leaves").over(inside), F.lit(0)))
    placed = place(rows, of, []).withColumn("start", F.col("_off") + F.col("_own"))
    return stage(placed.select("group", "n_leaves", F.col("pos").alias("sid"), "start"), "groups-numbered")


def _interiors(nodes: DataFrame, levels: int) -> DataFrame:
    """All nodes above the given ones, a few levels a round; the number of rounds follows the largest group."""
    parts, level = [], 0
    block = F.floor(F.col("idx") / FAN**levels)
    now = nodes.where("width > 1").select(*_names(), "part")
    while True:
        made = now.repartition("part").sortWithinPartitions("tree", "sid", "idx").select("tree", "sid", block.alias("block"), "level", "idx", "width", "hash")
        made = stage(made.mapInArrow(_raiser(levels), _NODE), "nodes")
        parts.append(made)
        level += levels
        now = made.where((F.col("level") == level) & (F.col("width") > 1))
        if now.isEmpty():
            break
        now = now.select(*_names(), F.xxhash64("sid", block).alias("part"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


def _h(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _raiser(levels: int):
    def up(batches):
        """The nodes above each whole subtree."""
        for (tree, sid, _), (level_of, idx, widths, hashes) in sorted_groups(batches, 3):
            level, first, width, now = level_of[0], idx[0], widths[0], [h.hex() for h in hashes]
            out = []
            for _ in range(levels):
                if width == 1:
                    break
                now = [_h(now[k : k + FAN]) for k in range(0, len(now), FAN)]
                level, first, width = level + 1, first // FAN, -(-width // FAN)
                out += [(tree, sid, level, first + k, width, bytes.fromhex(h)) for k, h in enumerate(now)]
            yield _batch(out, _NODE_TYPES)

    return up


_NODE_TYPES = [("tree", pa.int32()), ("sid", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("width", pa.int64()), ("hash", pa.binary())]
_WANT_TYPES = [("part", pa.int64()), ("tree", pa.int32()), ("sid", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())]


def _batch(rows, types):
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])


def missing(tree: int, sid: int, at: list[int], width: int):
    """Coordinates of the nodes that proofs of the nodes ``at`` of a level need and that these do not yield.

    Each coordinate is named once: siblings that are asked for, or derived, are not."""
    out, level, now = [], 0, sorted(set(at))
    while width > 1:
        have, parents = set(now), sorted({k // FAN for k in now})
        out += [(tree, sid, level, k) for p in parents for k in range(p * FAN, min(p * FAN + FAN, width)) if k not in have]
        level, now, width = level + 1, parents, -(-width // FAN)
    return out


def _requests(tops: int):
    def ask(batches):
        """The union of missing coordinates of each leaf partition."""
        sids, last = [], None
        for (part, sid), (idx, widths) in sorted_groups(batches, 2):
            if last is not None and part != last:
                yield from close(last, sids)
                sids = []
            last = part
            sids.append(sid)
            rows = [(part, *c) for c in missing(GROUPS, sid, idx, widths[0])]
            if rows:
                yield _batch(rows, _WANT_TYPES)
        if last is not None:
            yield from close(last, sids)

    def close(part, sids):
        rows = [(part, *c) for c in missing(TOP, 0, sids, tops)]
        if rows:
            yield _batch(rows, _WANT_TYPES)

    return ask


def fetched(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """The nodes that the leaf partitions of the wanted leaves lack: part, tree, sid, level, idx, hash, each once a partition."""
    tops = manifest.roots.count()
    asked = wanted.select("part", "sid", "idx", "width").repartition("part").sortWithinPartitions("part", "sid", "idx")
    asked = stage(asked.mapInArrow(_requests(tops), "part long, tree int, sid long, level int, idx long"), "coordinates")
    stored = manifest.nodes.select("tree", "sid", "level", "idx", "hash")
    top = manifest.roots.select(F.lit(TOP).alias("tree"), F.lit(0).cast("long").alias("sid"), F.lit(0).alias("level"), F.col("sid").alias("idx"), "hash")
    stored = stored.union(top)
    if not asked.where((F.col("tree") == GROUPS) & (F.col("level") == 0)).isEmpty():  # only part of the leaves is to be proved
        stored = stored.union(manifest.leaves.select("tree", "sid", "level", "idx", "hash"))
    return asked.join(stored, ["tree", "sid", "level", "idx"])


_PROOF = "number long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(manifest: Manifest, wanted: DataFrame | None = None, claim: str = "hash", siblings: bool = False) -> DataFrame:
    """One row per wanted leaf (rows of manifest.leaves; all by default): number, leaf, subroot, root, proof_sha256,
    folded_root and verified; with ``siblings`` also the proof itself, as lists of digests from the leaf's level to the top.

    ``claim`` names the column with the digest that is to be checked: folded_root is what it and the siblings give, and
    verified says whether that is the root. A claim equal to the leaf folds into the interiors that the partition derives
    anyway; any other is folded level by level.
    """
    wanted = manifest.leaves if wanted is None else wanted
    rows = wanted.select("part", "sid", "idx", "width", "hash", F.col(claim).alias("claim"), "number")
    nodes = fetched(manifest, wanted)
    schema = _PROOF + (", siblings array<array<string>>" if siblings else "")
    tops = manifest.roots.count()
    return rows.groupBy("part").cogroup(nodes.groupBy("part")).applyInArrow(_expander(tops, siblings), schema)


class _Tree:
    """The part of a tree that a leaf partition knows: runs of siblings and, above each, the rest of the proofs."""

    def __init__(self, width: int, own: dict[int, str], others: dict[tuple[int, int], str]):
        self.runs: list[dict[int, list[str]]] = []
        now, level = own, 0
        while width > 1:
            runs = {}
            for p in sorted({k // FAN for k in now}):
                runs[p] = [now[k] if k in now else others[level, k] for k in range(p * FAN, min(p * FAN + FAN, width))]
            self.runs.append(runs)
            now, level, width = {p: _h(run) for p, run in runs.items()}, level + 1, -(-width // FAN)
        self.root = now[0]
        self._rests: dict[tuple[int, int], str] = {}

    def siblings(self, idx: int, level: int = 0) -> list[list[str]]:
        out = []
        for runs in self.runs[level:]:
            run, at = runs[idx // FAN], idx % FAN
            out.append(run[:at] + run[at + 1 :])
            idx //= FAN
        return out

    def proof(self, idx: int, level: int = 0) -> str:
        """All siblings from a level up as one text; those above a run are put together once for the whole run."""
        if level == len(self.runs):
            return ""
        run, at = self.runs[level][idx // FAN], idx % FAN
        above = (level + 1, idx // FAN)
        if above not in self._rests:
            self._rests[above] = self.proof(above[1], above[0])
        return "".join(run[:at] + run[at + 1 :]) + self._rests[above]

    def fold(self, idx: int, digest: str) -> str:
        for runs in self.runs:
            run, at = runs[idx // FAN], idx % FAN
            digest, idx = _h([*run[:at], digest, *run[at + 1 :]]), idx // FAN
        return digest


def _expander(tops: int, siblings: bool):
    def expand(key, leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        got: dict[tuple[int, int], dict[tuple[int, int], str]] = {}
        for r in nodes.select(["tree", "sid", "level", "idx", "hash"]).to_pylist():
            got.setdefault((r["tree"], r["sid"]), {})[r["level"], r["idx"]] = r["hash"].hex()
        sids, idx, widths = (leaves.column(n).to_pylist() for n in ("sid", "idx", "width"))
        own = [h.hex() for h in leaves.column("hash").to_pylist()]
        claims = [h.hex() if h is not None else "" for h in leaves.column("claim").to_pylist()]
        held: dict[int, dict[int, str]] = {}
        width_of = dict(zip(sids, widths))
        for s, k, h in zip(sids, idx, own):
            held.setdefault(s, {})[k] = h
        trees = {s: _Tree(width_of[s], held[s], got.get((GROUPS, s), {})) for s in held}
        top = _Tree(tops, {s: t.root for s, t in trees.items()}, got.get((TOP, 0), {}))
        above = {s: top.proof(s) for s in trees}
        out = {n: [] for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings")}
        for s, k, h, c in zip(sids, idx, own, claims):
            tree = trees[s]
            folded = top.root if c == h else top.fold(s, tree.fold(k, c))
            out["leaf"].append(h)
            out["subroot"].append(tree.root)
            out["root"].append(top.root)
            out["proof_sha256"].append(_h([tree.proof(k), above[s]]))
            out["folded_root"].append(folded)
            out["verified"].append(folded == top.root)
            if siblings:
                out["siblings"].append(tree.siblings(k) + top.siblings(s))
        columns = {"number": leaves.column("number").cast(pa.int64())}
        columns |= {n: pa.array(v, pa.bool_() if n == "verified" else pa.string()) for n, v in out.items() if n != "siblings"}
        if siblings:
            columns["siblings"] = pa.array(out["siblings"], pa.list_(pa.list_(pa.string())))
        return pa.table(columns)

    return expand
