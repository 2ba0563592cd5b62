import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lossloom.llm import heavy_dedup, merkle, prefix_trie
from lossloom.llm.queries import QUERIES

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


# ---- prefix trie


def plain_trie(rows):
    """The trie as the contract states it, with whole sequences as keys."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        k = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:k] + turns[k:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {n: 0 for n in members}
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = {n: 0 for n in members}, {n: 0 for n in members}
    for n, ms in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(ms) - 1) * len(n[-1][1]) if n else 0
    return sorted(
        (min(ms), len(n), min(members[n[:-1]]) if n else None, len(ms), kids[n], leaves[n], saved[n], h(",".join(map(str, sorted(c for c in ms if built[c] == n)))))
        for n, ms in members.items()
    )


def trie_of(frame):
    return sorted(tuple(r)[:8] for r in prefix_trie.prefix_trie(*prefix_trie.rebuild(frame)).collect())


def test_trie_against_plain_sequences(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)  # several blocks a conversation
    monkeypatch.setattr(prefix_trie, "SHARE", 4)  # crowded parents and others
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)  # end lists in several pieces
    pick = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 160), 250, 251, 399, 5000000000]:
        for turn in range(pick.choice([1, 2, 3, 5, 7, 11])):
            rows.append((c, turn if pick.random() > 0.1 or turn else None, pick.choice(["user", "bot", None]), pick.choice(["", "yes", "é\U0001f600 no", None, "a longer answer"])))
    rows += [(c, k, "user", "same") for c in range(300, 330) for k in range(4)]  # many copies
    rows += [(700, k, "u", f"turn {k}") for k in range(60)]  # a long one
    rows += [(None, 1, "user", "belongs to none")]
    pick.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONVERSATIONS + ", depth string, a long, rep long")
    assert trie_of(frame) == plain_trie(rows)


def test_trie_of_little(spark):
    assert trie_of(spark.createDataFrame([], CONVERSATIONS)) == []
    assert trie_of(spark.createDataFrame([(None, 0, "a", "b")], CONVERSATIONS)) == []
    turnless = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)  # its base does not exist
    for rows in ([(turnless, 0, "a", "b")], [(0, 0, None, None)], [(7, 1, "u", "t"), (7, 1, "u", "t")]):
        assert trie_of(spark.createDataFrame(rows, CONVERSATIONS)) == plain_trie(rows)


# ---- equal texts


def plain_groups(rows):
    groups = {}
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(low, []).append(doc)
    return {t: (max((d for d in ds if d is not None), default=None), len(ds)) for t, ds in groups.items()}


@pytest.mark.parametrize("share", [1000, 3])
def test_groups_of_equal_texts(spark, awkward, monkeypatch, share):
    monkeypatch.setattr(heavy_dedup, "SHARE", share)  # with 3 some groups are frequent and others are not
    extra = [(k, "Frequent É Text") for k in range(100, 140)] + [(200, "FREQUENT É text"), (201, "Frequent é text")] + [(300 + k // 2, f"pair {k // 2}") for k in range(20)]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + extra
    docs = awkward.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = heavy_dedup.duplicate_groups(docs.withColumn("winner", F.lit(1)).withColumn("digest", F.lit(2))).collect()
    want = plain_groups(rows)
    by_sha = {h(t): v for t, v in want.items()}
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(by_sha)
    left = heavy_dedup.deduplicate(docs.withColumn("_id", F.lit(1)).withColumn("winner", F.lit(2)))
    assert left.columns == [*docs.columns, "_id", "winner"]
    assert sorted(plain_groups((r["doc_id"], r["text"]) for r in left.collect())) == sorted(want) and left.count() == len(want)


def test_frequent_digests_are_found(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 200 == 1, "warm").otherwise(F.col("id").cast("string")).alias("text"))
    found = {r["group_size"] for r in heavy_dedup.winners(heavy_dedup.digest_rows(docs)).collect()}
    assert found == {20_000, 200}
    assert heavy_dedup.deduplicate(docs).count() == docs.select("text").distinct().count()


def test_no_rows(spark, none):
    assert heavy_dedup.duplicate_groups(none).count() == heavy_dedup.deduplicate(none).count() == 0


# ---- manifest


def plain_tree(nodes, proofs):
    """Root of a list of nodes; proofs[k] collects the siblings of the k-th."""
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[k].append(run[: p % 16] + run[p % 16 + 1 :])
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0]


def plain_manifest(rows):
    """(number, leaf, subroot, root, siblings) of rows (number, group, cells)."""

    def cell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for number, group, cells in rows:
        groups.setdefault(group, []).append((number, h("".join(map(cell, cells)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, mine = [], []
    for g in order:
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        proofs = [[] for _ in leaves]
        tops.append(plain_tree([leaf for _, leaf in leaves], proofs))
        mine.append((leaves, proofs))
    upper = [[] for _ in order]
    root = plain_tree(tops, upper)
    return [(n, leaf, t, root, p + u) for (leaves, proofs), t, u in zip(mine, tops, upper) for (n, leaf), p in zip(leaves, proofs)]


def manifest_rows(pick):
    rows = [(k, "big", "x" * (k % 7)) for k in range(700)] + [(k, f"s{k % 40}", f"T{k}") for k in range(120)]
    rows += [(None, "s1", "a"), (3, None, None), (4, None, ""), (1005, "é", "Ü"), (1005, "é", "Ü"), (1005, "é", "V"), (9, "", "z")]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 3])
def test_proofs_against_a_plain_tree(spark, levels):
    rows = manifest_rows(random.Random(3))
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, sid long, hash long, part long").repartition(5)
    manifest = merkle.build_manifest(docs, ["doc_id", "source", "text"], "source", "doc_id", {"low": merkle.leaf_of([F.col("doc_id"), F.col("source"), F.lower("text")])}, levels)
    want = plain_manifest([(n, s, (n, s, t)) for n, s, t in rows])
    got = merkle.prove(manifest, claim="low", siblings=True).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r.number, r.leaf, r.subroot, r.root) for r in got], key=key) == sorted([w[:4] for w in want], key=key)
    proofs = {w[1]: w[4] for w in want}
    for r in got:
        assert [list(x) for x in r.siblings] == proofs[r.leaf] or rows.count((r.number, "é", "Ü")) == 2
        assert r.proof_sha256 == h("".join(x for run in r.siblings for x in run))
    assert manifest.root() == want[0][3]
    assert {r.verified for r in got} == {True, False}
    lower = {w[1] for w in plain_manifest([(n, s, (n, s, t and t.lower())) for n, s, t in rows])}
    assert all(r.verified == (r.folded_root == r.root) == (r.leaf in lower) for r in got)


def test_part_of_the_leaves(spark):
    rows = manifest_rows(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    manifest = merkle.build_manifest(docs, ["doc_id", "source", "text"], "source", "doc_id", levels=1)
    whole = {(r.number, r.leaf): r.proof_sha256 for r in merkle.prove(manifest).collect()}
    wanted = manifest.leaves.where("number % 37 = 5")
    asked = merkle.fetched(manifest, wanted)
    assert asked.count() == asked.select("part", "tree", "sid", "level", "idx").distinct().count()
    got = merkle.prove(manifest, wanted).collect()
    assert len(got) == wanted.count() > 10
    assert all(r.verified and whole[r.number, r.leaf] == r.proof_sha256 for r in got)


def test_coordinates_are_the_fewest():
    every = merkle.missing(0, 1, list(range(40)), 40)
    assert every == []
    assert merkle.missing(0, 1, [0], 1) == []
    one = merkle.missing(0, 1, [17], 40)
    assert sorted(one) == sorted([(0, 1, 0, k) for k in range(16, 32) if k != 17] + [(0, 1, 1, 0), (0, 1, 1, 2)])
    assert len(merkle.missing(0, 1, [17, 18, 39], 40)) == 14 + 7 + 1


def test_small_manifests(spark, none):
    columns = ["doc_id", "source", "n_chars", "text"]
    manifest = merkle.build_manifest(none, columns, "source", "doc_id")
    assert manifest.root() is None and merkle.prove(manifest).count() == 0
    one = spark.createDataFrame([(1, None, None, None)], none.schema)
    manifest = merkle.build_manifest(one, columns, "source", "doc_id")
    row = merkle.prove(manifest).first()
    assert row.leaf == row.subroot == row.root == manifest.root() == h("1:1---") and row.proof_sha256 == h("") and row.verified


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert QUERIES["op13_merkle_multiproof"](spark, sf).count() == QUERIES["op12_heavy_hitters"](spark, sf).count() == docs.count()
    assert QUERIES["op11_prefix_collapse"](spark, sf).count() > 0
