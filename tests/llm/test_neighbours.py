import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from lossloom.llm.graph import components
from lossloom.llm.hamming_minhash import CHUNKS, SYMBOLS, deduplicate, masked_keys, near_duplicates
from lossloom.llm.sphere_caps import CODES, ProductCode, codes_for, similar_vectors, words_of

SF = "/root/testdata/sf0.01"


def joined(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    pick = random.Random(11)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 560)]
    frame = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = joined({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for n in nodes}
    assert components(frame.limit(0)).count() == 0


def test_masked_keys_keep_the_promise():
    rng = np.random.default_rng(12)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, SYMBOLS).astype("<u2")
        b = a.copy()
        b[rng.choice(SYMBOLS, 2 * CHUNKS - 1, replace=False)] ^= 1
        keys = masked_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def plain_components(frame, words, percent=80):
    sets = {}
    for doc, text in frame:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set()
    places = defaultdict(list)
    for doc, own in sets.items():
        for s in own:
            places[s].append(doc)
    links = []
    for doc, own in sets.items():
        for other, n in Counter(o for s in own for o in places[s] if o > doc).items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                links.append((doc, other))
    return {d: (len(s), joined(sets, links)[d]) for d, s in sets.items()} if len(sets) < 50 else (sets, joined(sets, links))


def test_near_duplicates_of_the_documents(spark):
    frame = pd.read_parquet(f"{SF}/documents.parquet")
    sets, want = plain_components(list(zip(frame.doc_id, frame.text)), 4)
    rows = near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), words=4).collect()
    assert len(rows) == len(frame)
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_chains_and_awkward_rows(spark, awkward, none):
    base = [f"w{k}" for k in range(200)]
    chain = []
    for k in range(12):  # each differs from the one before in a few words, the ends from one another in many
        words = list(base)
        for j in range(k):
            for i in range(3):
                words[(j * 16 + i * 5) % 200] = f"x{j}{i}"
        chain.append((100 - k, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), words=5).collect()
    want = plain_components(chain, 5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[1] == {(1, True)} and by[2] == {(1, False)} and by[7] == {(6, False)} and by[None] == {(None, True)}
    assert by[3] == {(3, True)} and by[8] == {(8, True)} and by[10] == {(9, False)}
    kept = deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 8, 9, 11]
    assert near_duplicates(none).count() == 0 and deduplicate(none).count() == 0


def test_rows_that_share_a_doc_id(spark):
    """Decisions fall for rows, so a clash of ids takes no other document along."""
    pick = random.Random(21)

    def text():
        return " ".join(pick.choices([f"w{k}" for k in range(3000)], k=40))

    a, b, c, d = (text() for _ in range(4))
    near_a = a.rsplit(" ", 1)[0] + " end"
    rows = [(8, a), (8, b), (8, b), (5, near_a), (9, c), (12, c), (12, d), (3, ""), (3, ""), (None, a)]
    kept = sorted(((r["doc_id"] or 0), r["text"]) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([(8, b), (5, near_a), (9, c), (12, d), (3, ""), (0, a)])


def test_similar_vectors(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((600, 24))
    x[100:160] = x[0] + 0.12 * rng.standard_normal((60, 24))
    x[200:260] = x[1:61] + 0.05 * rng.standard_normal((60, 24))
    x[300:320] = x[5]
    rows = [(k, [float(v) for v in np.float32(r)], 1) for k, r in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] + [1.0] * 23), (1004, [None] + [1.0] * 23), (1005, [float("inf")] * 24), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    odd += [(None, rows[5][1]), (None, None)]
    frame = spark.createDataFrame([*rows, *((*o, 2) for o in odd)], "vec_id long, embedding array<double>, node long")
    unit = np.float32(x).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = joined(range(600), np.argwhere(near).tolist())
    for block in (1024, 7):
        got = {r["vec_id"]: r for r in similar_vectors(frame, block=block).where("vec_id is not null").collect()}
        found = sum(got[k]["n_links"] for k in range(600))
        assert 0.98 * near.sum() <= found <= near.sum()
        assert all(got[k]["n_links"] <= near[k].sum() for k in range(600))
        assert sum(got[k]["component_id"] == want[k] for k in range(600)) >= 594
        for k in range(1000, 1006):
            assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
        assert (got[1007]["n_links"], got[1007]["component_id"]) == (1, 1006)
    lone = similar_vectors(frame).where("vec_id is null").collect()
    assert len(lone) == 2 and all(r["kept"] and r["n_links"] == 0 for r in lone)
    assert similar_vectors(frame.limit(0)).count() == 0


def test_codes_grow_with_the_vectors():
    rng = np.random.default_rng(14)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((600, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    used = []
    for vectors in (2_000, 2_000_000):
        words = words_of(vectors)
        codes = codes_for([64], words)
        used.append(codes)
        open_ = np.arange(600)  # the pairs that no code has found
        for k in range(codes):
            code = ProductCode(64, words, 2, k)
            open_ = open_[[not len(np.intersect1d(a, b)) for a, b in zip(code.filters(x[open_]), code.filters(y[open_]))]] if len(open_) else open_
        assert len(open_) <= 3  # one in a thousand are expected at most; 16 codes leave about 1 in 100 of two million
    assert CODES <= used[0] < used[1]
