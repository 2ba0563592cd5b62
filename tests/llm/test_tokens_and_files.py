import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossloom.llm.edit_counts import CountedText, apply_edits, count_trees
from lossloom.llm.packing import assign, cut, pack, plan_packs, sequences
from lossloom.llm.token_frames import FrameFile, FrameWriter, file_system, read_token_frames, write_token_frames
from lossloom.llm.tokens import END_ID, default_vocabulary, encoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


PARTS = [
    "a", "B", "É", "é", "J̌", ".", ",", "'s", "'T", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\xa0", "\x1c", "ß", "İ", "Σ", "1",
    "23", "|", "#", "日本", "don", "%%", '"', "ſ", "́", "-", "_", "word ", "  ",
]


def test_pieces_give_the_ids_of_the_whole_text(tokenizer):
    pick, own = random.Random(1), encoder(default_vocabulary(), 200)
    for _ in range(4000):
        text = "".join(pick.choices(PARTS, k=pick.randint(0, 15)))
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == ids_of(tokenizer, text)


def test_frames_are_decoded_one_by_one(tmp_path):
    import zstandard

    pick = random.Random(2)
    docs = [np.array([pick.randrange(50_000) for _ in range(pick.choice([1, 5, 300, 5000]))], "<u4").tobytes() for _ in range(60)]
    writer = FrameWriter(frame_bytes=4096)
    for k, ids in enumerate(docs):
        writer.add(k if k else None, ids)
    raw = writer.finish()
    path = tmp_path / "x.zst"
    path.write_bytes(raw)
    with zstandard.open(path, "rb") as plain:  # any reader can decode the whole
        assert plain.read(-1)[: len(docs[0])] == docs[0]
    fs, at = file_system(str(path))
    file = FrameFile(fs.open_input_file(at))
    assert len(file.entries) > 10
    found = list(zip(*(file.docs.column(k).to_pylist() for k in range(3))))
    assert [d for d, _, _ in found] == [None, *range(1, 60)]
    for k in (17, 3, 59):
        assert file.ids(found[k][1], found[k][2]) == docs[k]
    wrong = bytearray(raw)
    wrong[20] ^= 255
    path.write_bytes(bytes(wrong))
    with pytest.raises(Exception):
        bad = FrameFile(fs.open_input_file(at))
        for _, first, n in found:
            bad.ids(first, n)


def test_token_files_round_trip(spark, awkward, none, tokenizer, tmp_path):
    manifest = write_token_frames(awkward, f"{tmp_path}/ids", shard_bytes=4000, frame_bytes=512)
    assert manifest.count() > 1
    rows = read_token_frames(manifest).orderBy("start").collect()
    docs = sorted(awkward.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start = 0
    for row, doc in zip(rows, docs, strict=True):
        ids = ids_of(tokenizer, doc["text"]) + [END_ID]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc["doc_id"], start, len(ids))
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        start += len(ids)
    some = read_token_frames(manifest, spark.createDataFrame([(7,), (9,), (None,), (99,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 7, 9]
    assert {(r["doc_id"], r["start"]) for r in some} <= {(r["doc_id"], r["start"]) for r in rows}
    assert read_token_frames(write_token_frames(none, f"{tmp_path}/none")).count() == 0


def test_plan_places_every_piece_once():
    pick = random.Random(3)
    for _ in range(30):
        size = pick.choice([8, 64])
        lengths = {k: pick.choice([1, 2, 7, 100]) for k in pick.sample(range(1, size + 1), pick.randint(1, size))}
        plan = plan_packs(lengths, size)
        used = {}
        for length, n in lengths.items():
            first, copies, base, at = plan.blocks[length]
            for rank in range(n):
                k = np.searchsorted(first, rank, side="right") - 1
                inner = rank - first[k]
                used.setdefault(int(base[k] + inner // copies[k]), []).append((int(at[k] + inner % copies[k] * length), length))
        assert sorted(used) == list(range(plan.sequences))
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= size
        total = sum(k * n for k, n in lengths.items())
        assert plan.sequences >= -(-total // size)


def test_packing(spark, awkward, none, tokenizer):
    rows = pack(awkward, max_tokens=64).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r["doc_id"], []).append(ids_of(tokenizer, r["text"]) + [END_ID])
    assert sum(r["length"] for r in rows) == sum(len(i) for ids in texts.values() for i in ids)
    for r in rows:
        crcs = {zlib.crc32(np.array(i[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for i in texts[r["doc_id"]]}
        assert r["ids_crc32"] in crcs
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0, *(n for _, n in sorted(places))])[:-1])
    assert pack(none).count() == 0


def test_salted_ranks_and_padded_sequences(spark, tokenizer):
    docs = spark.createDataFrame([(k, "the same text here") for k in range(500)] + [(900, "other " * 30)], "doc_id long, text string")
    pieces = cut(docs, 16).cache()
    places = assign(pieces.drop("ids").withColumns({"_rank": F.lit(1), "_base": F.lit(2), "_salt": F.lit(3)}), 16)
    assert places.select("sequence_id", "offset").distinct().count() == pieces.count()
    packed = sequences(pieces, places, 16).collect()
    for r in packed:
        n = r["n_ids"]
        assert len(r["ids"]) // 4 == (n if n & (n - 1) == 0 else 16)
    kept = sorted(np.concatenate([np.frombuffer(r["ids"], "<u4")[: r["n_ids"]] for r in packed]).tolist())
    assert kept == sorted(i for r in docs.collect() for i in ids_of(tokenizer, r["text"]) + [END_ID])


def test_counts_follow_edits(tokenizer):
    pick, own = random.Random(4), encoder(default_vocabulary())
    count = lambda text: len(own.ids(text.encode())) // 4
    for _ in range(60):
        text = "".join(pick.choices(PARTS, k=pick.randint(0, 300)))
        tree = CountedText(text, count, pick.choice([1, 5, 30, 400]))
        for _ in range(pick.randint(0, 15)):
            at, remove = pick.randint(0, len(text) + 3), pick.choice([0, 1, 3, 20, 200])
            insert = "".join(pick.choices(PARTS, k=pick.choice([0, 1, 3, 40])))
            text = text[:at] + insert + text[at + remove :]
            tree.edit(at, remove, insert)
            assert tree.text() == text and tree.n_tokens == len(ids_of(tokenizer, text))
            tree = CountedText(text, count, tree.leaf_chars, tree.state())


def test_leaves_without_blanks(tokenizer):
    count = encoder(default_vocabulary()).ids
    tree = CountedText("a1b2c3d4e5" * 5000, lambda t: len(count(t.encode())) // 4)
    tree.edit(20_000, 1, "x")
    assert tree.encoded < 2000 and tree.n_tokens == len(tokenizer.encode(tree.text(), add_special_tokens=False).ids)
    pick = random.Random(19)
    for _ in range(600):  # more leaves than places, again and again
        tree.edit(pick.choice([7, pick.randrange(50_000)]), 0, "some more words to be put in here, " * 20)
    assert tree.n_tokens == len(tokenizer.encode(tree.text(), add_special_tokens=False).ids)


def test_edits_of_a_table(spark, awkward, none, tokenizer):
    edits = spark.createDataFrame(
        [(1, 2, 0, 4, "Those "), (1, 1, 3, 0, "X"), (7, 1, None, None, None), (8, 1, 1 << 40, 5, " end"), (9, 1, 100_000, 3, "new"), (None, 1, 0, 1, "y"), (77, 1, 0, 1, "z")],
        "doc_id long, edit_no int, at long, remove int, insert string",
    )
    rows = apply_edits(count_trees(awkward), edits).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["n_tokens"] == len(ids_of(tokenizer, r["text"]))
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["text"] == "Those " + "TheX same words stand here once more and again."[4:] and one["n_edits"] == 2
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert nine["n_encoded"] < 2000 < len(nine["text"])
    assert apply_edits(count_trees(none), edits).count() == 0
