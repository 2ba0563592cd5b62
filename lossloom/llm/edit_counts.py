"""Token counts that follow edits.

Every document keeps a segment tree over runs of pre-tokens: leaves are stretches of text cut behind white space or behind a
digit, with their lengths and token counts; inner nodes hold sums. An edit finds its leaves by descending on lengths; only
those leaves, with the boundary leaf that holds the character behind the edit, are cut and encoded anew, and the sums above
them are updated. The tokenizer drops white space and makes every digit a pre-token, whatever follows, so the total is that
of the whole edited text. A stretch without either, as a long run of letters, is one pre-token and stays one leaf.

A place of the tree holds a few leaves: what an edit makes beyond the places it had goes into the first of them. Only when a
place holds more than about the square root of all leaves is the tree laid out anew.
"""

from __future__ import annotations

import re
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import byte_batches, text_or_empty
from lossloom.llm.tokens import default_vocabulary, encoder

LEAF_CHARS = 400
_CUT = re.compile(r"[ \t\n\r\x0b\x0c](?![ \t\n\r\x0b\x0c])|[0-9]")


def cut_leaves(text: str, chars: int) -> list[str]:
    """Stretches of at least ``chars`` characters (the last may be shorter), each but the last ending behind white space or a digit."""
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + chars - 1) if at + chars < len(text) else None
        end = found.end() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Leaves of one document with sums of lengths and tokens; node 1 is the root, places begin at ``size``."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.most = max(32, 2 * isqrt(len(leaves)))  # leaves that a place may hold
        rest = self.size - len(leaves)
        self.places = [[x] for x in zip(leaves, tokens)] + [[] for _ in range(rest)]
        self.chars = [0] * self.size + [len(x) for x in leaves] + [0] * rest
        self.tokens = [0] * self.size + list(tokens) + [0] * rest
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def all(self) -> list[tuple[str, int]]:
        return [leaf for place in self.places for leaf in place]

    def find(self, at: int) -> tuple[int, int, int]:
        """Place, leaf in it and character in that for the character ``at``; the last leaf and its end beyond the text."""
        beyond = at >= self.chars[1]
        at = max(0, self.chars[1] - 1) if beyond else at
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node]:
                at -= self.chars[node]
                node += 1
        place, k = node - self.size, 0
        leaves = self.places[place]
        while k + 1 < len(leaves) and at >= len(leaves[k][0]):
            at -= len(leaves[k][0])
            k += 1
        return place, k, len(leaves[k][0]) if beyond and leaves else at

    def replace(self, first: int, last: int, leaves: list[tuple[str, int]]) -> bool:
        """Put leaves in the places first..last, one in each and what is over in the first, and update the sums above them.
        False if a place holds too many now."""
        over = max(0, len(leaves) - (last - first))
        parents = set()
        for k in range(first, last + 1):
            self.places[k] = leaves[:over] if k == first else leaves[over + k - first - 1 : over + k - first]
            self.chars[self.size + k] = sum(len(x) for x, _ in self.places[k])
            self.tokens[self.size + k] = sum(n for _, n in self.places[k])
            parents.add((self.size + k) // 2)
        while parents and 0 not in parents:
            for node in parents:
                self._sum(node)
            parents = {node // 2 for node in parents}
        return over <= self.most


class CountedText:
    """One document under edits."""

    def __init__(self, text: str, count, leaf_chars: int = LEAF_CHARS, state: tuple[list[int], list[int]] | None = None):
        self.count, self.leaf_chars, self.encoded = count, leaf_chars, 0
        if state is None:
            leaves = cut_leaves(text, leaf_chars)
            tokens = [count(x) for x in leaves]
        else:
            ends = np.cumsum(state[0]).tolist()
            leaves, tokens = [text[a:b] for a, b in zip([0, *ends], ends)], list(state[1])
        self.tree = SegmentTree(leaves, tokens)

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens[1]

    def state(self) -> tuple[list[int], list[int]]:
        """Lengths and tokens of the leaves in use, from which the tree is put together again."""
        used = self.tree.all()
        return [len(x) for x, _ in used], [n for _, n in used]

    def text(self) -> str:
        return "".join(x for x, _ in self.tree.all())

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Remove characters and insert text at a place; places beyond the text count as its end."""
        tree = self.tree
        at = min(max(0, at), tree.chars[1])
        remove = min(max(0, remove), tree.chars[1] - at)
        first, i, inside = tree.find(at)
        last, j, behind = tree.find(at + remove)
        left, right = tree.places[first], tree.places[last]
        region = (left[i][0][:inside] if left else "") + insert + (right[j][0][behind:] if right else "")
        parts = cut_leaves(region, self.leaf_chars)
        self.encoded += len(region)
        if not tree.replace(first, last, left[:i] + [(x, self.count(x)) for x in parts] + right[j + 1 :]):
            leaves = tree.all()  # laid out anew; nothing is encoded for that
            self.tree = SegmentTree([x for x, _ in leaves], [n for _, n in leaves])


def _counter(vocabulary: str):
    ids = encoder(vocabulary).ids
    return lambda text: len(ids(text.encode("utf-8", "replace"))) // 4


def count_trees(docs: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs (doc_id, text) with their trees: doc_id, text, leaf_chars and leaf_tokens (arrays), n_tokens.

    Null texts count as empty and have no leaves; other columns are ignored. The result can be stored and edited later.
    """
    vocabulary = vocabulary or default_vocabulary()

    def rows(batches):
        import pyarrow as pa

        count = _counter(vocabulary)
        for batch in byte_batches(batches, "text"):
            texts = [CountedText(t, count, leaf_chars) for t in batch.column(1).to_pylist()]
            states = [t.state() for t in texts]
            kind = pa.list_(pa.int32())
            columns = [pa.array([s[k] for s in states], kind) for k in (0, 1)]
            total = pa.array([t.n_tokens for t in texts], pa.int64())
            yield pa.record_batch([*batch.columns, *columns, total], ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return named.mapInArrow(rows, "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Trees after edits: the columns of ``count_trees`` plus n_before, n_edits and n_encoded (characters encoded anew).

    edits has doc_id, edit_no, at, remove (code points) and insert; a document's edits apply one after another in the order of
    edit_no (ties by the other columns), each to the text that the one before left. Nulls in an edit count as 0 or empty;
    edits without a document or a doc_id are ignored; documents without edits stay; each row of a repeated doc_id is edited.
    """
    vocabulary = vocabulary or default_vocabulary()
    one = F.struct("edit_no", F.coalesce("at", F.lit(0)).cast("long").alias("at"), F.coalesce("remove", F.lit(0)).cast("long").alias("remove"), F.coalesce("insert", F.lit("")).alias("insert"))
    listed = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("edits"))
    both = trees.join(listed, "doc_id", "left").select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")

    def rows(batches):
        import pyarrow as pa

        count = _counter(vocabulary)
        names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_before", "n_edits", "n_encoded"]
        types = [pa.int64(), pa.large_string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 4
        for batch in byte_batches(batches, "text"):
            out = []
            for doc_id, text, chars, tokens, changes in zip(*(c.to_pylist() for c in batch.columns)):
                own = CountedText(text, count, leaf_chars, (chars, tokens))
                before = own.n_tokens
                for change in changes or ():
                    own.edit(change["at"], change["remove"], change["insert"])
                out.append((doc_id, own.text(), *own.state(), own.n_tokens, before, len(changes or ()), own.encoded))
            yield pa.record_batch([pa.array(c, t).cast(pa.string() if t == pa.large_string() else t) for c, t in zip(zip(*out), types)], names)

    schema = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_before long, n_edits long, n_encoded long"
    return both.mapInArrow(rows, schema)
