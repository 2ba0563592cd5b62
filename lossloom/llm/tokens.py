"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
from array import array

END_ID = 1  # closes every document
_TAIL = b".,;:!?|*#%&$"  # never part of a contraction, so a word before it ends there
_KEEP_CASE = (b"<|", b"\xcc", b"\xcd")  # a special token's name; combining marks, which are joined to letters before case is dropped
_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memory(dict):
    """Ids of pieces between white space, as little-endian unsigned 32-bit; when it is full, new pieces are not kept."""

    def __init__(self, tokenizer, limit: int):
        self.tokenizer, self.limit = tokenizer, limit

    def __missing__(self, piece: bytes) -> bytes:
        core = piece.rstrip(_TAIL)
        if core and core != piece and (core[-1:].isalpha() or core[-1] > 127 and core.decode("utf-8", "replace")[-1].lower()[-1].isalpha()):
            return self[core] + self[piece[len(core) :]]
        ids = array("I", self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(self) < self.limit:
            self[piece] = ids
        return ids


class WordEncoder:
    """Encodes a text piece by piece.

    For vocabularies that drop white space and ignore case (as ``word_bpe_49k.json`` does) the ids of a text are those of
    its pieces between ASCII white space, one after another. Pieces met before are looked up; a word with closing
    punctuation is two pieces. The memory holds at most ``limit`` pieces, which bounds a worker's size.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.get = _Memory(Tokenizer.from_file(path), limit).__getitem__

    def ids(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(sign in text for sign in _KEEP_CASE):
            text = text.lower()  # ASCII letters only; the tokenizer would do the same
        return b"".join(map(self.get, text.split()))


def encoder(path: str, limit: int = 500_000) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = WordEncoder(path, limit)
    return _ENCODERS[path, limit]


def texts_of(batch, name: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as bytes, nulls as empty."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).cast(pa.large_binary())
    return col.fill_null(b"").to_pylist()
