"""Secret scan with one combined deterministic automaton.

All rule expressions are compiled into one minimal automaton (see ``automaton``) that reads a text's bytes once, from right
to left, and marks every position where a match of some rule begins. Matches are then read off from left to right: at the
leftmost mark of a rule its own anchored automaton gives the longest match, and the search goes on behind it. That gives
the leftmost non-overlapping matches of each rule. What a rule's ``goes_on`` adds to a match does not change where matches
begin, so only the anchored automaton knows it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.automaton import Walker, compile_rules, marks
from lossloom.llm.common import byte_batches, byte_column, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``expression`` is what a match is; ``consumes``, if given, is a wider expression whose matches use up text even if
    they are too short to count; what matches ``goes_on`` right behind a match belongs to it."""

    kind: str
    expression: str
    consumes: str | None = None
    either_case: bool = False
    goes_on: str | None = None


_VALUE = "[A-Za-z0-9+/_.=\\-]"
_ASSIGN = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
BASE_RULES = (
    Rule("assign", f"{_ASSIGN}{_VALUE}{{6,}}", f"{_ASSIGN}{_VALUE}+", either_case=True),
    # a too short match uses up its whole run of characters, in which no other match could begin that is long enough
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
_BREAK = "([\\x20\t\r\n\"'#>*,;|]|\\\\[nrt]?)+"  # between the lines of a key: line ends, also escaped, quotes and comment marks
_BASE64 = "[A-Za-z0-9+/]"
_KEY_LINES = f"{_BREAK}{_BASE64}{{16,}}({_BREAK}{_BASE64}{{16,}})*(={{1,2}}|{_BREAK}{_BASE64}{{1,15}}={{0,2}})?"
#: All up to the END line; without one, the header fields and the base64 lines, of which the last may be short.
_KEY_BODY = f"((-{{0,4}}[\\x00-,.-\\xff])*-----END ([A-Z]+ )*PRIVATE KEY-----|({_BREAK}[A-Za-z-]+:\\x20[\\x20-\\x7e]*)*{_KEY_LINES})"
MORE_RULES = (
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", goes_on=_KEY_BODY),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{20,}", "gh[pousr]_[A-Za-z0-9]+"),
    Rule("chat_bot", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]+"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("map_key", "AIza[A-Za-z0-9_-]{30,}", "AIza[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
_COMPILED: dict[tuple, tuple] = {}


def compiled(rules: tuple[Rule, ...]):
    """The combined automaton and a walker for each rule, once per Python worker."""
    if rules not in _COMPILED:
        combined = compile_rules([(r.consumes or r.expression, r.either_case) for r in rules], search=True, backward=True)
        walkers = []
        for r in rules:
            wide = [(r.consumes, r.either_case)] if r.consumes else []
            whole = f"({r.expression})({r.goes_on})?" if r.goes_on else r.expression
            walkers.append((Walker(compile_rules([(whole, r.either_case), *wide])), r.kind))
        _COMPILED[rules] = (combined, walkers)
    return _COMPILED[rules]


def spans_of_rows(raw: np.ndarray, at: np.ndarray, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int, str]]]:
    """Row number to its matches (start, rule number, end, kind) in code points, by start, then in the order of the rules."""
    combined, walkers = compiled(rules)
    where, masks = marks(combined, raw, at)
    rows = np.searchsorted(at, where, side="right") - 1
    found: dict[int, list] = {}
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for places, bits in zip(np.split(where, cuts), np.split(masks, cuts)):
        if not len(places):
            continue
        row = int(np.searchsorted(at, places[0], side="right")) - 1
        base = int(at[row])
        data = raw[base : at[row + 1]]
        text, points = data.tobytes(), None
        for k, (walker, kind) in enumerate(walkers):
            free = 0
            for start in (places[(bits >> k) & 1 == 1] - base).tolist():
                if start < free:
                    continue
                free, rule_bits = walker.longest(text, start)
                if rule_bits & 1:
                    if points is None:
                        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    found.setdefault(row, []).append((int(points[start]), k, int(points[free]), kind))
        if row in found:
            found[row].sort()
    return found


SPANS = "array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every row of docs (doc_id, text).

    One row per input row, with an empty list where nothing is found or the text is null or empty; null and repeated
    doc_ids stay as they are; other columns are ignored.
    """

    def find(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", 2_000_000):
            raw, at = byte_column(batch, "text")
            found = spans_of_rows(raw, at, rules)
            lists = [[{"kind": s[3], "start": s[0], "end": s[2]} for s in found.get(r, ())] for r in range(batch.num_rows)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(lists, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(find, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every found span replaced by ``<kind>``; spans that overlap become one. Other texts and columns stay.

    ``n_chars``, where it is a column, is set to the new length of a changed text.
    """
    names = docs.columns

    def clean(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", 2_000_000):
            place = batch.schema.get_field_index("text")
            raw, at = byte_column(batch, "text")
            found = spans_of_rows(raw, at, rules)
            if found:
                texts = batch.column(place).to_pylist()
                sizes = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
                for row, spans in found.items():
                    text, parts, free = texts[row], [], 0
                    for start, _, end, kind in spans:
                        if start >= free:
                            parts += [text[free:start], f"<{kind}>"]
                        free = max(free, end)
                    texts[row] = "".join(parts) + text[free:]
                    if sizes:
                        sizes[row] = len(texts[row])
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                if sizes:
                    k = names.index("n_chars")
                    columns[k] = pa.array(sizes, batch.schema.field(k).type)
                batch = pa.record_batch(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, docs.schema)
