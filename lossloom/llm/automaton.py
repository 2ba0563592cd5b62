"""Rule expressions compiled to deterministic automata over bytes.

``compile_rules`` turns a list of expressions into one automaton by subset construction and partition refinement. The
supported syntax is concatenation, ``|``, groups, classes, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``; a class or literal
matches ASCII characters only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_REPEAT = {"?": (0, 1), "*": (0, None), "+": (1, None)}


class _Parser:
    """Expression to a tree: ('set', frozenset), ('cat', [..]), ('alt', [..]), ('rep', tree, least, most)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def alternatives(self):
        found = [self.sequence()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            found.append(self.repeated())
        return ("cat", found)

    def repeated(self):
        tree = self.atom()
        while self.at < len(self.text) and self.text[self.at] in "?*+{":
            sign = self.text[self.at]
            if sign == "{":
                close = self.text.index("}", self.at)
                least, comma, most = self.text[self.at + 1 : close].partition(",")
                bounds = (int(least), int(most) if most else None if comma else int(least))
                self.at = close + 1
            else:
                bounds, self.at = _REPEAT[sign], self.at + 1
            tree = ("rep", tree, *bounds)
        return tree

    def atom(self):
        sign = self.text[self.at]
        if sign == "(":
            self.at += 1
            tree = self.alternatives()
            self.at += 1
            return tree
        if sign == "[":
            self.at += 1
            chars: set[int] = set()
            while self.text[self.at] != "]":
                low = self.char()
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    chars |= set(range(low, self.char() + 1))
                else:
                    chars.add(low)
            self.at += 1
            return ("set", frozenset(chars))
        return ("set", frozenset([self.char()]))

    def char(self) -> int:
        if self.text[self.at] == "\\":
            if self.text[self.at + 1] == "x":
                self.at += 4
                return int(self.text[self.at - 2 : self.at], 16)
            self.at += 1
        self.at += 1
        return ord(self.text[self.at - 1])


def _either_case(tree):
    kind = tree[0]
    if kind == "set":
        letters = {c ^ 32 for c in tree[1] if chr(c).isascii() and chr(c).isalpha()}
        return ("set", tree[1] | letters)
    if kind == "rep":
        return ("rep", _either_case(tree[1]), *tree[2:])
    return (kind, [_either_case(t) for t in tree[1]])


def _reversed(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    parts = [_reversed(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def build(self, tree, start: int) -> int:
        """Adds the tree after ``start``; returns its end state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.build(part, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, waiting = set(states), list(states)
        while waiting:
            for nxt in self.empty[waiting.pop()]:
                if nxt not in found:
                    found.add(nxt)
                    waiting.append(nxt)
        return frozenset(found)


@dataclass
class Automaton:
    """``step[state * classes + byte_class[byte]]`` is the next state times ``classes``; ``accept[state]`` a bit per rule.

    State 0 is the start; states from ``first_accepting`` on accept. ``dead`` is the state that nothing leaves, or -1.
    """

    byte_class: np.ndarray
    step: np.ndarray
    accept: np.ndarray
    classes: int
    first_accepting: int
    dead: int


def compile_rules(rules: list[tuple[str, bool]], search: bool = False, backward: bool = False) -> Automaton:
    """One automaton for (expression, either case) rules; ``search`` lets a match begin anywhere, ``backward`` reads from the right."""
    nfa = _Nfa()
    start = nfa.state()
    ends: dict[int, int] = {}
    for k, (text, either) in enumerate(rules):
        tree = _Parser(text).alternatives()
        tree = _either_case(tree) if either else tree
        ends[nfa.build(_reversed(tree) if backward else tree, start)] = 1 << k
    sets = {chars for steps in nfa.steps for chars, _ in steps}
    kinds: dict[tuple, int] = {}
    byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = {int(c): b for b, c in reversed(list(enumerate(byte_class)))}
    classes = len(kinds)

    first = nfa.closure([start])
    number, table, accept, waiting = {first: 0}, [], [], [first]
    for states in waiting:
        accept.append(sum({ends[s] for s in states if s in ends}))
        row = []
        for c in range(classes):
            after = {nxt for s in states for chars, nxt in nfa.steps[s] if sample[c] in chars}
            target = nfa.closure(after | {start} if search else after)
            if target not in number:
                number[target] = len(number)
                waiting.append(target)
            row.append(number[target])
        table.append(row)
    return _minimal(np.array(table), np.array(accept, np.int64), byte_class, classes)


def _minimal(table: np.ndarray, accept: np.ndarray, byte_class: np.ndarray, classes: int) -> Automaton:
    """States with equal acceptance and equal behaviour become one; accepting states get the highest numbers."""
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    _, one = np.unique(block, return_index=True)
    start, accepts = block[0], accept[one] != 0
    order = sorted(range(len(one)), key=lambda b: (accepts[b], b != start, b))
    if accepts[start]:
        raise ValueError("a rule matches the empty text")
    new = np.empty(len(one), np.int64)
    new[order] = np.arange(len(one))
    rows = new[block[table[one]]][order]
    masks = accept[one][order]
    dead = [s for s in range(len(rows)) if masks[s] == 0 and (rows[s] == s).all()]
    return Automaton(byte_class, (rows * classes).astype(np.int32).ravel(), masks, classes, int((masks == 0).sum()), dead[0] if dead else -1)


PIECE = 4096  # bytes of a piece of a row; pieces are walked side by side, so a step serves all of them


def marks(auto: Automaton, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass from right to left over all rows at once: positions where the automaton accepts, and the rules' bits.

    Rows are cut into pieces that are walked in step, so that each step moves all of them and a long text takes no more steps
    than a short one. A piece is first walked as if a row ended at its right end. Where the piece to its right ends in another
    state, it is walked anew from that, until both walks are in one state.
    """
    parts = np.maximum(1, -(-np.diff(at) // PIECE))
    last = np.cumsum(parts) - 1  # the rightmost piece of each row
    first = last - parts + 1
    inside = np.arange(int(parts.sum())) - np.repeat(first, parts)
    left = np.repeat(at[:-1], parts) + inside * PIECE
    right = np.minimum(left + PIECE, np.repeat(at[1:], parts))
    classes_of = auto.byte_class[raw]
    begun = np.zeros(len(left), np.int32)  # the state in which each piece was walked
    where, bits, ended = _walk(auto, classes_of, left, right, begun)
    true = begun.copy()
    true[:-1] = np.where(inside[1:] > 0, ended[1:], 0)
    todo = np.flatnonzero(true != begun)
    while len(todo):
        met, new_where, new_bits, after = _rewalk(auto, classes_of, left[todo], right[todo], begun[todo], true[todo])
        limit = right.copy()
        limit[todo] = met  # from here on to the right the new walk counts
        piece = np.searchsorted(left, where, side="right") - 1
        kept = where < limit[piece]
        where, bits = np.concatenate([where[kept], new_where]), np.concatenate([bits[kept], new_bits])
        begun[todo] = true[todo]
        changed = (after >= 0) & (inside[todo] > 0)  # walked anew to the left end: the next piece begins otherwise
        true[todo[changed] - 1] = after[changed]
        todo = np.flatnonzero(true != begun)
    order = np.argsort(where, kind="stable")
    return where[order], bits[order]


def _walk(auto: Automaton, classes_of: np.ndarray, left: np.ndarray, right: np.ndarray, begun: np.ndarray):
    """Accepting places and their bits of all pieces, walked side by side from right to left, and the states at the left ends."""
    sizes = right - left
    order = np.argsort(-sizes, kind="stable")
    where, state = right[order] - 1, begun[order].copy()
    bar = auto.first_accepting * auto.classes
    found, bits = [], []
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if len(sizes) else 1), side="right")
    for n in active.tolist():
        here, now = where[:n], state[:n]
        now += classes_of[here]
        now[:] = auto.step[now]
        if now.max() >= bar:
            hit = np.flatnonzero(now >= bar)
            found.append(here[hit])
            bits.append(auto.accept[now[hit] // auto.classes])
        here -= 1
    ended = np.empty_like(state)
    ended[order] = state
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *bits]), ended


def _rewalk(auto: Automaton, classes_of: np.ndarray, left: np.ndarray, right: np.ndarray, old: np.ndarray, new: np.ndarray):
    """Walk pieces from another state until both walks meet: where they met (the leftmost place walked anew), the accepting
    places of the new walk and their bits, and its state at the left end, or -1 where the walks met before."""
    met, after = left.copy(), np.full(len(left), -1, np.int64)
    rows, where = np.arange(len(left)), right - 1
    old, new = old.copy(), new.copy()
    bar = auto.first_accepting * auto.classes
    found, bits = [], []
    while len(rows):
        old, new = auto.step[old + classes_of[where]], auto.step[new + classes_of[where]]
        hit = np.flatnonzero(new >= bar)
        found.append(where[hit])
        bits.append(auto.accept[new[hit] // auto.classes])
        same, done = old == new, where == left[rows]
        met[rows[same]] = where[same]
        after[rows[done & ~same]] = new[done & ~same]
        go = ~(same | done)
        rows, where, old, new = rows[go], where[go] - 1, old[go], new[go]
    none = np.zeros(0, np.int64)
    return met, np.concatenate([none, *found]), np.concatenate([none, *bits]), after


class Walker:
    """Longest matches of an anchored automaton."""

    def __init__(self, auto: Automaton):
        self.step, self.byte_class, self.accept = auto.step.tolist(), auto.byte_class.tolist(), auto.accept.tolist()
        self.classes, self.dead = auto.classes, auto.dead * auto.classes

    def longest(self, data: bytes, start: int) -> tuple[int, int]:
        """End and rule bits of the longest match that begins at ``start``; (-1, 0) without one."""
        state, end, bits = 0, -1, 0
        for at in range(start, len(data)):
            state = self.step[state + self.byte_class[data[at]]]
            if state == self.dead:
                break
            if self.accept[state // self.classes]:
                end, bits = at + 1, self.accept[state // self.classes]
        return end, bits
