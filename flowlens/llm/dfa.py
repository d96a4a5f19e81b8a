"""Many regular expressions as one deterministic automaton over bytes.

Expressions become a nondeterministic automaton, subset construction makes it deterministic, partition refinement
makes it minimal, and what is left is one transition array, read by state and class of bytes. Classes join the
bytes that no expression tells apart.

An expression has literals, `.` (any byte but line feed), classes, escapes (\\xHH, \\n \\r \\t \\d \\w \\s, marks), groups
`(...)`, `(?:...)`, `(?i:...)` (A-Z and a-z in either case), `|`, and `? * + {m} {m,} {m,n}`. Classes are of bytes:
a negated class holds each byte of a character beyond ASCII. Byte 0xFF, which no UTF-8 text has, ends a text and
matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = 0xFF
MAX_STATES = 1 << 15
_DIGIT = frozenset(range(0x30, 0x3A))
_LETTER = frozenset([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_NAMED = {
    "d": _DIGIT,
    "w": _DIGIT | _LETTER | {0x5F},
    "s": frozenset([0x20, *range(0x09, 0x0E)]),
    "n": frozenset([0x0A]),
    "r": frozenset([0x0D]),
    "t": frozenset([0x09]),
}
_ALL = frozenset(range(END))


class Parser:
    """An expression as nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, text: str):
        self.text, self.at, self.any_case = text, 0, False

    def parse(self):
        tree = self._alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {self.text!r}")
        return tree

    def _next(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def _take(self, sign: str) -> bool:
        if self.text.startswith(sign, self.at):
            self.at += len(sign)
            return True
        return False

    def _alternatives(self):
        parts = [self._sequence()]
        while self._take("|"):
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _sequence(self):
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self._repeated(self._one()))
        return ("cat", parts)

    def _repeated(self, tree):
        while self.at < len(self.text) and self.text[self.at] in "?*+{":
            sign = self._next()
            if sign == "{":
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : end].partition(",")
                self.at = end + 1
                low, high = int(least), (int(most) if most else None) if comma else int(least)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            tree = ("rep", tree, low, high)
        return tree

    def _one(self):
        sign = self._next()
        if sign == "(":
            before = self.any_case
            if self._take("?i:"):
                self.any_case = True
            else:
                self._take("?:")
            tree = self._alternatives()
            if self._next() != ")":
                raise ValueError(f"a group of {self.text!r} does not end")
            self.any_case = before
            return tree
        if sign == "[":
            return ("set", self._class())
        if sign == ".":
            return ("set", _ALL - {0x0A})
        if sign == "\\":
            return ("set", self._cased(self._escape()))
        return ("cat", [("set", self._cased(frozenset([b]))) for b in sign.encode()])

    def _escape(self) -> frozenset[int]:
        sign = self._next()
        if sign == "x":
            return frozenset([int(self._next() + self._next(), 16)])
        return _NAMED.get(sign) or frozenset(sign.encode())

    def _class(self) -> frozenset[int]:
        negated, found, first = self._take("^"), set(), True
        while first or self.text[self.at] != "]":
            first, sign = False, self._next()
            low = self._escape() if sign == "\\" else frozenset(sign.encode())
            if self.text.startswith("-", self.at) and not self.text.startswith("-]", self.at):
                self.at += 1
                sign = self._next()
                high = self._escape() if sign == "\\" else frozenset(sign.encode())
                found |= set(range(min(low), max(high) + 1))
            else:
                found |= low
        self.at += 1
        found = self._cased(frozenset(found))
        return (_ALL - found if negated else found) - {END}

    def _cased(self, found: frozenset[int]) -> frozenset[int]:
        return found | {b ^ 0x20 for b in found & _LETTER} if self.any_case else found


def backwards(tree):
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", backwards(tree[1]), *tree[2:])
    parts = [backwards(p) for p in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The state reached from `start` by the tree."""
        if tree[0] == "set":
            end = self.state()
            at = self.state()
            self.free[start].append(at)
            self.step[at] = (tree[1], end)
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "alt":
            end = self.state()
            for part in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(part, begin)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass
class Automaton:
    """State s reads a byte b as moves[s + classes[b]]; states are multiples of the number of classes.

    The start is 0; states from `accepting` on accept, and masks[s // n_classes] has a bit for each expression.
    """

    classes: np.ndarray
    moves: np.ndarray
    accepting: int
    masks: np.ndarray
    n_classes: int

    def run(self, data: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places after whose byte some expression ends, ascending, and the masks there.

        The bytes are cut into lanes that advance side by side, each from the start state; then lanes whose
        true first state differs run again until they meet what they had, so the result is that of one pass.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-len(data) // lane)
        padded = np.full(lanes * lane, END, np.uint8)
        padded[: len(data)] = data
        read = np.ascontiguousarray(self.classes[padded].reshape(lanes, lane).T)
        states = np.empty((lane, lanes), self.moves.dtype)
        now = np.zeros(lanes, self.moves.dtype)
        for t in range(lane):
            now = self.moves[now + read[t]]
            states[t] = now
        entered = np.zeros(lanes, self.moves.dtype)
        while True:
            true = np.concatenate([np.zeros(1, entered.dtype), states[-1, :-1]])
            live = np.flatnonzero(true != entered)
            if not len(live):
                break
            entered[live] = true[live]
            now = true[live]
            for t in range(lane):
                now = self.moves[now + read[t, live]]
                apart = now != states[t, live]
                live, now = live[apart], now[apart]
                if not len(live):
                    break
                states[t, live] = now
        t, k = np.nonzero(states >= self.accepting)
        place = k * lane + t
        order = np.argsort(place)
        return place[order], self.masks[states[t, k][order] // self.n_classes]

    def longest(self, raw: bytes, start: int) -> int:
        """The end of the longest match that begins at `start`, or -1."""
        classes, moves = self._lists()
        state, best, dead = 0, 0 if self.masks[0] else -1, self.dead
        for n, byte in enumerate(memoryview(raw)[start:], 1):
            state = moves[state + classes[byte]]
            if state >= self.accepting:
                best = n
            elif state == dead:
                break
        return best if best < 0 else start + best

    def _lists(self):
        if not hasattr(self, "_held"):
            self._held = self.classes.tolist(), self.moves.tolist()
            rows = self.moves.reshape(-1, self.n_classes)
            stuck = np.flatnonzero((rows == rows[:, :1]).all(axis=1) & (rows[:, 0] == np.arange(len(rows)) * self.n_classes))
            self.dead = int(stuck[0]) * self.n_classes if len(stuck) and not self.masks[stuck[0]] else -1
        return self._held


def compiled(trees: list, anchored: bool, max_states: int = MAX_STATES) -> Automaton:
    """One automaton of all expressions; unless anchored, a match may begin at any byte."""
    nfa = _Nfa()
    start, final = [], {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        start.append(begin)
        final[nfa.add(tree, begin)] = 1 << k
    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    signs: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    for byte in range(END):
        classes[byte] = signs.setdefault(tuple(byte in s for s in sets), len(signs))
    classes[END] = len(signs)
    n_classes = len(signs) + 1
    by_class = [[i for i, inside in enumerate(sign) if inside] for sign in signs]
    of_set = {s: i for i, s in enumerate(sets)}
    first = nfa.closure(start)
    again = start if not anchored else []
    number, rows, todo = {first: 0}, [], [first]
    while todo:
        states = todo.pop(0)
        moved: dict[int, list[int]] = {}
        for s in states:
            if nfa.step[s]:
                moved.setdefault(of_set[nfa.step[s][0]], []).append(nfa.step[s][1])
        row = []
        for inside in by_class:
            reached = nfa.closure([t for i in inside for t in moved.get(i, ())] + again)
            if reached not in number:
                if len(number) >= max_states:
                    raise ValueError(f"the expressions need more than {max_states} states")
                number[reached] = len(number)
                todo.append(reached)
            row.append(number[reached])
        if anchored:  # nothing goes on after the end of a text
            empty = frozenset()
            if empty not in number:
                number[empty] = len(number)
                todo.append(empty)
            row.append(number[empty])
        else:
            row.append(0)
        rows.append(row)
    masks = np.array([sum(final.get(s, 0) for s in states) for states in number], np.int64)
    return _minimal(classes, np.array(rows, np.int64), masks)


def _minimal(classes: np.ndarray, rows: np.ndarray, masks: np.ndarray) -> Automaton:
    """States that no input tells apart become one; accepting states are numbered last, the start first."""
    _, block = np.unique(masks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, sample = np.unique(block, return_index=True)
    rank = np.lexsort((sample, block[sample] != block[0], masks[sample] != 0))
    if masks[0]:
        raise ValueError("an expression matches the empty text")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    n_classes = rows.shape[1]
    moves = place[block[rows[sample[rank]]]] * n_classes
    kind = np.uint16 if moves.max() + n_classes < 1 << 16 else np.uint32
    masks = masks[sample[rank]]
    accepting = int(np.flatnonzero(masks)[0]) * n_classes if masks.any() else len(masks) * n_classes
    return Automaton(classes, moves.reshape(-1).astype(kind), accepting, masks, n_classes)
