"""Regular expressions over bytes compiled to one deterministic automaton.

Rules are parsed to a Thompson automaton with a tag per rule, made deterministic by subset
construction over classes of bytes that no rule tells apart, minimised by partition refinement, and
laid out as a transition array. The automaton searches: it starts anew at every byte, and the tags of
a state say which rules have a match that ends there.

Syntax: literals, \\xHH and escaped punctuation, [classes] with ranges and negation, ( ), |, ? * + {m,n}.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append([])
        return len(self.empty) - 1


class _Parser:
    """Recursive descent; each piece is a function that adds itself between two new states."""

    def __init__(self, pattern: str, nfa: _Nfa, fold: bool) -> None:
        self.s, self.at, self.nfa, self.fold = pattern, 0, nfa, fold

    def whole(self) -> tuple[int, int]:
        make = self.alternation()
        if self.at != len(self.s):
            raise ValueError(f"unbalanced at {self.at}: {self.s}")
        return make()

    def alternation(self):
        options = [self.sequence()]
        while self.at < len(self.s) and self.s[self.at] == "|":
            self.at += 1
            options.append(self.sequence())

        def make() -> tuple[int, int]:
            a, b = self.nfa.state(), self.nfa.state()
            for option in options:
                x, y = option()
                self.nfa.empty[a].append(x)
                self.nfa.empty[y].append(b)
            return a, b

        return make if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.at < len(self.s) and self.s[self.at] not in "|)":
            parts.append(self.repeated())

        def make() -> tuple[int, int]:
            first = last = self.nfa.state()
            for part in parts:
                x, y = part()
                self.nfa.empty[last].append(x)
                last = y
            return first, last

        return make

    def repeated(self):
        part = self.atom()
        least, most = 1, 1
        c = self.s[self.at] if self.at < len(self.s) else ""
        if c and c in "?*+":
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            self.at += 1
        elif c == "{":
            end = self.s.index("}", self.at)
            low, comma, high = self.s[self.at + 1 : end].partition(",")
            least, most = int(low), (int(high) if high else None) if comma else int(low)
            self.at = end + 1
        if (least, most) == (1, 1):
            return part

        def make() -> tuple[int, int]:
            first = last = self.nfa.state()
            for _ in range(least):
                x, y = part()
                self.nfa.empty[last].append(x)
                last = y
            end = self.nfa.state()
            if most is None:
                x, y = part()
                self.nfa.empty[last] += [x, end]
                self.nfa.empty[y] += [x, end]
            else:
                self.nfa.empty[last].append(end)
                for _ in range(most - least):
                    x, y = part()
                    self.nfa.empty[last].append(x)
                    self.nfa.empty[y].append(end)
                    last = y
            return first, end

        return make

    def atom(self):
        c = self.s[self.at]
        self.at += 1
        if c == "(":
            inner = self.alternation()
            self.at += 1
            return inner
        if c == "[":
            return self.bytes_of(self.charset())
        if c == "\\":
            self.at -= 1
            return self.bytes_of({self.escaped()})
        return self.bytes_of({ord(c)})

    def escaped(self) -> int:
        if self.s[self.at + 1] == "x":
            self.at += 4
            return int(self.s[self.at - 2 : self.at], 16)
        self.at += 2
        return ord(self.s[self.at - 1])

    def charset(self) -> set[int]:
        negated = self.s[self.at] == "^"
        self.at += negated
        found: set[int] = set()
        one = lambda: self.escaped() if self.s[self.at] == "\\" else (setattr(self, "at", self.at + 1), ord(self.s[self.at - 1]))[1]
        while self.s[self.at] != "]":
            low = one()
            if self.s[self.at] == "-" and self.s[self.at + 1] != "]":
                self.at += 1
                found.update(range(low, one() + 1))
            else:
                found.add(low)
        self.at += 1
        return set(range(256)) - found if negated else found

    def bytes_of(self, wanted: set[int]):
        if self.fold:
            wanted = wanted | {ord(chr(b).swapcase()) for b in wanted if b < 128 and chr(b).isalpha()}
        symbols = frozenset(wanted)

        def make() -> tuple[int, int]:
            a, b = self.nfa.state(), self.nfa.state()
            self.nfa.step[a].append((symbols, b))
            return a, b

        return make


#: Segments that are too few for array steps to pay.
LANES = 100


@dataclass
class Automaton:
    """classes: byte to class; table: state x class, flat; tags: bit set of rules by state; resets: bytes that lead to the start from everywhere."""

    classes: np.ndarray
    table: np.ndarray
    tags: np.ndarray
    resets: np.ndarray
    width: int

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tags seen in each of the segments data[starts:ends]: all advance together one byte a step, the last LANES on their own."""
        order = np.argsort(starts - ends, kind="stable")
        at, length = starts[order], (ends - starts)[order]
        state, seen = np.zeros(len(at), self.table.dtype), np.zeros(len(at), self.tags.dtype)
        symbols = self.classes[data]
        live = len(at)
        steps = np.searchsorted(-length, -np.arange(int(length[0]) if live else 0), "left")
        for j, live in enumerate(steps.tolist()):
            if live <= LANES:
                break
            now = self.table[state[:live] + symbols[at[:live] + j]]
            state[:live] = now
            seen[:live] |= self.tags[now // self.width]
        if 0 < live <= LANES:
            table, tags = self.table.tolist(), np.repeat(self.tags, self.width).tolist()
            for i in range(live):
                s, met = int(state[i]), int(seen[i])
                for c in symbols[at[i] + j : at[i] + length[i]].tolist():
                    s = table[s + c]
                    met |= tags[s]
                seen[i] = met
        out = np.empty_like(seen)
        out[order] = seen
        return out


def compile_rules(rules: list[tuple[str, bool]]) -> Automaton:
    """One minimal searching automaton of (pattern, letters in either case); rule i has tag bit 1 << i."""
    nfa = _Nfa()
    start, accepts = nfa.state(), {}
    for i, (pattern, fold) in enumerate(rules):
        a, b = _Parser(pattern, nfa, fold).whole()
        nfa.empty[start].append(a)
        accepts[b] = 1 << i
    signature: dict[tuple, int] = {}
    sets = [x for edges in nfa.step for x, _ in edges]
    classes = np.array([signature.setdefault(tuple(b in x for x in sets), len(signature)) for b in range(256)], np.int32)
    width, sample = len(signature), {}
    for b in range(255, -1, -1):
        sample[int(classes[b])] = b

    def closure(states) -> frozenset[int]:
        todo, done = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in done:
                    done.add(x)
                    todo.append(x)
        return frozenset(done)

    first = closure([start])
    number, rows, queue = {first: 0}, [], [first]
    for current in queue:  # grows while it runs
        row = []
        for c in range(width):
            b = sample[c]
            after = closure([start, *(t for q in current for x, t in nfa.step[q] if b in x)])
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append(number[after])
        rows.append(row)
    tag = [sum({accepts[q] for q in s if q in accepts}) for s in queue]
    block = _minimise(rows, tag)
    count = max(block) + 1
    table, tags = np.zeros((count, width), np.int32), np.zeros(count, np.int32)
    for s, row in enumerate(rows):
        table[block[s]] = [block[t] for t in row]
        tags[block[s]] = tag[s]
    resets = np.array([bool((table[:, classes[b]] == 0).all()) for b in range(256)])
    return Automaton(classes, (table * width).ravel(), tags, resets, width)


def _minimise(rows: list[list[int]], tag: list[int]) -> list[int]:
    """Block of each state; the start's is 0. Refines the partition by tag until successors agree."""
    block, count = [], -1
    names: dict = {}
    block = [names.setdefault(t, len(names)) for t in tag]
    while len(names) != count:
        count, names = len(names), {}
        block = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(rows)]
    return block
