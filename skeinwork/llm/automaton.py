"""Deterministic automata over bytes: rule regexes to transition arrays by subset construction and minimisation."""

from __future__ import annotations

from dataclasses import dataclass

ALL = frozenset(range(256))


# --- regexes: literals, classes, groups, alternation and the repeats ? * + {m} {m,n} ------------------


class _Reader:
    """Reads a rule's regex into a nested tuple: ("set", bytes), ("cat", ...), ("or", ...), ("rep", x, m, n)."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self) -> tuple:
        arms = [self.sequence()]
        while self.peek() == "|":
            self.take()
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else ("or", *arms)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", *parts)

    def repeated(self, item: tuple) -> tuple:
        while self.peek() in ("?", "*", "+", "{") and self.peek():
            sign = self.take()
            if sign == "{":
                stop = self.text.index("}", self.at)
                low, _, high = self.text[self.at : stop].partition(",")
                item = ("rep", item, int(low), int(high or low) if high or "," not in self.text[self.at : stop] else None)
                self.at = stop + 1
            else:
                item = ("rep", item, int(sign == "+"), 1 if sign == "?" else None)
        return item

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self) -> tuple:
        if self.peek() == "(":
            self.take()
            inner = self.either()
            self.take()
            return inner
        if self.peek() == "[":
            self.take()
            other = self.peek() == "^"
            if other:
                self.take()
            found: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    found.update(range(low, self.byte() + 1))
                else:
                    found.add(low)
            self.take()
            return ("set", self.folded(ALL - found if other else found))
        return ("set", self.folded({self.byte()}))

    def folded(self, found: set[int] | frozenset[int]) -> frozenset[int]:
        if self.fold:
            found = set(found) | {b ^ 32 for b in found if chr(b).isalpha() and b < 128}
        return frozenset(found)


def parse(regex: str, fold: bool = False) -> tuple:
    """The tree of a rule's regex; ``fold`` takes ASCII letters in either case."""
    return _Reader(regex, fold).either()


def backwards(tree: tuple) -> tuple:
    """The tree that matches the reversed strings."""
    kind, *rest = tree
    if kind == "cat":
        return ("cat", *(backwards(x) for x in reversed(rest)))
    if kind == "or":
        return ("or", *(backwards(x) for x in rest))
    return ("rep", backwards(rest[0]), *rest[1:]) if kind == "rep" else tree


# --- automata -----------------------------------------------------------------------------------------


@dataclass
class Automaton:
    """``table[state + byte]`` is the next state; states are multiples of 256, those from ``accept`` on accept.

    ``marks[state // 256]`` has the rules that end in a state. State 0 is the start; ``dead`` is the state that
    nothing leaves, or -1.
    """

    table: list[int]
    accept: int
    marks: list[tuple[int, ...]]
    start: int
    dead: int


def compile_rules(trees: list[tuple], anywhere: bool) -> Automaton:
    """One minimal automaton for all trees; ``anywhere`` lets a match begin at every byte."""
    steps: list[list[tuple[frozenset[int], int]]] = []
    empty: list[list[int]] = []

    def state() -> int:
        steps.append([])
        empty.append([])
        return len(steps) - 1

    def build(tree: tuple, a: int) -> int:
        kind, *rest = tree
        if kind == "set":
            b = state()
            steps[a].append((rest[0], b))
            return b
        if kind == "cat":
            for x in rest:
                a = build(x, a)
            return a
        if kind == "or":
            b = state()
            for x in rest:
                empty[build(x, a)].append(b)
            return b
        item, low, high = rest
        for _ in range(low):
            a = build(item, a)
        if high is None:
            loop = state()
            empty[a].append(loop)
            empty[build(item, loop)].append(loop)
            return loop
        out = state()
        for _ in range(high - low):
            empty[a].append(out)
            a = build(item, a)
        empty[a].append(out)
        return out

    root = state()
    ends = {}
    for k, tree in enumerate(trees):
        first = state()
        empty[root].append(first)
        ends[build(tree, first)] = k

    def closure(found: set[int]) -> frozenset[int]:
        todo = list(found)
        while todo:
            for b in empty[todo.pop()]:
                if b not in found:
                    found.add(b)
                    todo.append(b)
        return frozenset(found)

    # subset construction over classes of bytes that no rule tells apart
    sets = {s for out in steps for s, _ in out}
    kinds: dict[tuple[bool, ...], list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    groups = list(kinds.values())
    begin = closure({root})
    names, todo, moves = {begin: 0}, [begin], []
    while todo:
        here = todo.pop(0)
        row = []
        for g in groups:
            there = {t for n in here for s, t in steps[n] if g[0] in s}
            there = closure(there | {root} if anywhere else there)
            if there not in names:
                names[there] = len(names)
                todo.append(there)
            row.append(names[there])
        moves.append(row)
    marks = [tuple(sorted({ends[n] for n in s if n in ends})) for s in names]

    # minimisation: split classes of states by what they accept and where they lead until none splits
    label = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    part = [label[m] for m in marks]
    while True:
        seen: dict[tuple, int] = {}
        split = [seen.setdefault((part[s], *(part[t] for t in row)), len(seen)) for s, row in enumerate(moves)]
        if len(seen) == len(set(part)):
            break
        part = split
    chosen = {p: s for s, p in reversed(list(enumerate(part)))}
    order = sorted(chosen, key=lambda p: (bool(marks[chosen[p]]), p != part[0]))
    place = {p: i * 256 for i, p in enumerate(order)}
    table = [0] * (256 * len(order))
    dead = -1
    for p in order:
        for g, t in zip(groups, moves[chosen[p]], strict=True):
            for b in g:
                table[place[p] + b] = place[part[t]]
        if not marks[chosen[p]] and all(part[t] == p for t in moves[chosen[p]]):
            dead = place[p]
    plain = sum(not marks[chosen[p]] for p in order)
    return Automaton(table, plain * 256, [marks[chosen[p]] for p in order], place[part[0]], dead)
