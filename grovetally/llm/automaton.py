"""Regular expressions over bytes as one minimal deterministic automaton.

The syntax is a small subset: literals, ``\\xHH`` and escaped punctuation, classes
with ranges, ``(...)``, ``(?i:...)``, ``|``, ``?``, ``*``, ``+`` and ``{n,m}``.
Patterns are parsed to trees, trees become a nondeterministic automaton (forwards
or reversed), subset construction makes it deterministic over byte classes, and
partition refinement makes it minimal.
"""

from __future__ import annotations

from dataclasses import dataclass

_CLOSERS = {"?": (0, 1), "*": (0, None), "+": (1, None)}


class _Parser:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.either(False)
        if self.at != len(self.text):
            raise ValueError(f"cannot read {self.text!r} at {self.at}")
        return tree

    def either(self, fold: bool):
        options = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence(fold))
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self, fold: bool):
        items = []
        while self.peek() not in ("", "|", ")"):
            item = self.atom(fold)
            while (c := self.peek()) and c in "?*+{":
                low, high = _CLOSERS[self.take()] if c != "{" else self.counts()
                item = ("repeat", item, low, high)
            items.append(item)
        return ("then", items)

    def counts(self) -> tuple[int, int | None]:
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at + 1 : end].partition(",")
        self.at = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.text.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            tree = self.either(fold)
            if self.take() != ")":
                raise ValueError("a group is not closed")
            return tree
        if c == "[":
            found: set[int] = set()
            while (c := self.take()) != "]":
                low = self.byte(c)
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    found.update(range(low, self.byte(self.take()) + 1))
                else:
                    found.add(low)
            return self.folded(found, fold)
        return self.folded({self.byte(c)}, fold)

    def byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    @staticmethod
    def folded(found: set[int], fold: bool):
        if fold:
            found = {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper())}
        return ("bytes", frozenset(found))


def parse(pattern: str):
    return _Parser(pattern).parse()


@dataclass
class Automaton:
    """``table[state * width + classes[byte]]`` is the next state, already times width.

    States from ``first_accepting`` (times width) on are accepting; ``rules`` has
    the accepted rules of each as a tuple.  State 0 is the start.  ``dead`` is the
    state no match leaves, or -1.
    """

    classes: bytes
    width: int
    table: list[int]
    first_accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int


class _Net:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def node(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, reverse: bool) -> int:
        """Wire the tree behind ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "bytes":
            end = self.node()
            self.steps[start].append((tree[1], end))
            return end
        if kind == "then":
            for item in reversed(tree[1]) if reverse else tree[1]:
                start = self.add(item, start, reverse)
            return start
        if kind == "or":
            end = self.node()
            for item in tree[1]:
                begin = self.node()
                self.empty[start].append(begin)
                self.empty[self.add(item, begin, reverse)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            start = self.add(item, start, reverse)
        end = self.node()
        if high is None:
            loop = self.node()
            self.empty[start].append(loop)
            self.empty[self.add(item, loop, reverse)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(item, start, reverse)
        self.empty[start].append(end)
        return end


def compile_rules(trees: list, reverse: bool = False, search: bool = False) -> Automaton:
    """One automaton for all trees; ``search`` lets a match begin anywhere."""
    net = _Net()
    root = net.node()
    if search:
        net.steps[root].append((frozenset(range(256)), root))
    accepts: dict[int, int] = {}
    for k, tree in enumerate(trees):
        begin = net.node()
        net.empty[root].append(begin)
        accepts[net.add(tree, begin, reverse)] = k

    sets = {s for steps in net.steps for s, _ in steps}
    marks = [tuple(b in s for s in sets) for b in range(256)]
    order = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    classes, width = bytes(order[m] for m in marks), len(order)
    sample = [marks.index(m) for m in order]

    def closed(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in net.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closed([root])
    numbers, todo, moves = {start: 0}, [start], []
    for states in todo:
        row = []
        for byte in sample:
            after = closed([t for s in states for on, t in net.steps[s] if byte in on])
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        moves.append(row)
    accepted = [tuple(sorted({accepts[s] for s in states if s in accepts})) for states in todo]

    block_of = {a: i for i, a in enumerate(dict.fromkeys(accepted))}
    block, count = [block_of[a] for a in accepted], len(block_of)
    while True:
        keys = [(block[i], *(block[t] for t in row)) for i, row in enumerate(moves)]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        block = [names[k] for k in keys]
        if len(names) == count:
            break
        count = len(names)

    leader = {}
    for i, b in enumerate(block):
        leader.setdefault(b, i)
    plain = [b for b in leader if not accepted[leader[b]]]
    plain.sort(key=lambda b: b != block[0])
    final = [b for b in leader if accepted[leader[b]]]
    if accepted[0]:
        raise ValueError("a rule matches the empty string")
    place = {b: i * width for i, b in enumerate(plain + final)}
    table = [place[block[t]] for b in plain + final for t in moves[leader[b]]]
    dead = next((place[b] for b in plain if all(block[t] == b for t in moves[leader[b]])), -1)
    return Automaton(classes, width, table, len(plain) * width, {place[b]: accepted[leader[b]] for b in final}, dead)


def longest(machine: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at ``at``, or -1."""
    state, end, table, classes, first, dead = 0, -1, machine.table, machine.classes, machine.first_accepting, machine.dead
    for i in range(at, len(data)):
        state = table[state + classes[data[i]]]
        if state == dead:
            break
        if state >= first:
            end = i + 1
    return end
