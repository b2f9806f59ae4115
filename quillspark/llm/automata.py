"""Probabilistic automata inferred from examples by merging compatible prefix-tree states."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log2, sqrt

#: The confidence of the test by which two states differ.
ALPHA = 0.05
#: Bits that a symbol costs which a state has never seen; after so many of them a string is given up.
UNSEEN, MOST_UNSEEN = 12.0, 3


def _differs(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    """Hoeffding's test: are two relative frequencies further apart than chance allows?"""
    return abs(f1 / n1 - f2 / n2) > bound * (1 / sqrt(n1) + 1 / sqrt(n2))


class _Tree:
    """A prefix tree with counts whose states get merged in place."""

    def __init__(self, examples: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[Counter] = [Counter()]
        self.ended: list[int] = [0]
        for example in examples:
            at = 0
            for symbol in example:
                self.passed[at][symbol] += 1
                if symbol not in self.next[at]:
                    self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    self.passed.append(Counter())
                    self.ended.append(0)
                at = self.next[at][symbol]
            self.ended[at] += 1

    def total(self, state: int) -> int:
        return self.ended[state] + self.passed[state].total()

    def compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.total(a), self.total(b)
            if not n1 or not n2:
                continue
            if _differs(self.ended[a], n1, self.ended[b], n2, bound):
                return False
            for symbol in self.passed[a].keys() | self.passed[b].keys():
                if _differs(self.passed[a][symbol], n1, self.passed[b][symbol], n2, bound):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def merge(self, parent: int, symbol: str, into: int) -> None:
        """Leads parent's step to another state and folds the tree below the old one into it."""
        todo = [(into, self.next[parent][symbol])]
        self.next[parent][symbol] = into
        while todo:
            a, b = todo.pop()
            self.ended[a] += self.ended[b]
            for step, child in self.next[b].items():
                if step in self.next[a]:
                    todo.append((self.next[a][step], child))
                else:
                    self.next[a][step] = child
            self.passed[a].update(self.passed[b])


@dataclass(frozen=True)
class ProbabilisticAutomaton:
    """For each state the next state and the bits of each symbol, and the bits of ending there."""

    steps: tuple[dict[str, tuple[int, float]], ...]
    ends: tuple[float, ...]
    #: Where a symbol leads that the state has never seen: to where most symbols lead, or nowhere.
    usual: tuple[int, ...]

    @classmethod
    def inferred(cls, examples: list[str], alpha: float = ALPHA, lengths: bool = False) -> ProbabilisticAutomaton:
        """Red states are settled, blue ones follow them: a blue state is merged into the first compatible red one, or
        turns red if there is none. The states' order is that of their examples, so equal examples give equal automata.

        With ``lengths`` only states of the same depth are merged: the automaton has no loops and keeps how long its
        examples are, as formats of keys need it.
        """
        tree, bound = _Tree(examples), sqrt(0.5 * log(2 / alpha))
        red = [0]
        depth = {0: 0}
        at = 0
        while at < len(red):
            parent = red[at]
            symbol = min((s for s, state in tree.next[parent].items() if state not in depth), default=None)
            if symbol is None:
                at += 1
                continue
            state, below = tree.next[parent][symbol], depth[parent] + 1
            for candidate in reversed(red) if lengths else red:
                if lengths and depth[candidate] != below:
                    if depth[candidate] < below:
                        break
                elif tree.compatible(candidate, state, bound):
                    tree.merge(parent, symbol, candidate)
                    at = at if lengths else 0  # a loop may have given earlier states new steps
                    break
            if tree.next[parent][symbol] == state:
                red.append(state)
                depth[state] = below
        number = {state: k for k, state in enumerate(red)}
        steps, ends, usual = [], [], []
        for state in red:
            total = tree.total(state)
            seen = tree.passed[state]
            steps.append({s: (number[tree.next[state][s]], -log2(n / total)) for s, n in seen.items()})
            ends.append(-log2(tree.ended[state] / total) if tree.ended[state] else UNSEEN)
            usual.append(max(steps[-1].values(), key=lambda step: (-step[1], -step[0]))[0] if seen else len(usual))
        return cls(tuple(steps), tuple(ends), tuple(usual))

    def bits(self, text: str) -> float:
        """What a string costs. A symbol that its state has never seen costs UNSEEN and goes the usual way."""
        cost, state = 0.0, 0
        for symbol in text:
            if step := self.steps[state].get(symbol):
                state = step[0]
                cost += step[1]
            else:
                state = self.usual[state]
                cost += UNSEEN
        return cost + self.ends[state]

    def bits_to(self, text: str, start: int, ends: list[int]) -> Iterator[tuple[int, float]]:
        """(end, bits) of each stretch from start to one of the ascending ends, as long as no more than MOST_UNSEEN symbols
        of it are unseen."""
        cost, state, unseen, at = 0.0, 0, 0, start
        for end in ends:
            for symbol in text[at:end]:
                if step := self.steps[state].get(symbol):
                    state = step[0]
                    cost += step[1]
                else:
                    unseen += 1
                    if unseen > MOST_UNSEEN:
                        return
                    state = self.usual[state]
                    cost += UNSEEN
            at = end
            yield end, cost + self.ends[state]
