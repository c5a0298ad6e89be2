"""A Levenshtein automaton intersected with a trie of terms, determinised as it is walked."""

from __future__ import annotations


def tolerance(term: str) -> int:
    """Edits that still count as a misspelling: none under five letters, one under eight, two from there on."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Finds which terms a word spells within their tolerance.

    ``terms``: (term, is_stem); a stem matches any word that begins with it. A state is a set of (trie node, edits); both
    the states and the steps between them are remembered, up to ``limit`` of them.
    """

    def __init__(self, terms: list[tuple[str, bool]], limit: int = 300_000):
        self.terms, self.limit = terms, limit
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room: list[int] = [0]  # most edits that any term below a node allows
        for k, (term, _) in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], tolerance(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], tolerance(term))
            self.ends[node].append(k)
        self.letters = {c for kids in self.children for c in kids}
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepts: list[tuple[list[tuple[int, int]], list[tuple[int, int]]]] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self.state({(0, 0)})

    def state(self, found: set[tuple[int, int]]) -> int:
        """The state of these positions, with those reached by leaving out letters of a term; -1 if there are none."""
        stack = list(found)
        while stack:
            node, edits = stack.pop()
            if edits < self.room[node]:
                for child in self.children[node].values():
                    if edits < self.room[child] and (child, edits + 1) not in found:
                        found.add((child, edits + 1))
                        stack.append((child, edits + 1))
        if not found:
            return -1
        key = frozenset(found)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            best: dict[int, int] = {}
            for node, edits in key:
                for k in self.ends[node]:
                    if edits <= tolerance(self.terms[k][0]):
                        best[k] = min(edits, best.get(k, 9))
            self.accepts.append(([x for x in best.items() if not self.terms[x[0]][1]], [x for x in best.items() if self.terms[x[0]][1]]))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        c = c if c in self.letters else "\0"  # all letters outside the lexicon behave alike
        known = self.steps.get((state, c))
        if known is None:
            found = set()
            for node, edits in self.members[state]:
                for letter, child in self.children[node].items():
                    if letter == c:
                        found.add((child, edits))
                    elif edits < self.room[child]:
                        found.add((child, edits + 1))
                if edits < self.room[node]:
                    found.add((node, edits + 1))
            known = self.steps[state, c] = self.state(found)
        return known

    def matches(self, word: str) -> list[tuple[int, int]]:
        """(term number, edits) of the longest of the terms the word spells with the fewest edits."""
        if len(self.steps) > self.limit:
            self.reset()
        state, best = self.start, {}
        for c in word:
            state = self.step(state, c)
            if state < 0:
                break
            for k, edits in self.accepts[state][1]:
                best[k] = min(edits, best.get(k, 9))
        if state >= 0:
            for k, edits in self.accepts[state][0]:
                best[k] = min(edits, best.get(k, 9))
        fewest = min(best.values(), default=0)
        closest = [k for k, edits in best.items() if edits == fewest]
        longest = max((len(self.terms[k][0]) for k in closest), default=0)
        return [(k, fewest) for k in closest if len(self.terms[k][0]) == longest]
