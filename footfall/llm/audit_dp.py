"""The cheapest edits that give a conversation its role order, ties by their initials.

Edits are letters: K keep, R rerole, D delete, I insert.  A prefix of edits is a linked node:
prefixes share what they have in common, and a node knows its ancestors at distances of powers
of two and a rolling hash of its letters.  Two prefixes of equal cost are compared by searching
for their longest common prefix over these ancestors; an equal hash is believed only after the
letters were compared.

Letters and the rows before them decide what state a conversation is in and what it costs, so
of two prefixes with equal cost and state neither begins with the other, and the smaller one
stays smaller whatever follows.  For the same reason a long conversation may be solved in
pieces: see ``cost_matrix``, ``costs_to_go`` and ``cheapest``.
"""

from __future__ import annotations

from collections.abc import Sequence

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

# A row is one character: its role's initial (o: none of s, u, a), in upper case if the row is
# truncated, as a digit if it must go.
SOUND, TRUNCATED, DOOMED = "suao", "SUAO", "1234"
INITIAL = {c: "suao"[i] for row in (SOUND, TRUNCATED, DOOMED) for i, c in enumerate(row)}

# States: nothing yet, after s, after u, after a.  Repaired roles are empty or s?(ua)+.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
NEVER = 1 << 60
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
# A rerole or an insert takes the role that is due.
DUE = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
# What it takes to end in a state, with inserts behind the last row.
ENDING = (0, 2 * INSERT_COST, INSERT_COST, 0)

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Prefixes:
    """Prefixes of edits as linked nodes; node 0 is the empty prefix."""

    def __init__(self, base: int = _BASE, prime: int = _PRIME):
        self.base, self.prime = base, prime
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]  # ancestors at distances 1, 2, 4, ...
        self.same: dict[int, int] = {}  # nodes found to hold the same letters as an earlier one

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        above, up = parent, [parent]
        while len(self.up[above]) >= len(up):
            above = self.up[above][len(up) - 1]
            up.append(above)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.prime)
        self.up.append(tuple(up))
        return node

    def _first(self, node: int) -> int:
        while node in self.same:
            node = self.same[node]
        return node

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def letters(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _verified(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth hold the same letters; remembered if they do."""
        top = a, b
        while (a := self._first(a)) != (b := self._first(b)):
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        a, b = map(self._first, top)
        if a != b:
            self.same[max(a, b)] = min(a, b)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the letters of ``a`` come before those of ``b``; a prefix comes first."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, short), self.ancestor(b, short)
        if self.hash[x] == self.hash[y]:
            if self._verified(x, y):
                return self.depth[a] < self.depth[b]
            return self.letters(a) < self.letters(b)
        # Lift both as long as their letters differ; then those above are the common prefix.
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.letter[x] != self.letter[y] and self._verified(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.letters(a) < self.letters(b)


def _after(row: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may become of a row."""
    out = [(DELETE, DELETE_COST, state)]
    if row not in DOOMED:
        extra = TRUNCATED_COST if row in TRUNCATED else 0
        if (state, INITIAL[row]) in KEPT:
            out.append((KEEP, extra, KEPT[state, INITIAL[row]]))
        out.append((REROLE, REROLE_COST + extra, DUE[state]))
    return out


_AFTER = {(row, state): _after(row, state) for row in INITIAL for state in range(STATES)}
_INSERTS = [(START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U), (AFTER_U, AFTER_A)]


def cost_matrix(rows: str) -> list[list[int]]:
    """From every state before ``rows`` to every state after them, without inserts behind."""
    out = []
    for start in range(STATES):
        costs = [NEVER] * STATES
        costs[start] = 0
        for row in rows:
            for a, b in _INSERTS:
                costs[b] = min(costs[b], costs[a] + INSERT_COST)
            after = [NEVER] * STATES
            for state in range(STATES):
                for _, cost, to in _AFTER[row, state]:
                    after[to] = min(after[to], costs[state] + cost)
            costs = after
        out.append([min(c, NEVER) for c in costs])
    return out


def costs_to_go(matrices: Sequence[Sequence[Sequence[int]]]) -> list[tuple[int, ...]]:
    """For every piece of a conversation, what it still costs from each state behind it."""
    out = [ENDING]
    for matrix in reversed(matrices[1:]):
        out.append(tuple(min(m + g for m, g in zip(line, out[-1])) for line in matrix))
    return out[::-1]


def cheapest(rows: str, start: int = START, to_go: Sequence[int] | None = None, prefixes: Prefixes | None = None) -> tuple[int, str, int]:
    """Cost, edits and last state for ``rows`` from ``start``: cheapest, then smallest letters.

    ``to_go`` is what follows from each state; None if nothing does, so that the conversation
    has to be complete, with inserts behind the last row.
    """
    known = prefixes or Prefixes()
    live: list[tuple[int, int] | None] = [None] * STATES
    live[start] = (0, 0)

    def offer(found: list, state: int, cost: int, node: int, letter: str) -> None:
        best = found[state]
        if best is None or cost < best[0]:
            found[state] = (cost, known.add(node, letter))
        elif cost == best[0]:
            new = known.add(node, letter)
            if known.less(new, best[1]):
                found[state] = (cost, new)

    def insert(found: list) -> None:
        for a, b in _INSERTS:
            if found[a] is not None:
                offer(found, b, found[a][0] + INSERT_COST, found[a][1], INSERT)

    for row in rows:
        insert(live)
        after: list[tuple[int, int] | None] = [None] * STATES
        for state, best in enumerate(live):
            if best is not None:
                for letter, cost, to in _AFTER[row, state]:
                    offer(after, to, best[0] + cost, best[1], letter)
        live = after
    if to_go is None:
        insert(live)
        to_go = (0, NEVER, NEVER, 0)
    chosen = None
    for state, best in enumerate(live):
        if best is None or to_go[state] >= NEVER:
            continue
        whole = best[0] + to_go[state]
        if chosen is None or whole < chosen[0] or (whole == chosen[0] and known.less(best[1], chosen[2])):
            chosen = (whole, best[0], best[1], state)
    return chosen[1], known.letters(chosen[2]), chosen[3]


def replay(rows: str, edits: str, start: int = START) -> list[tuple[int, str, str | None]]:
    """For every edit the row it changes or comes before, its letter, and the role's initial
    that it leaves (None for a deleted row)."""
    state, at, out = start, 0, []
    for letter in edits:
        if letter == KEEP:
            state = KEPT[state, INITIAL[rows[at]]]
        elif letter != DELETE:
            state = DUE[state]
        out.append((at, letter, None if letter == DELETE else "?sua"[state]))
        at += letter != INSERT
    return out


def illegal_neighbours(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
