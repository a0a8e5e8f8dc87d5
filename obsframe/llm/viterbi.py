"""Cheapest repair of a sequence of roles, as a product of small (min, +) steps.

A state says what stands before: nothing, a system row, a user row, an assistant row.  What may follow is one role only
(the first row may be system as well), so a state and an edit fix the role that an edited or inserted row gets, and an
audit (the initials of the edits) fixes the repair.
"""

from __future__ import annotations

from functools import cache

# The price of each edit; a truncated row that stays costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_FAR = 1 << 30
Vector = tuple[int, int, int, int]

# What a live row is: the initial of its role (o: any other), upper case if it is truncated.
CODES = "suaoSUAO"
# Costs from behind the last row to an end that may stand: nothing at all, or an assistant row.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def normal(vector: Vector) -> Vector:
    """The vector less its least entry: two that differ by a constant have the same."""
    least = min(vector)
    return tuple(x - least for x in vector)


def _edits(code: str, state: int, after: Vector):
    """(letter, cost to the end, next state) of what can be done with a row."""
    late = TRUNCATED if code.isupper() else 0
    yield "D", DELETE + after[state], state
    if (to := _KEPT.get((code.lower(), state))) is not None:
        yield "K", KEEP + late + after[to], to
    yield "R", REROLE + late + after[_NEXT[state]], _NEXT[state]


@cache
def before(code: str, after: Vector) -> Vector:
    """Costs to the end from before a row, given those from behind it."""
    own = [min(cost for _, cost, _ in _edits(code, q, after)) for q in range(4)]
    # One insertion, or two; three lead back.
    return tuple(min(own[q], INSERT + own[_NEXT[q]], 2 * INSERT + own[_NEXT[_NEXT[q]]]) for q in range(4))


@cache
def step(code: str, after: Vector) -> Vector:
    return normal(before(code, after))


@cache
def choose(code: str, state: int, after: Vector) -> tuple[str, int]:
    """The least letters of a cheapest way over a row, insertions first, and the state behind it."""
    costs, letters = before(code, after), ""
    while True:
        for letter, cost, to in sorted(_edits(code, state, after)):
            if letter > "I" and costs[state] == INSERT + costs[_NEXT[state]]:
                break  # an insertion is less than K and R, but not less than D
            if cost == costs[state]:
                return letters + letter, to
        letters, state = letters + "I", _NEXT[state]


def finish(state: int) -> str:
    """The insertions behind the last row."""
    return "I" * (END[state] // INSERT)


def roles(letters: str, state: int, role: str) -> tuple[list[str], str | None, int]:
    """What an audit piece does to a row of that role: inserted roles, the row's role (None: deleted), the state behind."""
    inserted = []
    for letter in letters:
        if letter == "I":
            state = _NEXT[state]
            inserted.append(_ROLE[state])
        elif letter == "D":
            return inserted, None, state
        elif letter == "K":
            return inserted, role, _KEPT[role[:1], state]
        else:
            return inserted, _ROLE[_NEXT[state]], _NEXT[state]
    return inserted, None, state


def cost(letters: str, truncated: bool) -> int:
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    return sum(price[x] for x in letters) + (TRUNCATED if truncated and letters[-1:] in ("K", "R") else 0)


def backward(codes: str, tail: Vector) -> Vector:
    """Normal costs before a chunk from those behind it."""
    for code in reversed(codes):
        tail = step(code, tail)
    return tail


def parallel(codes: str, old: Vector, new: Vector) -> bool:
    """Whether both tails give the same normal costs before the chunk; stops where they become parallel."""
    for code in reversed(codes):
        if old == new:
            return True
        old, new = step(code, old), step(code, new)
    return old == new


def vectors(codes: str, tail: Vector) -> list[Vector]:
    """Normal costs behind each row of a chunk."""
    out = [tail]
    for code in reversed(codes[1:]):
        out.append(step(code, out[-1]))
    return out[::-1] if codes else []


def trace(codes: str, state: int, tail: Vector) -> tuple[list[str], int]:
    """The letters of each row of a chunk, and the state behind it."""
    out = []
    for code, after in zip(codes, vectors(codes, tail), strict=True):
        letters, state = choose(code, state, after)
        out.append(letters)
    return out, state


def exits(codes: str, tail: Vector) -> list[int]:
    """The state behind a chunk for each state before it."""
    states = list(range(4))
    for code, after in zip(codes, vectors(codes, tail), strict=True):
        states = [choose(code, q, after)[1] for q in states]
    return states


def matrix(codes: str) -> list[int]:
    """Sixteen entries: the costs before a chunk for each tail that allows one state alone."""
    columns = []
    for q in range(4):
        vector = tuple(0 if x == q else _FAR for x in range(4))
        total = 0
        for code in reversed(codes):
            vector = before(code, vector)
            low = min(vector)
            total, vector = total + low, tuple(min(x - low, _FAR) for x in vector)
        columns.append([total + x if x < _FAR // 2 else _FAR * 2 for x in vector])
    return [columns[q][state] for state in range(4) for q in range(4)]


def product(entries: list[int], tail: Vector) -> Vector:
    return normal(tuple(min(entries[4 * state + q] + tail[q] for q in range(4)) for state in range(4)))
