"""Deterministic argument lists for functions with typed parameters."""

from __future__ import annotations

import random
import re
from typing import Any

# The seed, the letters of texts and the edge cases of each type.
SEED = 20260630
LETTERS = "abcdeFGHIJklmnoPQRst01_ "
EDGES: dict[str, list] = {"builtins.int": [0, 1, -1], "builtins.float": [0.0, 1.0, -1.0], "builtins.bool": [True, False], "builtins.str": ["", "a", "Ab_1"], "Any": [0, 1]}
_SEQUENCE = re.compile(r"builtins\.(?:list|tuple)\[(.*?)(?:, \.\.\.)?\]$")
_DRAW = {
    "builtins.int": lambda r: r.randint(-25, 25),
    "builtins.float": lambda r: round(r.uniform(-25.0, 25.0), 3),
    "builtins.bool": lambda r: r.random() < 0.5,
    "builtins.str": lambda r: "".join(r.choice(LETTERS) for _ in range(r.randint(0, 10))),
    "Any": lambda r: r.randint(-9, 9),
}


def element(kind: str) -> str | None:
    """The element type of a list or tuple type."""
    m = _SEQUENCE.match(kind)
    return m[1].strip() if m else None


def supported(kind: str) -> bool:
    inner = element(kind)
    return kind in _DRAW if inner is None else supported(inner)


def draw(kind: str, rng: random.Random) -> Any:
    inner = element(kind)
    if inner is None:
        return _DRAW[kind](rng)
    return [draw(inner, rng) for _ in range(rng.randint(0, 6))]


def edges(kind: str) -> list:
    inner = element(kind)
    return EDGES[kind] if inner is None else [[], edges(inner)[:1]]


def sample(kinds: list[str], rows: int = 40, seed: int = SEED) -> list[list] | None:
    """Edge cases side by side, shorter ones repeated, then ``rows`` drawn lists; None if a type is unknown."""
    if not kinds:
        return [[]]
    if not all(map(supported, kinds)):
        return None
    columns = [edges(k) for k in kinds]
    fixed = [[own[i % len(own)] for own in columns] for i in range(max(map(len, columns)))]
    rng = random.Random(seed)
    return fixed + [[draw(k, rng) for k in kinds] for _ in range(rows)]
