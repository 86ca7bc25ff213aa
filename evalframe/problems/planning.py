"""Shortest plans in the blocks world: a breadth-first search of up to six blocks for each distinct pair of configurations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

State = frozenset[tuple[str, ...]]
#: Pairs of configurations that a task remembers.
REMEMBERED = 50_000


def _next(state: State) -> Iterator[State]:
    for stack in state:
        rest, top = state - {stack}, stack[-1:]
        left = rest | {stack[:-1]} if len(stack) > 1 else rest
        if len(stack) > 1:
            yield frozenset(left | {top})
        for other in rest:
            yield frozenset((left - {other}) | {other + top})


def shortest(begin: list[list[str]], end: list[list[str]]) -> int | None:
    """Least number of moves between two sets of stacks (bottom first); null if their blocks differ."""
    goal = frozenset(tuple(s) for s in end)
    seen = level = {frozenset(tuple(s) for s in begin)}
    moves = 0
    while level and goal not in level:
        level = {n for s in level for n in _next(s)} - seen
        seen = seen | level
        moves += 1
    return moves if level else None


def least_moves(begin: Column, end: Column) -> Column:
    """``shortest`` of two columns of stacks; each pair of configurations is searched once in a task."""
    known: dict[tuple[State, State], int | None] = {}

    @F.pandas_udf("int")
    def search(begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for b, e in zip(begins, ends, strict=True):
            if b is None or e is None:
                out.append(None)
                continue
            pair = frozenset(map(tuple, b)), frozenset(map(tuple, e))
            if pair not in known:
                if len(known) > REMEMBERED:
                    known.clear()
                known[pair] = shortest(b, e)
            out.append(known[pair])
        return pd.Series(out, dtype="Int32")

    return search(begin, end)

