"""Fewest moves between two told block configurations, for verification: apart from ``planning``, by what each block stands on."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOLD = re.compile(r"(\w) is on (?:the (table)|(\w))\.")
#: Pairs of descriptions that a task remembers.
REMEMBERED = 50_000


def fewest(begin: dict[str, str], end: dict[str, str]) -> int | None:
    """Moves from one support of every block ("" is the table) to another; null if the blocks differ or none lead there."""
    blocks = sorted(begin)
    if blocks != sorted(end):
        return None
    start, goal = (tuple(on[b] for b in blocks) for on in (begin, end))
    steps, queue = {start: 0}, deque([start])
    while queue and goal not in steps:
        now = queue.popleft()
        free = [b for b in blocks if b not in now]
        for b in free:
            k = blocks.index(b)
            for to in {"", *free} - {b, now[k]}:
                then = (*now[:k], to, *now[k + 1 :])
                if then not in steps:
                    steps[then] = steps[now] + 1
                    queue.append(then)
    return steps.get(goal)


def fewest_told(begin: Column, end: Column) -> Column:
    """The same from two descriptions, each pair of them once in a task."""
    known: dict[tuple[str, str], int | None] = {}

    def supports(text: str) -> dict[str, str]:
        return {up: down for up, _, down in TOLD.findall(text)}

    @F.pandas_udf("int")
    def search(begins: pd.Series, ends: pd.Series) -> pd.Series:
        if len(known) > REMEMBERED:
            known.clear()
        for pair in set(zip(begins, ends, strict=True)) - known.keys():
            known[pair] = None if None in pair else fewest(supports(pair[0]), supports(pair[1]))
        return pd.Series([known[pair] for pair in zip(begins, ends, strict=True)], dtype="Int32")

    return search(begin, end)
