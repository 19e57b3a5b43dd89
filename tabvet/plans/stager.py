"""Staged projections: shared intermediate values become named columns.

A check such as "phone number valid for its country" reuses the same intermediate
values (trimmed text, digits, calling code, national number) many times. Written as
one nested expression, each reuse copies the whole sub-tree, which blows up the
plan (optimizer time) and the generated code. Instead every intermediate value is
added once as a column, in the first projection level after its inputs; later
expressions refer to it by name. Catalyst keeps non-trivial values that are used
more than once in their own projection instead of inlining them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


class Stager:
    def __init__(self, prefix: str = "_s"):
        self.prefix = prefix
        self.levels: list[list[Column]] = []
        self.level_of: dict[str, int] = {}
        self._n = 0

    def add(self, expr: Column, deps: list[str] | tuple[str, ...] = (), name: str | None = None) -> str:
        """Stage ``expr`` (which may refer to staged ``deps``); returns the column name."""
        if name is None:
            name = f"{self.prefix}{self._n}"
            self._n += 1
        lvl = 1 + max((self.level_of[d] for d in deps), default=-1)
        while len(self.levels) <= lvl:
            self.levels.append([])
        self.levels[lvl].append(expr.alias(name))
        self.level_of[name] = lvl
        return name

    def apply(self, df: DataFrame) -> DataFrame:
        """All levels in one ``select``: later columns refer to earlier aliases of the
        same list (lateral column aliases), which the analyzer turns into the stacked
        projections in one pass instead of one analysis per level."""
        cols = [c for level in self.levels for c in level]
        return df.select("*", *cols) if cols else df

