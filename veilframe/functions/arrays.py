"""Folds that emit rows. Spark copies what a fold has gathered at every step, so rows gathered over the whole array would
cost their square. Here a first fold, which gathers a state for each block of items, tells the state at which each block
begins; then every block is folded on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
Step = Callable[[Column, Column], tuple[dict[str, Column], Column, Column | None]]


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def emitted(items: Column, state: dict[str, Column], step: Step, kind: str) -> Column:
    """array<kind>: the rows that a fold over items emits, in order.

    step(state, item) gives the next state, a row and whether it is emitted (None: always).
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(*[v.alias(k) for k, v in state.items()])

    def moved(acc: Column, x: Column) -> Column:
        after = step(acc, x)[0]
        return F.struct(*[after[k].alias(k) for k in state])

    def gathered(acc: Column, x: Column) -> Column:
        after, row, keep = step(acc["s"], x)
        out = F.concat(acc["out"], F.array(row))
        return F.struct(F.struct(*[after[k].alias(k) for k in state]).alias("s"), (out if keep is None else F.when(keep, out).otherwise(acc["out"])).alias("out"))

    def blocks(every: Column) -> Column:
        part = lambda b: F.slice(every, b * BLOCK + 1, F.lit(BLOCK))
        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / BLOCK).cast("int"))
        # the states at the blocks' beginnings; the last block's end isn't needed
        begins = F.aggregate(F.slice(numbers, 1, F.size(numbers) - 1), F.array(start), lambda acc, b: F.concat(acc, F.array(F.aggregate(part(b), F.element_at(acc, -1), moved))))
        one = lambda s, b: F.aggregate(part(b), F.struct(s.alias("s"), none.alias("out")), gathered, lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(begins.alias("s"), numbers.alias("b")), lambda x: one(x["s"], x["b"])))

    return bound(items, blocks)
