"""Walks over arrays: folds that emit something for each element, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose outputs are gathered at a time, so that long arrays aren't copied once per element.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def walk(xs: Column, start: Column, step: Callable[[Column, Column], Column], state: str, out: str) -> Column:
    """Go through ``xs`` with a state of SQL type ``state``. ``step`` gives a struct of the next state ``s``
    and an array of ``out`` to emit, ``out``. The result is a struct of the last state and all that was emitted."""
    none, kind = F.array().cast(f"array<{out}>"), f"struct<s:{state},out:array<{out}>>"

    # what a step gives is appended by the next one, so that no let-binding is needed for it
    def said(a: Column) -> Column:
        return F.concat(a["out"], a["r"]["out"])

    def at(s: Column) -> Column:
        return F.struct(F.struct(s.alias("s"), none.alias("out")).cast(kind).alias("r"), none.alias("out"))

    def one(a: Column, x: Column) -> Column:
        return F.struct(step(a["r"]["s"], x).cast(kind).alias("r"), said(a).alias("out"))

    def gathered(a: Column) -> Column:
        return F.concat(a["blocks"], F.array(said(a["g"])))

    def block(a: Column, b: Column) -> Column:
        return F.struct(F.aggregate(b, at(a["g"]["r"]["s"]), one).alias("g"), gathered(a).alias("blocks"))

    def whole(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda i: F.slice(items, i * _BLOCK + 1, F.lit(_BLOCK)))
        zero = F.struct(at(start.cast(state)).alias("g"), F.array().cast(f"array<array<{out}>>").alias("blocks"))
        return F.aggregate(blocks, zero, block, lambda a: F.struct(a["g"]["r"]["s"].alias("s"), F.flatten(gathered(a)).alias("out")))

    return let(xs, whole)


def going(state: Column, *said: Column) -> Column:
    """What a step of :func:`walk` gives: the next state, and what it emits."""
    return F.struct(state.alias("s"), F.array(*said).alias("out"))


def settle(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` evaluated once per row, last in order: they pass through a generator of one
    row, below which the optimizer doesn't copy their expressions into what stands above."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))
