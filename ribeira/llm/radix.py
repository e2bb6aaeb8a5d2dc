"""Global ranks by a distributed radix sort from the least significant digit.

The sort keys are long columns, each cut into digits of ``DIGIT`` bits over the range it really has; a column without values at a digit has
no pass for it. One pass moves every row once:

1. Each block of at most ``BLOCK`` rows, in its present order, counts its rows by digit; a row notes its place among the block's rows of its digit.
2. The rows of smaller digits, and of the same digit in earlier blocks, give each (block, digit) its global offset: totals of at most
   2^``DIGIT`` digits are added up on the driver, the blocks within a digit by a window over that digit.
3. Offset plus place is the row's destination: its block is the quotient by ``BLOCK``, its slot there the remainder. The next pass puts
   the rows of a block into their slots.

Equal digits keep their order, so that after the last pass rows are ordered by all keys and the destination is the rank. No task holds more
than one block, whatever the keys; every pass is a table in the shared work folder, so that lost executors repeat only their part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribeira.session import materialize

DIGIT = 11
BLOCK = 1 << 14

Digit = Callable[[pa.Table], np.ndarray]


def _null_digit(name: str) -> Digit:
    return lambda table: pc.is_null(table[name]).to_numpy(zero_copy_only=False).astype(np.int32)


def _value_digit(name: str, edge: int, sign: int, shift: int, bits: int) -> Digit:
    """Bits ``shift`` and up of the distance from ``edge``, the first value in the order wanted; a null has zeros."""

    def digit(table: pa.Table) -> np.ndarray:
        values = pc.fill_null(table[name], edge).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        first = np.array([edge], np.int64).view(np.uint64)
        distance = values - first if sign > 0 else first - values  # wraps around, so the full range of a long is right
        return (distance >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int32)

    return digit


def digits_of(rows: DataFrame, keys: list[tuple[str, bool]], bits: int = DIGIT) -> list[Digit]:
    """The digits of ``keys`` (column, ascending), the least significant one first; nulls come last in either order."""
    ranges = rows.agg(
        *[f(F.col(name)).alias(f"{kind}{at}") for at, (name, _) in enumerate(keys) for kind, f in (("low", F.min), ("high", F.max))],
        *[F.count_if(F.col(name).isNull()).alias(f"null{at}") for at, (name, _) in enumerate(keys)],
    ).first()
    digits: list[Digit] = []
    for at, (name, ascending) in reversed(list(enumerate(keys))):
        low, high = ranges[f"low{at}"], ranges[f"high{at}"]
        if low is not None:
            edge, sign = (low, 1) if ascending else (high, -1)
            digits += [_value_digit(name, edge, sign, shift, bits) for shift in range(0, (high - low).bit_length(), bits)]
        if ranges[f"null{at}"]:
            digits.append(_null_digit(name))
    return digits


def count_digits(table: pa.Table, digit: Digit) -> pa.Table:
    """Adds ``digit`` and ``place``, the number of earlier rows with that digit."""
    values = digit(table)
    order = np.argsort(values, kind="stable")
    counts = np.bincount(values, minlength=1)
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    return table.append_column("digit", pa.array(values, pa.int32())).append_column("place", pa.array(place))


def put_in_slots(table: pa.Table, block: int) -> pa.Table:
    """The rows of one block in the order of their destinations."""
    slots = table["destination"].to_numpy() % block
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    return table.take(pa.array(order))


def _first_pass(names: list[str], digit: Digit, block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = pa.Table.from_batches([batch.slice(low, block)]).select(names)
                part = count_digits(part, digit).append_column("block", pa.array(np.full(len(part), number, np.int64)))
                number += 1
                yield from part.to_batches()

    return run


def _later_pass(names: list[str], digit: Digit, block: int):
    def run(table: pa.Table) -> pa.Table:
        placed = put_in_slots(table, block).select([*names, "block"])
        return count_digits(placed, digit).select([*names, "digit", "place", "block"])

    return run


def radix_rank(rows: DataFrame, keys: list[tuple[str, bool]], bits: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 …) in the order of ``keys``: long columns with True for ascending; nulls last.

    Rows with equal keys get different ranks, in the order in which they were read. ``rows`` is read twice and should be a table; it must
    not have columns named ``digit``, ``place``, ``block``, ``destination`` or ``rank``. An empty table gives an empty result.
    """
    names = rows.columns
    digits = digits_of(rows, keys, bits) or [lambda table: np.zeros(len(table), np.int32)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ddl = f"{fields}, digit int, place long, block long"
    now = rows.mapInArrow(_first_pass(names, digits[0], block), ddl)
    for at, following in enumerate([*digits[1:], None]):
        now = materialize(now, f"radix-{at}")
        counts = now.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
        totals = sorted(tuple(r) for r in counts.groupBy("digit").agg(F.sum("n")).collect())
        starts = list(accumulate([n for _, n in totals], initial=0))
        smaller = F.element_at(F.create_map(*[F.lit(x) for (d, _), s in zip(totals, starts) for x in (d, s)]), F.col("digit")) if totals else F.lit(0)
        earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("block", "digit", (smaller + F.coalesce(F.sum("n").over(earlier), F.lit(0))).cast("long").alias("offset"))
        moved = now.join(offsets, ["block", "digit"]).withColumn("destination", F.col("offset") + F.col("place"))
        if following is None:
            return moved.select(*names, (F.col("destination") + 1).alias("rank"))
        moved = moved.select(*names, "destination", F.expr(f"destination div {block}").alias("block"))
        now = moved.groupBy("block").applyInArrow(_later_pass(names, following, block), ddl)
