"""Maps of 8 x 8 cells as bitboards: a set of cells is one long, the cell of row y and column x its bit 8 y + x.

Dilation, erosion, opening, connected regions, filled holes and region areas are shifts and masks in column expressions: no row of cells, no
Python worker. Cells outside the map are empty when a set grows and set when it shrinks, so borders neither feed nor erode it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, CELLS = 8, 64
#: A path through 8 x 8 cells that touches itself nowhere has no more steps than this.
LONGEST = 40
#: Regions of an 8 x 8 map, when cells that touch at a corner are one, are no more than this.
MOST = 16


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _columns(keep: Callable[[int], bool]) -> int:
    return sum(1 << i for i in range(CELLS) if keep(i % SIDE))


FULL = (1 << CELLS) - 1
BORDER = sum(1 << i for i in range(CELLS) if i % SIDE in (0, SIDE - 1) or i // SIDE in (0, SIDE - 1))


def both(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def moved(m: Column, dx: int, dy: int) -> Column:
    """All cells dx to the right and dy down; those that leave the map are gone."""
    if dx:
        m = both(m, _long(_columns(lambda x: 0 <= x + dx < SIDE)))
    by = SIDE * dy + dx
    return F.shiftleft(m, by) if by > 0 else F.shiftrightunsigned(m, -by) if by < 0 else m


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an ellipse in a box of ``size``, an odd number: in each row as wide as its chord, rounded."""
    r = size // 2
    chord = lambda dy: round(r * ((r * r - dy * dy) / max(r * r, 1)) ** 0.5)
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-chord(dy), chord(dy) + 1)]


SQUARE = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def dilated(m: Column, offsets: Sequence[tuple[int, int]]) -> Column:
    out = None
    for dx, dy in offsets:
        out = moved(m, dx, dy) if out is None else either(out, moved(m, dx, dy))
    return out


def eroded(m: Column, offsets: Sequence[tuple[int, int]]) -> Column:
    """Cells all of whose neighbours at ``offsets`` are set or outside the map."""
    return F.bitwise_not(dilated(F.bitwise_not(m), [(-dx, -dy) for dx, dy in offsets]))


def opened(m: Column, offsets: Sequence[tuple[int, int]]) -> Column:
    return dilated(eroded(m, offsets), offsets)


def flooded(seed: Column, room: Column, corners: bool) -> Column:
    """What can be reached from ``seed`` within ``room``, by sides or by corners too."""
    step = SQUARE if corners else CROSS
    grow = lambda s, _: F.when(s["done"], s).otherwise(_flood_step(s["m"], room, step))
    first = F.struct(both(seed, room).alias("m"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), first, grow)["m"]


def _flood_step(m: Column, room: Column, step: Sequence[tuple[int, int]]) -> Column:
    # next to one another: a step of both lengths saves a round
    grown = both(dilated(m, step), room)
    return F.struct(grown.alias("m"), (grown == m).alias("done"))


def lowest(m: Column) -> Column:
    """The first cell of a set alone."""
    last = _long(1 << (CELLS - 1))  # its negative is itself, which checked arithmetic refuses
    return F.when(m == last, m).otherwise(both(m, -m))


def regions(m: Column, corners: bool = True) -> Column:
    """The connected regions of a set, as an array of sets, in the order of their first cells."""

    def take(s: Column, _: Column) -> Column:
        one = flooded(lowest(s["left"]), s["left"], corners)
        more = F.struct(without(s["left"], one).alias("left"), F.concat(s["found"], F.array(one)).alias("found"))
        return F.when(s["left"] == 0, s).otherwise(more)

    most = MOST if corners else CELLS // 2
    first = F.struct(m.alias("left"), F.array().cast("array<bigint>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, take)["found"]


def filled(m: Column) -> Column:
    """A set with its holes: cells that can't be reached from the border by sides."""
    outside = F.bitwise_not(m)
    return F.bitwise_not(flooded(both(outside, _long(BORDER)), outside, corners=False))


def area(m: Column) -> Column:
    """The area within the line through a region's outermost cell centres: a square for four cells that meet, half for three."""
    a, b, c, d = m, moved(m, -1, 0), moved(m, 0, -1), moved(m, -1, -1)
    four = both(both(a, b), both(c, d))
    three = either(either(both(both(a, b), c), both(both(a, b), d)), either(both(both(a, c), d), both(both(b, c), d)))
    three = both(without(three, four), _long(sum(1 << i for i in range(CELLS) if i % SIDE < SIDE - 1 and i // SIDE < SIDE - 1)))
    return F.bit_count(four) + F.bit_count(three) / F.lit(2.0)


def large_filled(m: Column, least: float) -> Column:
    """The filled regions (by corners) whose area exceeds ``least``, together."""
    solid = F.transform(regions(m), filled)
    return F.aggregate(F.filter(solid, lambda r: area(r) > F.lit(float(least))), F.lit(0).cast("long"), either)


def board(values: Column, test: Callable[[Column], Column]) -> Column:
    """The cells of an array of 64 numbers that pass a test."""
    bit = lambda x, i: F.when(test(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(values, bit), F.lit(0).cast("long"), either)


def cells(m: Column) -> Column:
    """64 times 0 or 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.getbit(m, i).cast("int"))
