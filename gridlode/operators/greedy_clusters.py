"""Greedy radius clusters of map points, zoom by zoom, in rounds of local minima.

At a zoom the items (points, or the clusters of the zoom above) are gone through in a fixed order: one that no earlier
centre has taken becomes a centre and takes all free items within `radius` pixels of it. That is the same as: an item is a
centre if no earlier item within the radius is one, and every other item belongs to its earliest centre. So no item
has to wait for its turn: in a round every free item that comes before all free items within the radius becomes a
centre, and what lies within the radius of the new centres is no longer free. The order is a hash of the key, then the key:
in a random order the number of rounds is logarithmic with high probability, where an order by place can need as
many rounds as there are items in a row.

Most items are decided without rounds between tasks: a view is a block of the map with what lies up to HALO radii around
it, sent to one task, which goes through the rounds inside of it. An item whose circle leaves the view is blind there: it
can be taken, but it becomes no centre. So all that a view finds holds for the whole map, and of its block it gives
the sums of each centre. What it can't tell, as it hangs on items further away, and the blocks with more rows or pairs than
a task should hold go on to the rounds over all tasks, which are the exact way for the rest.

In these rounds cells are so small that two items of one cell are always within the radius. So only the first free item of a cell can
become a centre, and a free item meets the first ones of the cells in its block and next to it, a hundred at most,
never the other items of a dense place. Blocks are salted: one with a third of all items is FAN groups.

Places are whole numbers, UNITS to the width of the world (4 cm at the equator), and means of places are rounded down: the
same clusters at any number of partitions. The map does not go around at the date line.

Defined results: rows without a key or place are left out, as are places that aren't finite; latitudes beyond the
square map lie on its edge; null weights count as 0; rows that repeat a key at one place are one item that counts
each of them, and at different places are items of their own, ordered by place; an empty table has no clusters; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import parts, small, stored

UNITS = 1 << 30
#: Pixels of the world's width at zoom 0.
PIXELS = 512
#: Parts of a block's items.
FAN = 256
#: Width of a block in radii: a first one is sent to 2.25 blocks on average.
BLOCK = 4
#: Width of a view's block and what it sees around it, in radii.
VIEW, HALO = 128, 8
#: A view with more rows or pairs of near items isn't decided in one task.
MOST_ROWS, MOST_PAIRS = 200_000, 8_000_000
#: Rows of views that a task decides together.
TOGETHER = 50_000
_ROW = 1 << 31
_ORDER = ("_h", "_key", "_x", "_y")
#: What is summed over a centre's items: places by their high and low 15 bits, so that sums fit.
_SUMS = ("_n", "_w", "_xh", "_xl", "_yh", "_yl")
#: A centre with the sums of all its items, an item that has a centre but not surely the earliest, one that may be a centre,
#: and a centre with the sums of those of its items that lie in one block.
OWN, TAKEN, FREE, PART = 0, 1, 2, 3


def _items(points: DataFrame, key: str, lon: str, lat: str, weight: str) -> DataFrame:
    """An item for each place: rows of one place have the same neighbours, so the first of them stands for all."""
    edge = F.lit(89.9)  # beyond the square map, and short of the pole
    sine = F.sin(F.radians(F.greatest(F.least(F.col(lat).cast("double"), edge), -edge)))
    x = F.col(lon).cast("double") / 360 + 0.5
    y = 0.5 - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)
    whole = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (UNITS - 1)).cast("long")
    real = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) <= 1000)
    rows = points.where(F.col(key).isNotNull() & real(lon) & real(lat)).select(
        F.xxhash64(key).alias("_h"), F.col(key).alias("_key"), whole(x).alias("_x"), whole(y).alias("_y"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"))
    grouped = rows.groupBy("_x", "_y").agg(F.min(F.struct("_h", "_key")).alias("_a"), F.count("*").alias("_n"), F.sum("_w").alias("_w"))
    return grouped.select("_a._h", "_a._key", "_x", "_y", "_n", "_w")


def _in_views(items: DataFrame, reach: int) -> DataFrame:
    """items once for each view that they lie in, each view's in one partition and in their order."""
    width, halo = VIEW * reach, HALO * reach
    end = F.lit((UNITS - 1) // width)
    touched = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / width), F.lit(0)), F.least(F.floor((F.col(c) + halo) / width), end))
    views = F.flatten(F.transform(touched("_x"), lambda i: F.transform(touched("_y"), lambda j: i * _ROW + j)))
    return items.select(F.explode(views).alias("_view"), *_ORDER, "_n", "_w").repartition(parts(items), "_view").sortWithinPartitions("_view", *_ORDER)


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def _at_home(rows: pa.Table, reach: int) -> np.ndarray:
    """Which rows lie in the block of their view."""
    x, y, view = _numbers(rows, "_x", "_y", "_view")
    return (x // (VIEW * reach) == view // _ROW) & (y // (VIEW * reach) == view % _ROW)


def _summed(rows: pa.Table, own: np.ndarray, centres: pa.Table, state: np.ndarray) -> pa.Table:
    """centres with their state and the sums of rows; own: the place of each row's centre, in rising order, all of them there."""
    x, y, n, w = _numbers(rows, "_x", "_y", "_n", "_w")
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    sums = [np.add.reduceat(v, begins) if len(begins) else v for v in (n, w, (x >> 15) * n, (x & 32767) * n, (y >> 15) * n, (y & 32767) * n)]
    return pa.table([*(centres.column(c) for c in _ORDER), state, *sums], names=[*_ORDER, "_state", *_SUMS])


def _undecided(rows: pa.Table, reach: int) -> pa.Table:
    home = rows.filter(pa.array(_at_home(rows, reach)))
    return _summed(home, np.arange(len(home)), home, np.full(len(home), FREE))


def _earlier(rows: pa.Table, reach: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs of a row and an earlier one of its view within reach; None if they are too many to try."""
    x, y, view = _numbers(rows, "_x", "_y", "_view")
    across = VIEW + 2 * HALO + 4  # cells as wide as reach, a free one on each side
    column = lambda v, at: (v - at * (VIEW * reach)) // reach + HALO + 1
    cell = (np.cumsum(np.diff(view, prepend=view[:1]) != 0) * across + column(x, view // _ROW)) * across + column(y, view % _ROW)
    by = np.argsort(cell, kind="stable")
    cells, pairs = cell[by], []
    spans = [(np.searchsorted(cells, cell + d - 1, "left"), np.searchsorted(cells, cell + d + 1, "right")) for d in (-across, 0, across)]
    if sum(int((end - begin).sum()) for begin, end in spans) > MOST_PAIRS:
        return None
    for begin, end in spans:
        count = end - begin
        late = np.repeat(np.arange(len(cell)), count)
        early = by[np.arange(len(late)) + np.repeat(begin - np.cumsum(count) + count, count)]
        late, early = late[early < late], early[early < late]
        near = (x[late] - x[early]) ** 2 + (y[late] - y[early]) ** 2 <= reach * reach
        pairs.append((late[near], early[near]))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _decided(rows: pa.Table, reach: int) -> Iterator[pa.Table]:
    """Whole views -> the centres with the sums of the items in the views' blocks, and the items that remain to be decided."""
    pairs = _earlier(rows, reach)
    x, y, view = _numbers(rows, "_x", "_y", "_view")
    if pairs is None:
        middle = np.searchsorted(view, view[len(view) // 2])
        middle = middle or np.searchsorted(view, view[0], "right")
        if middle == len(view):
            yield _undecided(rows, reach)
        else:
            yield from _decided(rows.slice(0, middle), reach)
            yield from _decided(rows.slice(middle), reach)
        return
    outside = lambda v, at: (v - at * (VIEW * reach) < (1 - HALO) * reach) | (v - at * (VIEW * reach) >= (VIEW + HALO - 1) * reach)
    blind = outside(x, view // _ROW) | outside(y, view % _ROW)
    none = len(rows)
    state, (late, early) = np.full(none, FREE), pairs
    while True:  # pairs of two free ones; who is the later one in none becomes a centre
        waits = blind.copy()
        waits[late] = True
        new = (state == FREE) & ~waits
        if not new.any():
            break
        state[new] = OWN
        state[late[new[early]]] = TAKEN
        both = (state[late] == FREE) & (state[early] == FREE)
        late, early = late[both], early[both]

    def first(what):  # the earliest one near, by writing it last
        late, early = (p[state[pairs[1]] == what] for p in pairs)
        back, out = np.argsort(-early, kind="stable"), np.full(none, none)
        out[late[back]] = early[back]
        return out

    own = np.where(state == OWN, np.arange(none), first(OWN))
    sure = (state == OWN) | ((state == TAKEN) & ~blind & (own < first(FREE)))
    home = _at_home(rows, reach)
    mine = np.flatnonzero(home & sure)
    mine = mine[np.argsort(own[mine], kind="stable")]
    centres = np.flatnonzero(np.bincount(own[mine], minlength=none))
    beside = lambda v, at: (v - at * (VIEW * reach) < reach) | (v - at * (VIEW * reach) >= (VIEW - 1) * reach)
    part = (beside(x, view // _ROW) | beside(y, view % _ROW))[centres]
    yield _summed(rows.take(mine), own[mine], rows.take(centres), np.where(part, PART, OWN))
    rest = np.flatnonzero(home & ~sure)
    if len(rest):
        left = rows.take(rest)
        yield _summed(left, np.arange(len(left)), left, state[rest])


def _by_views(items: DataFrame, reach: int) -> DataFrame:
    """Rows of _ORDER, _state and _SUMS: centres with what their views gave them, and items that the views couldn't decide."""
    kinds = {f.name: f for f in items.schema}
    schema = StructType([*(kinds[c] for c in _ORDER), StructField("_state", LongType()), kinds["_n"], kinds["_w"], *(StructField(c, LongType()) for c in _SUMS[2:])])

    def run(batches):
        held, crowded = None, None  # rows of views that may go on, and a view that is too large to hold
        for batch in batches:
            new = pa.Table.from_batches([batch])
            if crowded is not None:
                of_it = np.searchsorted(new.column("_view").to_numpy(), crowded, "right")
                yield from _undecided(new.slice(0, of_it), reach).to_batches()
                new = new.slice(of_it)
                if not len(new):
                    continue
                crowded = None
            held = pa.concat_tables([held, new]) if held is not None else new
            if len(held) < TOGETHER:
                continue
            view = held.column("_view").to_numpy()
            whole = np.searchsorted(view, view[-1])
            if whole:
                for found in _decided(held.slice(0, whole), reach):
                    yield from found.to_batches()
                held = held.slice(whole)
            if len(held) > MOST_ROWS:
                yield from _undecided(held, reach).to_batches()
                held, crowded = None, view[-1]
        if held is not None and len(held):
            for found in _decided(held, reach):
                yield from found.to_batches()

    return _in_views(items, reach).mapInArrow(run, schema)


def _in_cells(items: DataFrame, reach: int) -> DataFrame:
    """items with their cell, whose diagonal is shorter than reach, their block of cells and the part of it."""
    side = max(1, reach * 2 // 3)
    at = lambda width: (F.floor(F.col("_x") / width) * _ROW + F.floor(F.col("_y") / width)).cast("long")
    return items.withColumns({"_cell": at(side), "_block": at(BLOCK * reach), "_part": F.pmod(F.xxhash64("_x", "_y"), F.lit(FAN)).cast("int")})


def _around(items: DataFrame, firsts: DataFrame, reach: int) -> DataFrame:
    """For each part of a block of items (_block, _part) the firsts (_cell, _first) that are in the block or within reach of it, in _near."""
    width = BLOCK * reach
    touched = lambda c: F.sequence(F.floor((F.col(f"_first.{c}") - reach) / width), F.floor((F.col(f"_first.{c}") + reach) / width))
    blocks = F.flatten(F.transform(touched("_x"), lambda i: F.transform(touched("_y"), lambda j: i * _ROW + j)))
    asked = small(items.select("_block").distinct())
    near = firsts.select(F.explode(blocks).alias("_block"), F.struct("_cell", "_first").alias("_n")).join(asked, "_block", "left_semi")
    near = near.groupBy("_block").agg(F.collect_list("_n").alias("_near"))
    return items.select("_block", "_part").distinct().join(near, "_block")


def _within(reach: int):
    def test(n):
        dx, dy = n["_first"]["_x"] - F.col("_x"), n["_first"]["_y"] - F.col("_y")
        return dx * dx + dy * dy <= F.lit(reach * reach)

    return test


def _centres(items: DataFrame, known: DataFrame, reach: int) -> DataFrame | None:
    """The centres (_cell, _first) among items besides the known ones, by rounds."""
    close = _within(reach)

    def not_taken(free, new):
        met = free.join(_around(free, new, reach), ["_block", "_part"], "left")
        return stored(met.where(~F.coalesce(F.exists("_near", close), F.lit(False))).select(*free.columns))

    free, found = not_taken(items.select(*_ORDER, "_cell", "_block", "_part"), known), None
    while not free.isEmpty():
        firsts = stored(free.groupBy("_cell").agg(F.min(F.struct(*_ORDER)).alias("_first")))
        met = free.join(_around(free, firsts, reach), ["_block", "_part"])
        late = met.select(F.explode(F.filter("_near", lambda n: (F.struct(*_ORDER) < n["_first"]) & close(n))).alias("_n")).select("_n._cell").distinct()
        new = stored(firsts.join(late, "_cell", "left_anti"))
        found = new if found is None else found.unionByName(new)
        free = not_taken(free, new)
    return found


def _clusters(items: DataFrame, reach: int) -> DataFrame:
    """Every item in its earliest centre within reach: counts, weights and mean places."""
    made = stored(_by_views(items, reach))
    # only centres near the edges of blocks have items in several
    parted = stored(made.where(F.col("_state") == PART).groupBy(*_ORDER).agg(*[F.sum(c).alias(c) for c in _SUMS]))
    known, rest = made.where(F.col("_state") == OWN).drop("_state").unionByName(parted), made.where(F.col("_state").isin(TAKEN, FREE))
    if not rest.isEmpty():
        rest = _in_cells(rest, reach)
        centres = _in_cells(known, reach).select("_cell", F.struct(*_ORDER).alias("_first"))
        new = _centres(rest.where(F.col("_state") == FREE), centres, reach)
        near = _around(rest, centres if new is None else centres.unionByName(new), reach)
        own = F.array_min(F.transform(F.filter("_near", _within(reach)), lambda n: n["_first"]))
        met = rest.join(near, ["_block", "_part"]).withColumn("_own", own)
        more = stored(met.groupBy("_own").agg(*[F.sum(c).alias(c) for c in _SUMS]).select("_own.*", *_SUMS))
        added = small(more.select(*_ORDER, *[F.col(c).alias(f"_more{c}") for c in _SUMS]))
        both = known.join(added, [*_ORDER], "left").select(*_ORDER, *[(F.col(c) + F.coalesce(f"_more{c}", F.lit(0))).alias(c) for c in _SUMS])
        known = both if new is None else both.unionByName(more.join(small(new.select("_first.*")), [*_ORDER], "left_semi"))
    mean = lambda c: F.expr(f"cast((cast({c}h as decimal(20,0)) * 32768 + cast({c}l as decimal(20,0))) div cast(_n as decimal(19,0)) as long)")
    return known.select("_h", "_key", mean("_x").alias("_x"), mean("_y").alias("_y"), "_n", "_w")


def cluster_levels(points: DataFrame, key: str, weight: str, lon: str = "longitude", lat: str = "latitude", least: int = 0, most: int = 14, radius: int = 50) -> Iterator[tuple[int, DataFrame]]:
    """(zoom, clusters) from zoom `most` down to `least`: key of the centre, lon, lat, point_count and the sum of weight.

    An item that takes nothing is a cluster of its own. Each zoom's clusters are stored tables, made from those of the one before.
    """
    if (radius * UNITS) // (PIXELS << most) < 6:
        raise ValueError(f"{radius} pixels at zoom {most} are less than six units of place")
    items = _items(points, key, lon, lat, weight)
    for zoom in range(most, least - 1, -1):
        reach = (radius * UNITS) // (PIXELS << zoom)
        items = _clusters(items, reach)
        x, y = (F.col("_x") + 0.5) / (UNITS - 1), (F.col("_y") + 0.5) / (UNITS - 1)
        lat_of = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y))))
        yield zoom, items.select(F.col("_key").alias(key), ((x - 0.5) * 360).alias("lon"), lat_of.alias("lat"), F.col("_n").alias("point_count"), F.col("_w").alias(weight))
