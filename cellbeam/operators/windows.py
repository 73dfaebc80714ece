"""Sums over windows of cells, by tiles with a margin: a cell travels to its own tile and to those it borders on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a tile by axis, for images and for volumes.
TILE = {1: 4096, 2: 128, 3: 32}
#: Cells of the tiles that are worked on together, margins included.
STACK = 1 << 20


def over_tiles(cells: DataFrame, key: str, axes: tuple[str, ...], values: tuple[str, ...], reach: int, work: Callable, fields: str, tile: int | None = None) -> DataFrame:
    """``work(known, arrays, inner, origin)`` on every tile of every image, as rows of ``key`` and ``fields``.

    A tile is a box of ``tile`` cells an axis with a margin of ``reach`` on all sides; a cell is sent to each tile
    whose box or margin holds it: few more rows than cells, where windows would send one per window cell. A tile
    bounds what a task holds, whatever the size of an image. Tiles of one shape are worked on together, ``STACK``
    cells at a time, so that many small images cost no step each: the first axis of all arrays is the tile.
    ``known``: which cells there are; ``arrays``: their values, 0 elsewhere (a null value makes its cell missing);
    ``inner``: the tiles without their margins, as slices; ``origin``: the place of each tile's first cell, margin
    included. ``work`` gives columns of equal length, first the number of the tile that a row belongs to.
    """
    tile = tile or TILE[len(axes)]
    home = [F.floor(F.col(a) / tile).cast("long") for a in axes]
    near = [F.array_distinct(F.array(F.floor((F.col(a) - reach) / tile).cast("long"), h, F.floor((F.col(a) + reach) / tile).cast("long"))) for a, h in zip(axes, home, strict=True)]
    at = cells.where(" and ".join(f"{c} is not null" for c in (*axes, *values))).select(F.col(key).alias("__key"), *[F.col(a).cast("long").alias(f"__a{i}") for i, a in enumerate(axes)], *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)], *[n.alias(f"__n{i}") for i, n in enumerate(near)])
    for i in range(len(axes)):
        at = at.withColumn(f"__t{i}", F.explode(f"__n{i}")).drop(f"__n{i}")
    tiles = [f"__t{i}" for i in range(len(axes))]
    kind = cells.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(fields).fields])

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 16:
                table = pa.Table.from_batches(held).combine_chunks()
                last = _groups(table, tiles)[-1]
                yield from several(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield from several(pa.Table.from_batches(held).combine_chunks())

    def several(table):
        starts = np.array(_groups(table, tiles))
        if not table.num_rows:
            return
        many = np.diff(np.append(starts, table.num_rows))
        tile_of = np.repeat(np.arange(len(starts)), many)
        keys = table.column("__key").combine_chunks()
        keys = keys.take(pa.array(starts))
        origin = np.stack([table.column(t).to_numpy()[starts] * tile - reach for t in tiles], 1)
        place = np.stack([table.column(f"__a{i}").to_numpy() for i in range(len(axes))], 1) - origin[tile_of]
        # an image smaller than its tile takes no more room than its cells and the margin
        shapes = np.minimum(tile + 2 * reach, np.maximum.reduceat(place, starts, 0) + 1 + reach)
        kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        # a tile that holds nothing but margin has no window of its own, as beside the first cells of every image
        full = np.logical_or.reduceat(((place >= reach) & (place < reach + tile)).all(1), starts)
        held = [table.column(f"__v{i}").to_numpy() for i in range(len(values))]
        for k, shape in enumerate(kinds.tolist()):
            same = np.flatnonzero((kind == k) & full)
            step = max(1, STACK // int(np.prod(shape)))
            for lo in range(0, len(same), step):
                yield stack(same[lo : lo + step], shape, starts, many, place, held, keys, origin)

    def stack(own, shape, starts, many, place, held, keys, origin):
        """One batch of rows from tiles of one shape."""
        count = many[own]
        which = np.repeat(np.arange(len(own)), count)
        rows = np.repeat(starts[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = (which, *place[rows].T)
        known = np.zeros((len(own), *shape), bool)
        known[at] = True
        arrays = []
        for v in held:
            a = np.zeros(known.shape)
            a[at] = v[rows]
            arrays.append(a)
        inner = (slice(None), *[slice(reach, min(reach + tile, n)) for n in shape])
        which, *out = work(known, arrays, inner, origin[own])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(own[which])), *[pa.array(c) for c in out]], names=[f.name for f in schema.fields])

    ordered = at.repartition("__key", *tiles).sortWithinPartitions("__key", *tiles)
    return ordered.mapInArrow(run, schema)


def _groups(table: pa.Table, tiles: list[str]) -> list[int]:
    """Where the runs of equal image and tile begin."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for c in ("__key", *tiles):
        column = table.column(c).combine_chunks()
        codes = column.dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        k = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= k[1:] != k[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist()] if n else [0]


def box_sum(a: np.ndarray, reach: int, first: int = 0) -> np.ndarray:
    """Sums over windows of ``reach`` cells to all sides, clipped at the array's ends: running sums, axis by axis from ``first`` on."""
    for axis in range(first, a.ndim):
        n = a.shape[axis]
        total = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
        i = np.arange(n)
        a = total.take(np.minimum(i + reach + 1, n), axis) - total.take(np.maximum(i - reach, 0), axis)
    return a
