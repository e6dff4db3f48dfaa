"""The sweep kernel: sorted rows of latitude strips against an active set ordered by longitude.

It runs inside ``mapInArrow`` over partitions sorted by (cell, lon). Rows of one cell pass once; kept are only the
points and items whose longitude can still meet rows to come, so memory follows the window and not the cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are tried at once.
CHUNK = 1_000_000

Columns = dict[str, np.ndarray]


def window_pairs(point_lon: np.ndarray, item_lon: np.ndarray, back: float, ahead: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with item_lon in [point_lon - back, point_lon + ahead], at most CHUNK at a time; item_lon is sorted."""
    lo = np.searchsorted(item_lon, point_lon - back, "left")
    ends = np.cumsum(np.maximum(np.searchsorted(item_lon, point_lon + ahead, "right") - lo, 0))
    total = int(ends[-1]) if len(ends) else 0
    for start in range(0, total, CHUNK):
        flat = np.arange(start, min(total, start + CHUNK))
        p = np.searchsorted(ends, flat, "right")
        yield p, lo[p] + flat - np.where(p > 0, ends[p - 1], 0)


def sweep(
    batches: Iterator[pa.RecordBatch],
    cell: str,
    columns: list[str],
    window: Callable[[int], tuple[float, float]],
    keep: Callable[[Columns, Columns], np.ndarray],
    result: Callable[[Columns, Columns], pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """Pairs of points (is_item false) and items of one cell for which ``keep`` holds, each once.

    window(key of the cell) gives how far back and ahead of a point's longitude items matter.
    """
    fields = [*columns, "lon"]
    key: int | None = None
    points: Columns = {}
    items: Columns = {}

    def some(p: Columns, i: Columns, back: float, ahead: float) -> Iterator[pa.RecordBatch]:
        if not len(p["lon"]) or not len(i["lon"]):
            return
        for a, b in window_pairs(p["lon"], i["lon"], back, ahead):
            left, right = {f: p[f][a] for f in fields}, {f: i[f][b] for f in fields}
            ok = keep(left, right)
            if ok.any():
                yield result({f: v[ok] for f, v in left.items()}, {f: v[ok] for f, v in right.items()})

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(cell).to_numpy(zero_copy_only=False)
        every = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in fields}
        is_item = batch.column("is_item").to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            k, mask = int(keys[start]), is_item[start:end]
            new_points = {f: v[start:end][~mask] for f, v in every.items()}
            new_items = {f: v[start:end][mask] for f, v in every.items()}
            back, ahead = window(k)
            if k != key:
                key, points, items = k, {f: v[:0] for f, v in new_points.items()}, {f: v[:0] for f, v in new_items.items()}
            yield from some(points, new_items, back, ahead)
            items = {f: np.concatenate([items[f], new_items[f]]) for f in fields}
            yield from some(new_points, items, back, ahead)
            last = every["lon"][end - 1]
            old = items["lon"] < last - back
            items = {f: v[~old] for f, v in items.items()}
            points = {f: np.concatenate([points[f], new_points[f]]) for f in fields}
            old = points["lon"] < last - ahead
            points = {f: v[~old] for f, v in points.items()}
