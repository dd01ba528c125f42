"""Greedy chains followed through rows in order of time, with only the open ends held.

In order of frame and loc_id, a row goes to the chain that opened first among those whose end is near enough in place and time;
without one it opens a chain. An end is held while a row may still reach it, so memory follows the ends open at once and not the
rows that pass.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: What a followed row carries: its own place, and the chain's first row.
FOLLOWED = "`group` {kind}, loc_id long, frame long, x double, y double, opener long, opener_frame long"


class OpenChains:
    """Ends (opener_frame, opener, frame, x, y) by cell, in each cell by age of the chain."""

    def __init__(self, r: float, span: int):
        self.reach, self.span, self.side = r * r, span, r * (1 + 1e-9) or 1.0
        self.cells: dict[tuple[int, int], list[tuple]] = {}
        self.fresh: list[tuple] = []
        self.now: int | None = None
        self.held, self.bound = 0, 1000

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.side), math.floor(y / self.side)

    def _advance(self, frame: int) -> None:
        """Ends of the last frame can be reached from now on; those too old are forgotten once they may be half of all."""
        self.now = frame
        for end in self.fresh:
            insort(self.cells.setdefault(self._cell(end[3], end[4]), []), end)
        self.held += len(self.fresh)
        self.fresh = []
        if self.held > self.bound:
            alive = {c: [e for e in ends if frame - e[2] <= self.span] for c, ends in self.cells.items()}
            self.cells = {c: ends for c, ends in alive.items() if ends}
            self.held = sum(map(len, self.cells.values()))
            self.bound = 2 * self.held + 1000

    def carry(self, opener_frame: int, opener: int, frame: int, x: float, y: float) -> None:
        """An end from an earlier range of frames."""
        self.fresh.append((opener_frame, opener, frame, x, y))

    def take(self, loc_id: int, frame: int, x: float, y: float) -> tuple[int, int]:
        """(opener_frame, opener) of the chain that this row goes to."""
        if frame != self.now:
            self._advance(frame)
        cx, cy = self._cell(x, y)
        best, place = None, None
        for cell in ((i, j) for i in (cx - 1, cx, cx + 1) for j in (cy - 1, cy, cy + 1)):
            ends, k = self.cells.get(cell, ()), 0
            while k < len(ends):
                end = ends[k]
                if frame - end[2] > self.span:
                    del ends[k]
                    self.held -= 1
                    continue
                if best is not None and end > best:
                    break
                if (x - end[3]) ** 2 + (y - end[4]) ** 2 <= self.reach:
                    best, place = end, (ends, k)
                    break
                k += 1
        if place is not None:
            ends, k = place
            del ends[k]
            self.held -= 1
        key = (frame, loc_id) if best is None else best[:2]
        self.fresh.append((*key, frame, x, y))
        return key


def follow(batches: Iterable[pa.RecordBatch], r: float, span: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, group, loc_id, frame, x, y, opener, opener_frame), in order of root, frame and loc_id, with their chain's opener;
    those that come with one are ends carried over, and are not passed on."""
    root, open_chains = None, OpenChains(r, span)
    for batch in batches:
        own = batch.column("opener").is_null()
        openers, frames = [], []
        for part, loc_id, frame, x, y, opener, opened in zip(*[batch.column(c).to_pylist() for c in ("root", "loc_id", "frame", "x", "y", "opener", "opener_frame")], strict=True):
            if part != root:
                root, open_chains = part, OpenChains(r, span)
            if opener is not None:
                open_chains.carry(opened, opener, frame, x, y)
                continue
            opened, opener = open_chains.take(loc_id, frame, x, y)
            openers.append(opener)
            frames.append(opened)
        names = ["group", "loc_id", "frame", "x", "y"]
        kept = [batch.column(c).filter(own) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(openers, pa.int64()), pa.array(frames, pa.int64())], [*names, "opener", "opener_frame"])
