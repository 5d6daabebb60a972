"""A resumable, elastic reader of a permutation for training processes.

The split is cut into `rank_count * workers` shares by position.  A share is one sorted read whose
partitions come to the consumer one after the other, the next one ahead of its turn; transforms run in a
small pool, in order.  state() is the number of samples each share gave, so any number of ranks
and workers can resume what another number read.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..plans.permutation import ordered_rows

READ_BATCH, PREFETCH = 64, 4
POLICIES = ("raise", "skip", "warn")


class StreamingDataset:
    def __init__(self, permutation, rank: int = 0, world_size: int = 1, worker: int = 0, workers: int = 1, batch_size: int = READ_BATCH, prefetch: int = PREFETCH, transform: Callable[[dict], object] | None = None, on_error: str = "raise") -> None:
        if not 0 <= rank < world_size or not 0 <= worker < workers:
            raise ValueError("rank and worker must lie below their counts")
        if on_error not in POLICIES:
            raise ValueError(f"on_error is one of {POLICIES}")
        self._permutation, self._batch, self._prefetch = permutation, batch_size, prefetch
        self._share, self._shares = rank * workers + worker, world_size * workers
        self._transform, self._on_error = transform, on_error
        self._start = 0  # positions below it are done, by whatever shares there were
        self._done = 0

    def __len__(self) -> int:
        n = self._permutation.count() - self._start
        return max(0, (n - self._share + self._shares - 1) // self._shares)

    def _mine(self, start: int):
        """(position, columns) of this share's rows from a position on."""
        p = self._permutation
        return p._frame(p.row_ids().filter((F.col("position") >= start) & ((F.col("position") - self._start) % self._shares == self._share)))

    def __iter__(self) -> Iterator:
        rows = (r.asDict(recursive=True) for r in ordered_rows(self._mine(self._start + self._done * self._shares)))
        plain = ({c: v for c, v in row.items() if c != "position"} for row in rows)
        if self._transform is None:
            for row in plain:
                self._done += 1
                yield row
            return
        with ThreadPoolExecutor(self._prefetch) as pool:
            while block := list(itertools.islice(plain, self._batch)):
                for made in [pool.submit(self._transform, row) for row in block]:
                    self._done += 1
                    try:
                        out = made.result()
                    except Exception as failed:
                        if self._on_error == "raise":
                            raise
                        if self._on_error == "warn":
                            warnings.warn(f"a sample was skipped: {failed}", stacklevel=2)
                        continue
                    yield out

    def state_dict(self) -> dict:
        """All shares advance alike, so the samples that one gave tell what is done."""
        return {"position": self._start + self._done * self._shares, "share": self._share, "shares": self._shares}

    def load_state_dict(self, state: dict) -> None:
        self._start, self._done = state["position"], 0

    def frame(self):
        """The rows of this share as a DataFrame, in order."""
        return self._mine(self._start).orderBy("position").drop("position")
