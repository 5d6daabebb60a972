"""A seekable file over one binary value."""

from __future__ import annotations

import io

from pyspark.sql import functions as F

from .snapshot import ROW_ID


class BlobFile(io.RawIOBase):
    """Ranges are cut by the engine; only what is read travels."""

    def __init__(self, table, column: str, row_id: int) -> None:
        self._table, self._column, self._row_id, self._at = table, column, row_id, 0
        found = table.scan().filter(F.col(ROW_ID) == row_id).select(F.octet_length(f"`{column}`").alias("n")).first()
        if found is None or found.n is None:
            raise ValueError(f"row {row_id} has no {column}")
        self.size = found.n

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self.size}[whence])
        return self._at

    def read(self, size: int = -1) -> bytes:
        size = self.size - self._at if size is None or size < 0 else min(size, self.size - self._at)
        out = self.read_range(self._at, size) if size > 0 else b""
        self._at += len(out)
        return out

    def readall(self) -> bytes:
        return self.read()

    def readinto(self, into) -> int:
        out = self.read(len(into))
        into[: len(out)] = out
        return len(out)

    def read_range(self, offset: int, size: int) -> bytes:
        return self._table.fetch_blobs(self._column, [self._row_id], [(offset, size)])[0] or b""
