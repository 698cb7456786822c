"""A streaming source that follows files as they grow.

Offsets hold, for each path, the file's inode and how many bytes have been read.  A file of another
inode is a new one (rotation) and a shorter one was truncated: both are read from the start.  A
deleted file is forgotten.  Whole lines are read; the rest waits for its newline, or for the end of
its file: what a rotated or deleted file still got, and a line that truncation cut off, are given out
too.  As such lines can't be read again, they stand in the offset itself (`_late`).  Files that
nothing was written to for a day are closed until something is; a handle that has gone stale (network file systems)
is opened anew.
"""

from __future__ import annotations

import errno
import glob
import os
import re
import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

CHUNK = 128 << 10
BATCH_BYTES = 64 << 20
IDLE = 24 * 3600


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); format("tail"), options: path (globs, comma-separated),
    ignore (pattern for base names), from_start (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "filename string, line string, seq bigint"

    def simpleStreamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        return TailReader(self.options)


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns = [os.path.abspath(p.removeprefix("file://")) for p in options["path"].split(",")]
        self.ignore = re.compile(options["ignore"]) if options.get("ignore") else None
        self.from_start = options.get("from_start", "false").lower() == "true"
        self.files: dict = {}  # path: the open file, which a rotated or deleted one is read to its end from
        self.partial: dict[str, bytes] = {}  # path: what stood after the last newline

    def paths(self) -> list[str]:
        found = sorted({p for pattern in self.patterns for p in glob.glob(pattern)})
        return [p for p in found if os.path.isfile(p) and not (self.ignore and self.ignore.search(os.path.basename(p)))]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": {}, "partial": {}}

    def initialOffset(self) -> dict:  # noqa: N802
        out: dict = {"_seq": 0}
        for p in self.paths():
            s = os.stat(p)
            out[p] = [s.st_ino, 0 if self.from_start else s.st_size]
            self._follow(p)
        return out

    def read(self, start: dict):
        late, own, end = [], [], {}
        left, paths = BATCH_BYTES, self.paths()
        for p in sorted(k for k in start if not k.startswith("_") and k not in paths):
            late += self._rest(p, *start[p])
        for p in paths:
            try:
                f, s = _opened(p)
            except FileNotFoundError:
                continue
            inode, at = start.get(p, (s.st_ino, 0))
            if inode != s.st_ino:
                late += self._rest(p, inode, at)
                at = 0
            elif s.st_size < at + len(self.partial.get(p, b"")):
                late += [[p, _text(x)] for x in [self.partial.get(p)] if x]
                at = 0
            f.seek(at)
            data = f.read(left)
            while data and b"\n" not in data[-CHUNK:] and b"\n" not in data and (more := f.read(BATCH_BYTES)):
                data += more  # a line of any length
            whole = data[: data.rfind(b"\n") + 1]
            self.partial[p] = data[len(whole) :]
            own += [(p, _text(line)) for line in whole.split(b"\n")[:-1]]
            end[p] = [s.st_ino, at + len(whole)]
            left = max(CHUNK, left - len(whole))
            if whole or time.time() - s.st_mtime < IDLE:
                self._follow(p, f)
            else:
                f.close()
                self._close(p)
        first = int(start.get("_seq", 0))
        rows = [(p, line, first + k) for k, (p, line) in enumerate([*map(tuple, late), *own])]
        end["_seq"] = first + len(rows)
        if late:
            end["_late"] = late
        return iter(rows), end

    def _close(self, p: str) -> None:
        old = self.files.pop(p, None)
        if old:
            old.close()

    def _follow(self, p: str, f=None) -> None:
        self._close(p)
        try:
            self.files[p] = f or open(p, "rb")
        except FileNotFoundError:
            self.partial.pop(p, None)

    def _rest(self, p: str, inode: int, at: int) -> list[list[str]]:
        """The lines from `at` on of the file that was at p: it is still open, or stands beside under another name."""
        f, partial = self.files.pop(p, None), self.partial.pop(p, b"")
        try:
            same = f is not None and os.fstat(f.fileno()).st_ino == inode
        except OSError as why:
            if why.errno != errno.ESTALE:
                raise
            same = False
        if f and not same:
            f.close()
            f = None
        if f is None and os.path.isdir(os.path.dirname(p)):
            with os.scandir(os.path.dirname(p)) as found:
                f = next((open(x.path, "rb") for x in found if x.is_file() and x.inode() == inode), None)
        if f is None:
            return [[p, _text(partial)]] if partial else []
        with f:
            f.seek(at)
            return [[p, _text(line)] for line in _lines(f.read())]

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        """The same rows again, after a failure, from files that are still there."""
        rows = [tuple(x) for x in end.get("_late", [])]
        for p, (inode, stop) in sorted((k, v) for k, v in end.items() if not k.startswith("_")):
            own, at = start.get(p, (inode, 0))
            at = at if own == inode and at <= stop else 0
            try:
                with open(p, "rb") as f:
                    f.seek(at)
                    data = f.read(max(0, stop - at))
            except FileNotFoundError:
                continue
            rows += [(p, _text(line)) for line in data.split(b"\n")[:-1]]
        first = int(start.get("_seq", 0))
        return iter([(p, line, first + k) for k, (p, line) in enumerate(rows)])


def _opened(p: str, tries: int = 3):
    """The open file at p and its status; a stale handle is given up for a new one."""
    while True:
        f = open(p, "rb")
        try:
            return f, os.fstat(f.fileno())
        except OSError as why:
            f.close()
            tries -= 1
            if why.errno != errno.ESTALE or not tries:
                raise


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def _lines(data: bytes) -> list[bytes]:
    """All lines, the last one without a newline too."""
    parts = data.split(b"\n")
    return parts if parts[-1] else parts[:-1]
