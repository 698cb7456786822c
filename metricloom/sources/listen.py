"""Lines that come in on sockets or pipes, written to a folder that a stream reads.

The listener takes tcp:// and unix:// (many connections, a line reader for each), udp:// and
unixgram:// (datagrams), and named pipes.  Lines go to files in `spool`, which `stream` follows: what
has been written survives a restart of the query.
"""

from __future__ import annotations

import os
import socket
import stat
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Spool:
    """Files of (source, line), closed when they have `lines` lines or are `seconds` old."""

    def __init__(self, folder: str, lines: int = 5000, seconds: float = 0.25):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.lines, self.seconds = folder, lines, seconds
        self.held: list[str] = []
        self.lock, self.began = threading.Lock(), time.monotonic()

    def put(self, source: str, line: str) -> None:
        with self.lock:
            self.held.append(f"{source}\t{line}\n")
            if len(self.held) >= self.lines:
                self._write()

    def tick(self) -> None:
        with self.lock:
            if self.held and time.monotonic() - self.began >= self.seconds:
                self._write()

    def close(self) -> None:
        with self.lock:
            if self.held:
                self._write()

    def _write(self) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        with open(os.path.join(self.folder, f".{name}"), "w", encoding="utf-8") as f:
            f.writelines(self.held)
        os.rename(os.path.join(self.folder, f".{name}"), os.path.join(self.folder, name))
        self.held, self.began = [], time.monotonic()


class Listener:
    """Listens on one address until it is closed."""

    def __init__(self, address: str, folder: str, **options):
        self.address, self.spool, self.open = address, Spool(folder, **options), True
        scheme, _, where = address.partition("://")
        self.threads = [threading.Thread(target=self._tick, daemon=True)]
        if scheme in ("tcp", "unix", "udp", "unixgram"):
            kind = socket.SOCK_STREAM if scheme in ("tcp", "unix") else socket.SOCK_DGRAM
            self.socket = socket.socket(socket.AF_UNIX if scheme.startswith("unix") else socket.AF_INET, kind)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind(where if scheme.startswith("unix") else (where.rpartition(":")[0] or "0.0.0.0", int(where.rpartition(":")[2])))
            self.socket.settimeout(0.2)
            if kind == socket.SOCK_STREAM:
                self.socket.listen()
            self.threads.append(threading.Thread(target=self._accept if kind == socket.SOCK_STREAM else self._datagrams, daemon=True))
        elif stat.S_ISFIFO(os.stat(where or address).st_mode):
            self.socket = None
            self.threads.append(threading.Thread(target=self._pipe, args=(where or address,), daemon=True))
        else:
            raise ValueError(f"not a socket or pipe: {address}")
        for t in self.threads:
            t.start()

    @property
    def port(self) -> int:
        return self.socket.getsockname()[1]

    def _tick(self) -> None:
        while self.open:
            time.sleep(0.05)
            self.spool.tick()

    def _accept(self) -> None:
        while self.open:
            try:
                peer, _ = self.socket.accept()
            except TimeoutError:
                continue
            except OSError:
                return
            threading.Thread(target=self._lines, args=(peer.makefile("rb"),), daemon=True).start()

    def _lines(self, f) -> None:
        with f:
            for line in f:
                self.spool.put(self.address, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))

    def _datagrams(self) -> None:
        while self.open:
            try:
                data = self.socket.recv(1 << 16)
            except TimeoutError:
                continue
            except OSError:
                return
            for line in data.removesuffix(b"\n").split(b"\n"):
                self.spool.put(self.address, line.removesuffix(b"\r").decode("utf-8", "replace"))

    def _pipe(self, path: str) -> None:
        with open(path, "rb") as f:
            self._lines(f)

    def close(self) -> None:
        self.open = False
        for t in self.threads[1:]:
            t.join(1)
        if self.socket:
            self.socket.close()
        self.spool.close()


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """filename, line and seq of what listeners have spooled, as a stream (or read it in a batch)."""
    return spool_columns(spark.readStream.option("lineSep", "\n").text(folder))


def spool_columns(raw: DataFrame) -> DataFrame:
    return raw.select(F.substring_index("value", "\t", 1).alias("filename"), F.expr("substr(value, instr(value, '\t') + 1)").alias("line"), F.monotonically_increasing_id().alias("seq"))
