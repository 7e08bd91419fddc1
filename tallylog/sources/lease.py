"""One writer per table at a time: a lease kept as numbered files in the shared folder."""

from __future__ import annotations

import threading
import time

from pyspark.sql import SparkSession

from tallylog.session import fresh_name, shared_folder

#: Seconds after which a lease that its writer no longer renews is over, and how long a writer waits for one.
HELD_SECONDS, WAIT_SECONDS = 120.0, 600.0


class TableBusy(RuntimeError):
    """Another writer holds the table, or has taken it over."""


class Lease:
    """The right to write to ``name``; a context manager.

    The file with the highest number is the lease. It names its writer and the time it ends;
    the writer renews it while it works and ends it when done. Whoever finds it ended creates the file
    with the next number, which only one can do. A writer that stalled for longer than its lease
    finds a higher number and fails instead of writing on. Clocks of the writers' machines
    must agree to well within ``held`` seconds.
    """

    def __init__(self, spark: SparkSession, name: str, held: float = HELD_SECONDS, wait: float = WAIT_SECONDS):
        self.name, self.held, self.wait = name, held, wait
        self._jvm = spark._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/leases/{name}")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._owner = fresh_name("writer")
        self._number: int | None = None
        self._lost = False
        self._done = threading.Event()

    def _path(self, number: int):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, str(number))

    def _numbers(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(self._folder) if s.getPath().getName().isdigit())

    def _read(self, number: int) -> tuple[str, float]:
        """Writer and end of a lease; one that is just being written has neither."""
        try:
            stream = self._files.open(self._path(number))
            try:
                owner, _, end = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").partition(" ")
            finally:
                stream.close()
            return owner, float(end)
        except Exception:
            return "", self._files.getFileStatus(self._path(number)).getModificationTime() / 1000 + self.held

    def _write(self, number: int, end: float, overwrite: bool) -> None:
        out = self._files.create(self._path(number), overwrite)
        try:
            out.write(bytearray(f"{self._owner} {end}".encode()))
        finally:
            out.close()

    def _try(self) -> bool:
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        try:
            if last and self._read(last)[1] > time.time():
                return False
            self._write(last + 1, time.time() + self.held, overwrite=False)
        except Exception:
            # Someone else created it, or has removed the one before.
            if self._numbers()[-1:] == numbers[-1:]:
                raise
            return False
        if self._numbers()[-1] != last + 1 or self._read(last + 1)[0] != self._owner:
            return False
        self._number = last + 1
        for old in numbers:
            self._files.delete(self._path(old), False)
        return True

    def check(self) -> None:
        """Raise if the table was taken over."""
        if self._lost or self._numbers()[-1:] != [self._number]:
            raise TableBusy(f"the lease on {self.name} ended while its writer was at work")

    def _renew(self) -> None:
        while not self._done.wait(self.held / 3):
            try:
                self.check()
                self._write(self._number, time.time() + self.held, overwrite=True)
            except TableBusy:
                self._lost = True
                return

    def __enter__(self) -> Lease:
        until = time.monotonic() + self.wait
        pause = 0.05
        while not self._try():
            if time.monotonic() >= until:
                raise TableBusy(f"another writer holds {self.name}")
            time.sleep(pause)
            pause = min(pause * 1.5, 2.0)
        self._done.clear()
        self._renewal = threading.Thread(target=self._renew, daemon=True)
        self._renewal.start()
        return self

    def __exit__(self, *_) -> None:
        self._done.set()
        self._renewal.join()
        if not self._lost and self._numbers()[-1:] == [self._number]:
            self._write(self._number, 0.0, overwrite=True)
