"""Live tail: whenever logs change, everything is read and reported again.

The file stream source doesn't read files again that have grown, so a tick compares the files' sizes
and times, waits until they hold still, and then runs the batch report.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.base import Logs, Source

State = dict[str, tuple[int, int]]


def watch_roots(source: Source, roots: list[str] | None = None) -> list[str]:
    """The folders that hold the source's files, each once; an error if there are none."""
    found = {os.path.dirname(p) for p in state(source.roots() if roots is None else roots)}
    if not found:
        raise LookupError(f"no logs of {source.id!r} to watch")
    return sorted(found)


def _remote(root: str) -> State:
    """``state`` of a folder that only Spark's file systems reach."""
    sc = SparkSession.active().sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    out: State = {}
    if fs.exists(where):
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            if (path := f.getPath().toString()).endswith(".jsonl"):
                out[path] = (f.getLen(), f.getModificationTime() * 1_000_000)
    return out


def state(roots: list[str]) -> State:
    """Size and time of every log file; a root with a scheme (s3://...) is listed by Spark."""
    out: State = {}
    for root in roots:
        root = root.removeprefix("file://")
        if "://" in root:
            out |= _remote(root)
            continue
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".jsonl") and not os.path.islink(p := os.path.join(folder, n)):
                    try:
                        s = os.stat(p)
                    except OSError:
                        continue
                    out[p] = (s.st_size, s.st_mtime_ns)
    return out


def changes(roots: list[str], tick: float = 0.1, quiet: float = 0.4, sleep: Callable[[float], None] = time.sleep) -> Iterator[State]:
    """A state at first and after each change, once nothing has changed for ``quiet`` seconds."""
    last = state(roots)
    yield last
    while True:
        sleep(tick)
        now = state(roots)
        if now == last:
            continue
        while True:
            sleep(quiet)
            if (later := state(roots)) == now:
                break
            now = later
        last = now
        yield now


def watch(spark: SparkSession, source: Source, report: Callable[[Logs], None], roots: list[str] | None = None, times: int | None = None) -> None:
    """Report now and after each change; ``times`` ends it."""
    roots = source.roots() if roots is None else roots
    watch_roots(source, roots)
    for n, _ in enumerate(changes(roots), 1):
        logs = source.read(spark, roots)
        report(logs)
        logs.close()
        if times is not None and n >= times:
            return


def stream(spark: SparkSession, source: Source, report: Callable[[Logs], None], roots: list[str] | None = None, every: str = "1 second"):
    """The same as a streaming query: a tick that recomputes when files have changed."""
    roots = source.roots() if roots is None else roots
    seen: list[State] = []

    def tick(_: DataFrame, __: int) -> None:
        now = state(roots)
        if not seen or seen[-1] != now:
            seen[:] = [now]
            logs = source.read(spark, roots)
            report(logs)
            logs.close()

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick).trigger(processingTime=every).start()
