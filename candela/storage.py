"""Where jobs keep what several later jobs read, and how long."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from candela.functions.hashes import time_to_live


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    It is the one named in spark.checkpoint.dir; only where that is unset and
    driver and executors are one process (tests, a notebook) a temporary one is
    chosen.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="candela-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder until nothing refers to it (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the checkpoint folder, for what is large and read by columns; cleared() removes it."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder in whatever file system it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cleared(spark: SparkSession) -> int:
    """Deletes all stored tables, when no more DataFrame that reads them is needed; how many there were."""
    n = len(_stored)
    while _stored:
        removed(spark, _stored.pop())
    return n


@contextlib.contextmanager
def stored_within(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was stored inside, whose readers have written what they need; earlier tables stay."""
    before = len(_stored)
    try:
        yield
    finally:
        while len(_stored) > before:
            removed(spark, _stored.pop())


class FrameCache:
    """Persisted frames by key, on the driver: each lives as long as its time frame says, the least recently used go first.

    Frames are held by Spark's storage; this only decides which are
    unpersisted. An empty frame is kept too, for a shorter time.
    """

    def __init__(self, max_entries: int = 256, max_bytes: int = 50 << 20, clock: Callable[[], float] = time.monotonic):
        self.max_entries, self.max_bytes, self.clock = max_entries, max_bytes, clock
        self.frames: OrderedDict[tuple, tuple[float, float, int, DataFrame]] = OrderedDict()

    def get(self, key: tuple, tf: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The frame under this key if it is fresh, else what make() gives, persisted."""
        self.evict()
        if key in self.frames:
            self.frames.move_to_end(key)
            return self.frames[key][3]
        frame = make().persist()
        empty = frame.isEmpty()
        size = 64 if empty else int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        self.frames[key] = (self.clock(), time_to_live(tf, empty), size, frame)
        self.evict()
        return frame

    def evict(self) -> None:
        now = self.clock()
        for key in [k for k, (since, life, _, _) in self.frames.items() if now - since > life]:
            self._drop(key)
        while self.frames and (len(self.frames) > self.max_entries or self.size > self.max_bytes):
            self._drop(next(iter(self.frames)))

    def _drop(self, key: tuple) -> None:
        self.frames.pop(key)[3].unpersist()

    @property
    def size(self) -> int:
        return sum(f[2] for f in self.frames.values())

    def clear(self) -> int:
        n = len(self.frames)
        for key in list(self.frames):
            self._drop(key)
        return n
