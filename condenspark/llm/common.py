"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Byte tables for the two normalisations used here. Bytes of 0x80 and above (all non-ASCII text) stay as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may lack it; it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def unused(df: DataFrame, name: str) -> str:
    """name, or if df has such a column, a longer one that it hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back, so a lost executor costs a re-read and not a re-run."""
    return Scratch(df.sparkSession).keep(df, label)


class Scratch:
    """Intermediate tables of one operator in the shared folder. What a later step no longer reads is dropped at once; what the
    operator's result still reads goes when the application ends."""

    _left: ClassVar[set[tuple[SparkSession, str]]] = set()

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(label, []).append(path)
        self._left.add((self.spark, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str, but: int = 0) -> None:
        """All tables kept under these labels; but: except the last few of each."""
        for label in labels:
            found = self.paths.get(label, [])
            for path in found[: len(found) - but]:
                _remove(self.spark, path)
                self._left.discard((self.spark, path))
            self.paths[label] = found[len(found) - but :]

    @classmethod
    def clear(cls) -> None:
        while cls._left:
            with contextlib.suppress(Exception):  # the session may have ended
                _remove(*cls._left.pop())


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


atexit.register(Scratch.clear)

#: Spark's setting for the size of an Arrow batch, and its default.
BATCH_BYTES, UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """From now on this session's Arrow batches end at ``most`` bytes, not only at a number of rows: JVM and Python hold a batch of texts
    several times over. A bound that the session has been given stays."""
    if spark.conf.get(BATCH_BYTES) == UNSET:
        spark.conf.set(BATCH_BYTES, str(most))


def give_back() -> None:
    """Python workers live on after their task; what a task no longer needs goes back to the system, for the next stage to use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
