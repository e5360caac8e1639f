"""Shared by the operators: tables, checkpoints in the folder that all executors share, words as Arrow arrays."""

from __future__ import annotations

import gc
import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local one only where none is set and the master is local, as in tests, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is needed: a folder that driver and executors share")
        folder = held or f"file://{tempfile.mkdtemp(prefix='trackweave-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_settled = itertools.count(1)


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder, so that it is neither computed again nor lost with an executor.

    What led to it isn't needed any more, but Spark deletes shuffle files only once the driver's JVM has collected the objects that stand for them, which a long chain of small steps
    doesn't make it do; so it is asked to after every third step.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    if next(_settled) % 3 == 0:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Bytes of a batch that is sent to a Python worker, on the way there and in it; Spark's own limit is eight times as much, or 10,000 rows of any length.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes from now on, unless the session has a lower limit, so that an executor's memory doesn't follow the rows' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Text that is held in work arrays at a time, in bytes; a longer single text is a piece of its own.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about PIECE_BYTES of text each, so that memory follows the longest text and not the number of rows in a batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in itertools.pairwise(cuts):
        yield batch.slice(a, b - a)


def flat_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of each text (null: none): row offsets, index of each word, distinct words."""
    texts = pc.take(pc.fill_null(texts.cast(pa.large_string()), ""), pa.array(np.arange(len(texts))))  # a fresh array: splitting a slice reads the wrong bytes
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = index != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    return offsets.astype(np.int64), index.astype(np.int64), words


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
