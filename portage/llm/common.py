"""What the operators of this subpackage share: reading, keys, staging, Arrow helpers, bitmaps and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import portage
from portage.session import drop_dir, new_work_dir, stage
from portage.sources.tables import parquet_table

NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet_table(spark, sf_dir, name)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared work folder and read back: later steps neither recompute it nor lose it."""
    return stage(df, new_work_dir(df.sparkSession, purpose))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, by way of the shared work folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(portage.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = f"{new_work_dir(spark, 'package')}/portage-package.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


#: What the modules of this process keep from one task to the next, and how it is let go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(name: str, let_go: Callable[[], None]) -> None:
    """Tell that a module keeps something in the workers. It lasts while tasks with that ``cache`` run."""
    _KEPT[name] = let_go


def _trim() -> None:
    """Give freed memory back: a worker lives on through many stages, and what it holds counts as its executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_tasks(df: DataFrame, function, schema, cache: str = "") -> DataFrame:
    """``df.mapInArrow``, with this package at hand in the workers. What other modules keep there is let go, but for ``cache``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, let_go in _KEPT.items():
            if name != cache:
                let_go()
        _trim()
        yield from function(batches)
        _trim()

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and the row's key; other columns of ``docs`` never reach an operator.

    The key is (``kid``, ``kh``): the id, null as the largest long so that null sorts last, and a hash of the text.
    Rows that agree in both are the same document to every operator here, and get the same result.
    """
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).withColumns({"kid": F.coalesce("doc_id", F.lit(NO_ID)), "kh": F.xxhash64(F.col("text"), F.length("text"))})


def signed(value: int) -> int:
    """The long with the bits of an unsigned 64-bit ``value``."""
    return value - (1 << 64) if value >> 63 else value


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def bit_of(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits in which the top bits of every hash in the only column are marked.

    At most ``2 ** (bits - 6)`` rows reach the driver, whatever the number of hashes: the size is fixed. It serves to
    drop rows that cannot join before they are shuffled. The more hashes, the fewer it drops, and results never
    depend on it: the exact join follows.
    """
    place = bit_of(F.col(hashes.columns[0]), bits)
    words = (
        hashes.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks")).toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("marks").to_numpy()
    return out.view(np.uint64)


def marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``hashes`` are marked in a bitmap."""
    place = hashes >> np.uint64(64 - (len(words).bit_length() - 1 + 6))
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def told_apart(rows: DataFrame, keys: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (``kid``, ``kh``) may be among ``keys``, and those whose key is not, by a bitmap of fixed size.

    Only the key's hash goes through Python. A join of the first with ``keys`` is all that is left to do, so the texts of the others never move.
    """
    ship(rows.sparkSession)
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64("kid", "kh").alias("h")), bits))

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        return pa.array(marked(wanted.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    there = held(F.xxhash64("kid", "kh"))
    return rows.where(there), rows.where(~there)


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key (``kid``, ``kh``) is not among ``keys``. Few of them are shuffled, however many keys there are."""
    asked, others = told_apart(rows, keys)
    return others.unionByName(asked.join(keys, ["kid", "kh"], "left_anti"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j : j + n]
    # The sum is linear in the words; the mixing makes its order random, so that minima fall evenly.
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive grams the place of the smallest, of equal ones the last.

    What is chosen depends on the window's content only, so equal windows in two texts choose the same gram. The
    places never decrease. Works through long texts in pieces.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    piece = 1 << 20
    for at in range(0, n, piece):
        m = min(piece, n - at)
        best = grams[at : at + m].copy()
        place = np.zeros(m, dtype=np.int64)
        for j in range(1, width):
            seen = grams[at + j : at + j + m]
            better = seen <= best
            np.copyto(best, seen, where=better)
            place[better] = j
        out[at : at + m] = place + np.arange(at, at + m)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (``a``, ``b``): one row (``node``, ``root``) per node.

    ``root`` is the smallest node of the component. Alternates the large-star and small-star steps, whose rounds grow
    with the logarithm of the component, until the edges are stars. No neighbourhood is gathered in one place: each
    step is an aggregation and a join. Every round is a table in the shared work folder; the one before is dropped.
    """
    spark = edges.sparkSession
    path = new_work_dir(spark, "components")
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path
    )
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(state) == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(state)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        renewed = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        renewed_path = new_work_dir(spark, "components")
        current = stage(renewed, renewed_path)
        drop_dir(spark, path)
        path = renewed_path


@contextlib.contextmanager
def no_cycle_search():
    """Without Python's search for reference cycles, which would walk large caches again and again and find none."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()
