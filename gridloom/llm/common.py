"""Shared pieces of the training-data operators: Arrow mapping, held-out split, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut

__all__ = ["Forest", "block_pairs", "components", "cut", "fields", "give_back", "held_out", "map_arrow", "near", "runs", "small_batches", "table"]

#: Size of the bitmap of documents to be looked at again, 4 MB.
SKETCH_BITS = 1 << 25
#: Rows of text are handed to Python functions in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Rows in a batch at most; Spark's 10,000 would be some 50 MB of texts.
BATCH_ROWS = 1000


TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType()),
    "longs": T.ArrayType(T.LongType()), "doubles": T.ArrayType(T.DoubleType()),
}


def fields(text: str) -> T.StructType:
    """A schema from "name type, ..." without a running session."""
    return T.StructType([T.StructField(n, TYPES[k]) for n, k in (x.split() for x in text.split(","))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on after its task beside others and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python functions in batches of bounded size, of which JVM and worker hold some at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to slices of bounded size; each slice becomes one batch of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5 = 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _spread_min(pairs: DataFrame) -> DataFrame:
    """For each u the least of itself and its neighbours v, beside every (u, v)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no other edge's u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(u, v)``: one row (node, component) per linked node.

    ``component`` is the least node reachable. Alternates the large-star and small-star steps until the edges are
    stars, which takes about log(n) rounds, none where they come as stars; every round is checkpointed, so lost executors
    only repeat one round. All groupings are minima and sums with map-side combine; a hub's edges meet its least
    neighbour in a join.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _spread_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _spread_min(large)
        e = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``near``: false only for an id that is not among ``ids``, by a bitmap of fixed size."""
    bit = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(SKETCH_BITS)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(bit()).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit())).alias("bits"))
    at = F.bitmap_bit_position(bit())
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # at most SKETCH_BITS / 32768 rows of 4 KB
    both = docs.join(F.broadcast(maps), F.col("doc_id").isNotNull() & (F.bitmap_bucket_number(bit()) == F.col("bucket")), "left")
    return both.select(*docs.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("near"))


def block_pairs(rows: DataFrame, key: list[str], member: str, block_rows: int) -> DataFrame:
    """Lay rows of equal ``key`` out for comparison of all with all, in tasks of bounded size.

    Keys of up to ``block_rows`` rows stay whole. The rows of a larger key are dealt to blocks by the
    hash of ``member``, and each pair of blocks becomes a unit of its own, so that every two rows of a
    key meet in some unit while no unit holds over about two blocks. Adds ``p``, ``q`` (the unit's
    blocks) and ``blk`` (the row's block). Members should be distinct within a key.
    """
    heavy = (
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > block_rows)
        .select(*key, F.ceil(F.col("n_rows") / block_rows).cast("int").alias("n_blk"))
    )
    laid = rows.join(heavy, key, "left").withColumn("n_blk", F.coalesce("n_blk", F.lit(1)))
    laid = laid.withColumn("blk", F.pmod(F.xxhash64(member, F.lit(7)), F.col("n_blk")).cast("int"))
    laid = laid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)))
    return laid.select(
        *rows.columns, "blk", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q")
    )


def runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal integer ``key`` in sorted batches; a run may go over several batches."""
    rows, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in key])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            this = tuple(keys[:, a].tolist())
            if this != last:
                if rows:
                    yield pa.Table.from_batches(rows)
                rows, last = [], this
            rows.append(batch.slice(a, b - a))
    if rows:
        yield pa.Table.from_batches(rows)


class Forest:
    """Union-find over hashable nodes that keeps the least node as root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple]:
        """(node, root) of each node that is not its own root."""
        return [(x, self.find(x)) for x in list(self.up)]
