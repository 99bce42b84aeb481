"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Each of ``TABLES`` tables hashes a unit vector by ``CODES`` independent rotations: three rounds of
random signs and a fast Walsh-Hadamard transform, then the closest signed axis. The codes of a table
form its bucket. Multiprobe: a vector also visits the ``PROBES`` next most likely buckets, those whose
axes lose the least projection. Two vectors are candidates when one visits the other's own bucket in
some table; each candidate pair is verified by its cosine in double precision.

Buckets that nobody owns are dropped first. The others are laid out in units of bounded size (``block_pairs``) and
compared with matrix products; a unit emits link counts per vector and a star of links, never pairs. A pair is counted
in the first table where it collides, which both vectors' codes tell, so no pairs are shuffled to be made distinct.
Vectors travel as they came, with 32-bit hashes of their codes.

Recall: at a cosine of 0.95 and up to 128 components four tables find over 0.998 of pairs, as the tests measure; more
components take more tables (``tables_for``) for the same. ``n_links`` counts the links found.

Defined cases: vectors that are null, empty, zero or of null or non-finite components link with nothing, as do vectors
of different lengths; a cosine of exactly 0.95 links. Equal vectors are merged first, so n copies cost one row and each
gets n - 1 links. Rows with a null id count as links but name no component: its id is null where none of its rows has
one. Repeated ids give a row each and link like others. No rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, block_pairs, components, cut, fields, runs

COSINE, CODES, PROBES, SEED = 0.95, 3, 16, 20
BLOCK_ROWS = 2048
#: Rows hashed at once.
STEP = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow for large components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tables_for(dim: int) -> int:
    """Tables that vectors of ``dim`` components take: four up to 128, one more for each doubling."""
    return 4 + max(0, math.ceil(math.log2(dim / 128)))


def visits(x: np.ndarray, tables: int | None = None, codes: int = CODES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers, the vector's own bucket first; -1 where there are fewer buckets."""
    n, dim = x.shape
    tables = tables or tables_for(dim)
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.default_rng(SEED)
    near = min(2 * d, probes + 1)
    # combinations of axis ranks, by how little they can cost
    ranks = np.array(sorted(product(range(near), repeat=codes), key=sum))
    ranks = ranks[np.prod(ranks + 1, 1) <= probes + 1]
    out = np.full((n, tables, 1 + probes), -1, np.int64)
    for t in range(tables):
        axes, losses = [], []
        for _ in range(codes):
            y = x
            for signs in rng.choice([-1.0, 1.0], (3, d)):
                y = hadamard(y * signs)
            y = y / np.sqrt((y * y).sum(1, keepdims=True))
            both = np.concatenate([y, -y], 1)
            top = np.argpartition(-both, near - 1, 1)[:, :near]
            value = np.take_along_axis(both, top, 1)
            order = np.argsort(-value, 1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            axes.append(top)
            losses.append((value[:, :1] - value) ** 2)
        loss = sum(losses[c][:, ranks[:, c]] for c in range(codes))
        pick = np.argsort(loss, 1, kind="stable")[:, : 1 + probes]
        bucket = np.zeros((n, len(ranks)), np.int64)
        for c in range(codes):
            bucket = bucket * (2 * d) + axes[c][:, ranks[:, c]]
        out[:, t, : pick.shape[1]] = np.take_along_axis(bucket, pick, 1)
    return out


HASHED = fields("cls long, dim int, x binary, codes binary, spots longs")


def short(spots: np.ndarray) -> np.ndarray:
    """32-bit hashes of bucket numbers."""
    return ((spots.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _hash(kind: np.dtype):
    """Per class of equal vectors: its vector as it is, its buckets, table after table, and short codes of them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                vectors = [np.asarray(v, kind) for v in part.column("embedding").to_pylist()]
                ids = part.column("cls").to_numpy()
                for dim in sorted({len(v) for v in vectors}):
                    mine = [i for i, v in enumerate(vectors) if len(v) == dim]
                    x = np.stack([vectors[i] for i in mine])
                    codes = visits(unit_vectors(x.astype(np.float64)))
                    tables = codes.shape[1]
                    spots = np.where(codes < 0, -1, codes * tables + np.arange(tables)[:, None]).reshape(len(mine), -1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[mine]),
                            pa.array(np.full(len(mine), dim, np.int32)),
                            pa.array([r.tobytes() for r in x], pa.binary()),
                            pa.array([r.tobytes() for r in short(spots)], pa.binary()),
                            pa.ListArray.from_arrays(np.arange(len(mine) + 1, dtype=np.int32) * spots.shape[1], spots.ravel()),
                        ],
                        names=HASHED.names,
                    )

    return run


FOUND = fields("u long, v long, n long")


def _compare(rows: pa.Table, kind: np.dtype):
    """Yields positions (i, j) of the pairs that link and have not met in an earlier table."""
    p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
    spot, dim = rows["spot"][0].as_py(), rows["dim"][0].as_py()
    tables = tables_for(dim)
    t, bucket = spot % tables, short(np.array([spot], np.int64))[0]
    cls, home, blk = rows["cls"].to_numpy(), rows["home"].to_numpy(), rows["blk"].to_numpy()
    x = unit_vectors(np.frombuffer(b"".join(rows["x"].to_pylist()), kind).reshape(len(cls), dim).astype(np.float64))
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint32).reshape(len(cls), tables, 1 + PROBES)
    at = np.arange(len(cls))
    left, right = (at, at) if p == q else (at[blk == p], at[blk == q])
    for a0 in range(0, len(left), 1024):
        for b0 in range(0, len(right), 1024):
            a, b = left[a0 : a0 + 1024], right[b0 : b0 + 1024]
            if not home[a].any() and not home[b].any():
                continue
            i, j = np.nonzero((x[a] @ x[b].T >= COSINE) & (home[a][:, None] | home[b][None, :]))
            i, j = a[i], b[j]
            if p == q:
                i, j = i[i < j], j[i < j]
            # each pair once: not where an earlier table has it too
            for s in range(0, len(i), 65536):
                ii, jj = i[s : s + 65536], j[s : s + 65536]
                seen = np.zeros(len(ii), bool)
                for e in range(t):
                    ci, cj = codes[ii, e], codes[jj, e]
                    seen |= (ci == cj[:, :1]).any(1) | (cj == ci[:, :1]).any(1)
                # a pair may meet in both its own buckets of a table; the lesser one counts
                hi, hj = codes[ii, t, 0], codes[jj, t, 0]
                other = np.where(hi == bucket, hj, hi)
                both = (codes[jj, t] == hi[:, None]).any(1) & (codes[ii, t] == hj[:, None]).any(1)
                seen |= both & (other < bucket)
                ii, jj = ii[~seen], jj[~seen]
                yield ii, jj


def _verify(kind: np.dtype):
    """(u, v, n): vector u has n links first seen in this unit, v being the least of its star."""

    def run(batches):
        for rows in runs(batches, ("dim", "spot", "p", "q")):
            if rows.num_rows < 2:
                continue
            cls, size = rows["cls"].to_numpy(), rows["size"].to_numpy()
            n = np.zeros(len(cls), np.int64)
            forest = Forest()
            for i, j in _compare(rows, kind):
                np.add.at(n, i, size[j])
                np.add.at(n, j, size[i])
                edges = np.unique(np.stack([np.maximum(cls[i], cls[j]), np.minimum(cls[i], cls[j])]), axis=1)
                for a, b in edges.T.tolist():
                    forest.join(a, b)
            on = np.flatnonzero(n)
            roots = [forest.find(c) for c in cls[on].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(cls[on]), pa.array(roots, pa.int64()), pa.array(n[on])], names=FOUND.names)

    return run


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    good = (
        e.isNotNull()
        & (F.size(e) > 0)
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(e, lambda v: v != 0)
    )
    rows = vectors.select("vec_id", F.when(F.coalesce(good, F.lit(False)), e).alias("embedding"))
    # of two hashes; the least id of equal vectors names their class, a negative hash where all their ids are null
    key = [F.xxhash64("embedding").alias("k1"), F.hash("embedding").alias("k2")]
    valid = rows.where("embedding is not null").select("vec_id", "embedding", *key)
    classes = valid.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("size"), F.any_value("embedding").alias("embedding")
    )
    classes = classes.withColumn("cls", F.coalesce("name", F.col("k1").bitwiseOR(F.lit(-(1 << 63)))))
    kind = np.dtype(np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64)
    payload = cut(classes.select("cls", "embedding").mapInArrow(_hash(kind), HASHED))
    hashed = payload.select("cls", "dim", F.posexplode("spots").alias("at", "spot")).where("spot >= 0")
    hashed = hashed.select("dim", "spot", "cls", (F.col("at") % (1 + PROBES) == 0).alias("home"))
    unit = ["dim", "spot"]
    # a bucket links something only if it is some vector's own and holds two rows
    owned = hashed.where("home").select(*unit).distinct()
    held = cut(hashed.join(owned, unit, "left_semi"))
    busy = held.groupBy(*unit).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    busy_rows = (
        held.join(busy, unit, "left_semi")
        .join(payload.select("cls", "x", "codes"), "cls")
        .join(classes.select("cls", "size"), "cls")
    )
    laid = block_pairs(busy_rows, unit, "cls", BLOCK_ROWS)
    order = [*unit, "p", "q"]
    found = cut(laid.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verify(kind), FOUND))
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    linked = components(found.select("u", "v").where("u <> v"))
    per_class = (
        classes.select("k1", "k2", "cls", "name", "size")
        .join(counts.withColumnRenamed("u", "cls"), "cls", "left")
        .join(linked.withColumnRenamed("node", "cls"), "cls", "left")
        .select("k1", "k2", "name", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    )
    names = per_class.groupBy("component").agg(F.min("name").alias("component_id"))
    per_class = per_class.join(names, "component").select("k1", "k2", "n_links", "component_id")
    done = valid.select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
