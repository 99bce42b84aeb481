"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: words are runs of non-blank ASCII-wise characters of the text with A-Z lower-cased;
each 3-word shingle (all occurrences) votes with its XXH64 (seed 42) bits; a bit is set when over half
the votes have it. Fewer words than three: the whole sequence votes; none, or a null text: zero.

Index: every distinct fingerprint stands under one upper node for each choice of kept 16-bit quarters
(the node's masked pattern is what its members share). Two fingerprints that differ in at most
``MAX_BITS`` = 2 bits agree on at least two of four quarters, so they share a node; the nodes are the
unit of distribution. Within a node, members are sorted by Gray rank and cut into groups of ``FAN``;
each group keeps the mask of bits on which all of it agrees, and its ancestors hold those that agree
over larger groups. A search walks down adding, per level, the differences on newly fixed bits and
leaves a whole group as soon as the sum exceeds the limit.

Equal fingerprints are merged beforehand (a minimum with map-side combine), so groups of copies cost
one row. Links are contracted to stars per node, then to components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, block_pairs, components, cut, fields, map_arrow, near, runs

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Children of an index node, and rows of an upper node that one unit of work indexes.
FAN, BLOCK_ROWS = 16, 4096
QUARTERS = [0xFFFF << (16 * i) for i in range(4)]
UPPER = [a | b for a, b in combinations(QUARTERS, 2)]
#: Votes are counted in pieces of so many shingles, which bounds memory for very long texts.
PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return h(b" ".join(words), SEED)
    total = len(words) - SHINGLE + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, total, PIECE):
        part = words[at : at + PIECE + SHINGLE - 1]
        hashes = np.fromiter((h(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:])), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's 64 bits as a long) per document."""
    ids = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(ids, run, T.StructType([ids.schema["doc_id"], T.StructField("fp", T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy over codes in Gray order: levels of (pattern, newly shared mask), leaves at the end."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        low = high = self.codes  # and/or over what stands below: bits equal in both are shared
        shared = [np.full(len(codes), ~np.uint64(0))]
        patterns = [self.codes]
        while len(low) > 1:
            cuts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            shared.append(~(low ^ high))
            patterns.append(low)
        self.patterns = patterns[::-1]
        shared = shared[::-1]
        #: bits that a node shares beyond what its parent does
        self.fresh = [shared[0]] + [s & ~np.repeat(up, FAN)[: len(s)] for up, s in zip(shared, shared[1:])]

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, code position) that differ in at most ``most`` bits."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        sums = np.zeros(len(queries), np.uint8)
        for level, (pattern, fresh) in enumerate(zip(self.patterns, self.fresh)):
            if level:
                q, sums = np.repeat(q, FAN), np.repeat(sums, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                keep = node < len(pattern)
                q, sums, node = q[keep], sums[keep], node[keep]
            sums = sums + np.bitwise_count((queries[q] ^ pattern[node]) & fresh[node])
            keep = sums <= most
            q, sums, node = q[keep], sums[keep], node[keep]
        return q, self.order[node]


def star_links(codes: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Stars (owner, least owner) of what the members ``left`` of a node link to in ``right``."""
    forest = Forest()
    index = GrayIndex(codes[right])
    for at in range(0, len(left), 1024):
        part = left[at : at + 1024]
        a, b = index.search(codes[part], MAX_BITS)
        a, b = owner[part[a]], owner[right[b]]
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
            forest.join(x, y)
    return forest.links()


LINKS = fields("u long, v long")


def _links_of_nodes(batches):
    for rows in runs(batches, ("mask", "part", "p", "q")):
        if rows.num_rows < 2:
            continue
        codes, owner, blk = rows["fp"].to_numpy().view(np.uint64), rows["owner"].to_numpy(), rows["blk"].to_numpy()
        p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
        at = np.arange(len(codes))
        left, right = (at, at) if p == q else (at[blk == p], at[blk == q])
        u, v = zip(*found) if (found := star_links(codes, owner, left, right)) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=LINKS.names)


def link(codes: DataFrame) -> DataFrame:
    """Components of distinct ``codes(fp)`` linked within MAX_BITS: (node, component), both fingerprints."""
    under = codes.select("fp", F.col("fp").alias("owner")).withColumn("mask", F.explode(F.array(*(F.lit(i) for i in range(len(UPPER))))))
    mask = F.element_at(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in UPPER)), F.col("mask") + 1)
    under = under.withColumn("part", F.col("fp").bitwiseAND(mask))
    # a node of one member links nothing
    busy = under.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    under = under.join(busy, ["mask", "part"], "left_semi")
    laid = block_pairs(under, ["mask", "part"], "fp", BLOCK_ROWS)
    units = laid.repartition("mask", "part", "p", "q").sortWithinPartitions("mask", "part", "p", "q")
    return components(units.mapInArrow(_links_of_nodes, LINKS))


def _components(fps: DataFrame) -> DataFrame:
    """(fp, owner, component, component_id) of stored ``fps(doc_id, fp)``: the least id of the fingerprint, the least
    fingerprint and the least id of all it reaches."""
    codes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("owner")))
    whole = codes.join(link(codes).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "owner", F.coalesce("component", "fp").alias("component"))
    # one row per component
    names = whole.groupBy("component").agg(F.min("owner").alias("component_id"))
    return whole.join(names, "component").select("fp", "owner", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, kept.

    Rows with a null id get a fingerprint and link like others, but name no component (null if it has no id).
    Repeated ids each give a row. No rows: no rows. Ids may be of any type with an order; other columns are not read.
    Very long texts are counted in pieces.
    """
    fps = cut(fingerprints(docs))
    return fps.join(_components(fps).select("fp", "component_id"), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: one of least id.

    Rows that share an id are told apart by their fingerprints, so that different texts under one id each stay unless
    something else stands for them: a component keeps, of its rows of least id, those of the least fingerprint, and of
    these the one whose text has the least hash. Documents without an id stay, as nothing names them.
    """
    fps = cut(fingerprints(docs.where("doc_id is not null")))
    found = _components(fps).where("owner = component_id").groupBy("component", "component_id").agg(F.min("fp").alias("fp"))
    # an id of several texts may stand for several components
    kept = found.groupBy(F.col("component_id").alias("doc_id")).agg(F.collect_set("fp").alias("fps"))
    ids = fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(kept, "doc_id", "left")
    # ids that stand for nothing, or for several rows; the rows of all others stay where they are
    odd = cut(ids.where("fps is null or n > 1"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in others)).alias("row"))
    looked = near(rows, odd)
    plain = looked.where("not near").drop("near").unionByName(looked.where("near").drop("near").join(odd, "doc_id", "left_anti"))
    several = odd.where("fps is not null")

    def with_fp(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows).view(np.int64)
        good = [f in some for f, some in zip(own.tolist(), batch.column("fps").to_pylist())]
        cols = [batch.column("doc_id"), pa.array(own), batch.column("h"), batch.column("text"), batch.column("row")]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "h", "text", "row"]).filter(pa.array(good, pa.bool_()))

    again = near(rows, several).where("near").join(several, "doc_id").select("doc_id", "text", "fps", F.xxhash64("text").alias("h"), "row")
    schema = again.select("doc_id", F.lit(0).cast("long").alias("fp"), "h", "text", "row").schema
    again = map_arrow(again, with_fp, schema).groupBy("doc_id", "fp").agg(F.min_by(F.struct("text", "row"), "h").alias("x"))
    done = plain.unionByName(again.select("doc_id", "x.text", "x.row"))
    return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in docs.columns))
