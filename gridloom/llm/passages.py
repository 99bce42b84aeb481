"""Substring dedup: repeated passages by MinHash banding of paragraphs and of all overlapping word windows.

Words are blank-separated and compared lower-cased; a passage is ``MIN_WORDS`` words or more that another
document holds too. Two kinds of units are banded over their sets of 5-word shingles:

* paragraphs (lines of ``MIN_WORDS`` words or more): ``BANDS`` bands of ``ROWS`` values, so that at a Jaccard
  similarity of 0.8 over 99.6 % of pairs collide; candidates are the components of what collides, inside which
  every pair is verified by exact Jaccard similarity through an inverted index, and the classes are the
  components of verified links.
* every window of ``MIN_WORDS`` words, wherever it lies: one band of ``WINDOW_ROWS`` values, in which equal
  windows collide for certain. Neighbouring windows mostly have the same least shingles, so that a text has
  one row for each run of windows with the same band key and the same place of its least shingle. Windows of
  colliding runs are verified for equality (edit distance 0) of whole windows with the first run of their key,
  place by place; those that differ from it are compared among each other by their hashes. Equality is
  transitive, so a class of equal windows is a component by itself.

Overlapping windows of a document join to the passage's true first and last word. Of each class that more
than one document holds, the first occurrence (least doc_id, then place) stays.

Texts are parsed once for all keys; only those with candidates are read again. They are picked by a bitmap of
fixed size (4 MB, broadcast), which lets some others through and loses none: beyond some
10^8 such documents it spares little, and then whole texts are shuffled. Counting goes by minima and maxima
with map-side combine, and members meet their class in plain joins with a stored right side, which Spark can
split, so a passage that a third of the documents hold is no one task's work.

Defined cases: documents with a null id are left alone; null and empty texts hold no passage; rows of one id
are one document, their places counted in each row's own text; equal texts are repeats of the one of least
id; no rows give no rows; texts of any length are read whole, one at a time; other columns are kept as they
are, whatever their names. Ids must be integers (anything else is an error).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, block_pairs, components, cut, fields, give_back, map_arrow, near, runs

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, WINDOW_ROWS, SEED = 8, 3, 2, 42
MIN_WORDS = 50
#: Shingles of a window.
WIDTH = MIN_WORDS - SHINGLE + 1
BLOCK_ROWS = 2048
#: Shingles whose minima are taken at once.
STEP = 1 << 15

#: Words as bytes.split() finds them.
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]*")
BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
IN_WORD = np.ones(256, np.int8)
IN_WORD[list(b" \t\n\r\x0b\x0c")] = 0
#: Bytes hashed at once, powers kept at hand, bytes of texts parsed at once (or one text).
SLICE, TABLE, GROUP = 1 << 18, 1 << 19, 1 << 19
FACTOR = 0xD1342543DE82EF95
INVERSE = pow(FACTOR, -1, 1 << 64)
_rng = np.random.default_rng(SEED)
MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def permuted(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th permutation of 64-bit values."""
    x = x * MULTIPLIERS[k] + ADDENDS[k]
    return x ^ (x >> np.uint64(31))


def chained(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    keys = (keys ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each set."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= STEP):
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        cuts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for k in range(BANDS * ROWS):
            out[at:end, k] = np.minimum.reduceat(permuted(joined, k), cuts)
        at = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        keys = chained(keys, parts[:, :, r])
    return keys.view(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; those of common lengths are kept."""
    if n > TABLE:
        return _powers(base, n)
    if base not in _tables:
        _tables[base] = _powers(base, TABLE)
    return _tables[base][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the values times rising powers of FACTOR."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(FACTOR, len(values)), dtype=np.uint64, out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from every place on: a polynomial of the words' hashes, mixed."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = sums(hashes)
    return mixed((total[k:] - total[:-k]) * powers(INVERSE, n - k + 1))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = IN_WORD[np.frombuffer(raw, np.uint8)]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of bytes: a polynomial of its bytes, mixed with its length."""
    start, end = word_places(raw)
    total = sums(np.frombuffer(raw, np.uint8).astype(np.uint64))
    length = (end - start).astype(np.uint64)
    return mixed((total[end] - total[start]) * powers(INVERSE, len(raw) + 1)[start] + length * np.uint64(0xA0761D6478BD642F))


def slices(raw: bytes):
    """Pieces of about SLICE bytes that end at a blank, so that long texts need little memory."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            m = BLANK.search(raw, end)
            end = m.end() if m else len(raw)
        yield raw[at:end]
        at = end


def slide(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    step = 1
    while step * 2 <= n:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def slide_first(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every n values in a row and the first place of it."""
    at = np.arange(len(x))

    def both(x, at, step):
        less = x[step:] < x[:-step]
        return np.where(less, x[step:], x[:-step]), np.where(less, at[step:], at[:-step])

    step = 1
    while step * 2 <= n:
        x, at = both(x, at, step)
        step *= 2
    return both(x, at, n - step) if n > step else (x, at)


class Texts:
    """Some texts' words as hashes, all in a row, with their paragraphs and windows."""

    def __init__(self, texts: list[str]) -> None:
        parts = [t.encode("utf-8", "replace").lower() for t in texts]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        hashes, starts, breaks, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
        for raw in slices(b"\n".join(parts)):
            starts.append(word_places(raw)[0] + at)
            breaks.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + at)
            hashes.append(word_hashes(raw))
            at += len(raw)
        places = np.concatenate(starts)
        self.hashes = np.concatenate(hashes)
        #: the first word of each text, and the number of words
        self.first = np.searchsorted(places, begins)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.shingles = grams(self.hashes, SHINGLE)
        bounds = np.searchsorted(places, np.concatenate([[0], *breaks, [at]]))
        long = np.flatnonzero(np.diff(bounds) >= MIN_WORDS)
        #: first word and past last word of each paragraph
        self.lines = np.stack([bounds[long], bounds[long + 1]], 1).astype(np.int64)

    def paragraph(self, w0: int, w1: int) -> np.ndarray:
        """The paragraph's shingles."""
        return self.shingles[w0 : w1 - SHINGLE + 1]

    def line_hash(self, w0: int, w1: int) -> int:
        h = xxhash.xxh64_intdigest(self.hashes[w0:w1].tobytes(), SEED)
        return h - (1 << 64) if h >> 63 else h

    def window_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows: band key, first window, number of windows, place of the least shingle."""
        n = len(self.hashes) - MIN_WORDS + 1
        whole = np.flatnonzero(self.owner[: max(n, 0)] == self.owner[MIN_WORDS - 1 :])  # windows within one text
        if not len(whole):
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        low, at = slide_first(permuted(self.shingles, 0), WIDTH)
        keys = chained(np.zeros(len(low), np.uint64), low)
        for k in range(1, WINDOW_ROWS):
            keys = chained(keys, slide(permuted(self.shingles, k), WIDTH))
        keys, at = keys[whole], at[whole]
        new = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], new]))
        return keys[first], whole[first], np.diff(np.append(first, len(keys))), at[first]


PARSED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("keys", "h", "bands")),
        *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("at", "w0", "w1")),
    ]
)
LEAD, MANY = 1, 2
#: A run of windows (payload: their hashes) or, where ``comp`` is not null, a paragraph (payload: its shingles).
PAYLOADS = fields("key long, doc_id long, at int, place int, flags int, comp long, payload longs")


def _texts(batch: pa.RecordBatch):
    return zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())


def _groups(batch: pa.RecordBatch):
    """Slices of a batch of about GROUP bytes of text, with their texts."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + GROUP, "right")))
        part = batch.slice(at, end - at)
        yield part, part.column("text").to_pylist()
        at = end


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of lists: the values cut at ``ends``, which begin with 0."""
    flat = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


def _parse_group(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    t = Texts(texts)
    keys, first, _, _ = t.window_runs()
    lines = t.lines
    sets = [t.paragraph(a, b) for a, b in lines.tolist()]
    whole = np.array([t.line_hash(a, b) for a, b in lines.tolist()], np.int64)
    bands = band_keys(signatures(sets)).ravel() if sets else np.zeros(0, np.int64)
    texts_of = np.arange(len(texts) + 1)
    run_text, line_text = t.owner[first], t.owner[lines[:, 0]]
    runs_end, lines_end = np.searchsorted(run_text, texts_of), np.searchsorted(line_text, texts_of)
    long, short = pa.int64(), pa.int32()
    cols = [
        batch.column("doc_id"), _lists(keys, runs_end, long), _lists(whole, lines_end, long), _lists(bands, lines_end * BANDS, long),
        _lists(first - t.first[run_text], runs_end, short), *(_lists(lines[:, k] - t.first[line_text], lines_end, short) for k in (0, 1)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=PARSED.names)


def _parse(batches):
    """Per text: keys and first windows of its runs; hashes, bounds and bands of its paragraphs."""
    for batch in batches:
        for part, texts in _groups(batch):
            yield _parse_group(part, texts)
    give_back()


def _members(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The rows that the members of lists belong to, and the members."""
    column = column.fill_null([])
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten()


def _payload_group(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    t = Texts(texts)
    keys, first, n, place = t.window_runs()
    windows = grams(t.hashes, MIN_WORDS).view(np.int64)
    docs = batch.column("doc_id").to_numpy()
    of, codes = _members(batch.column("runs"))
    codes = codes.to_numpy()
    at = codes >> 2
    absolute = t.first[of] + at
    slot = np.minimum(np.searchsorted(first, absolute), max(len(first) - 1, 0))
    # rows of one id are one document: a mark may belong to another text of it
    good = np.flatnonzero((first[slot] == absolute) & (t.owner[np.minimum(absolute, len(t.owner) - 1)] == of)) if len(first) and len(codes) else np.zeros(0, np.int64)
    slot = slot[good]
    payloads = [windows[w : w + k] for w, k in zip(first[slot].tolist(), n[slot].tolist())]
    rows = [keys.view(np.int64)[slot], docs[of[good]], at[good], place[slot] - first[slot], codes[good] & 3, np.zeros(len(good), np.int64)]
    # paragraphs
    lines, sets = dict(t.lines.tolist()), []
    of, asked = _members(batch.column("sets"))
    for o, m in zip(of.tolist(), asked.to_pylist()):
        w = int(t.first[o]) + m["at"]
        if w in lines and t.owner[w] == o and t.line_hash(w, lines[w]) == m["h"]:
            sets.append((m["h"], docs[o], m["at"], lines[w] - w, LEAD, m["comp"]))
            payloads.append(np.unique(t.paragraph(w, lines[w])).view(np.int64))
    more = np.array(sets, np.int64).reshape(-1, 6).T
    cols = [np.concatenate([a, b]) for a, b in zip(rows, more)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    arrays = [pa.array(c.astype(np.int64), pa.int64()).cast(k) for c, k in zip(cols, kinds)]
    arrays[5] = pa.array(cols[5].astype(np.int64), pa.int64(), mask=np.arange(len(cols[5])) < len(good))
    ends = np.cumsum([0, *(len(p) for p in payloads)])
    payload = _lists(np.concatenate([np.zeros(0, np.int64), *payloads]), ends, pa.int64())
    return pa.RecordBatch.from_arrays([*arrays, payload], names=PAYLOADS.names)


def _payload_rows(batches):
    """Hashes of the windows of marked runs (``runs``: 4 x place + flags) and shingles of marked paragraphs (``sets``: h, at, comp)."""
    for batch in batches:
        for part, texts in _groups(batch):
            yield _payload_group(part, texts)
    give_back()


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less most of those whose id is not among ``ids``."""
    return near(docs, ids).where("near").drop("near")


LINKS = fields("u long, v long")


def similar(sets: list[np.ndarray], left: list[int]):
    """Pairs (i, j) of sets with Jaccard similarity of SIMILARITY or more, by an inverted index."""
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    posting = member[order]
    first = np.searchsorted(codes[order], np.arange(len(values) + 1))
    own = np.split(codes, np.cumsum(sizes)[:-1])
    for i in left:
        both = np.bincount(np.concatenate([posting[first[c] : first[c + 1]] for c in own[i]]), minlength=len(sets))
        hit = np.flatnonzero(both >= SIMILARITY * (sizes[i] + sizes - both) - 1e-9)
        for j in hit[hit != i].tolist():
            yield i, j


def _verify(batches):
    for rows in runs(batches, ("comp", "p", "q")):
        if rows.num_rows < 2:
            continue
        h, blk = rows["h"].to_pylist(), rows["blk"].to_pylist()
        flat, cuts = rows["shingles"].combine_chunks(), rows["shingles"].combine_chunks().offsets.to_numpy()
        sets = np.split(flat.values.to_numpy()[cuts[0] : cuts[-1]], cuts[1:-1] - cuts[0])
        p = rows["p"][0].as_py()
        forest = Forest()
        for i, j in similar(sets, [i for i, b in enumerate(blk) if b == p]):
            forest.join(h[i], h[j])
        u, v = zip(*links) if (links := forest.links()) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=LINKS.names)


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """Per key that more than one document holds, the first occurrence (doc_id, at) as ``first``."""
    found = rows.groupBy(key).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # stored, so that Spark can split joins with it where one key is very common
    return cut(found.where("first.doc_id < last").drop("last"))


def _is_first():
    return (F.col("doc_id") == F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))


#: A unit found: words from ``at`` to ``stop``, or the windows at ``at`` + each bit of ``mask``.
UNITS = ("doc_id", "kept", "at", "stop", "mask", "cls", "first_doc")


def occurrences(docs: DataFrame) -> DataFrame:
    """Every repeated unit: doc_id, kept, at, stop, mask, cls, first_doc (see ``UNITS``)."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError(f"doc_id must be of an integer type, not {docs.schema['doc_id'].dataType.simpleString()}")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parsed = cut(texts.mapInArrow(_parse, PARSED))

    # windows: runs whose key more than one text has
    run = parsed.select("doc_id", F.explode(F.arrays_zip("keys", "at")).alias("r")).select("doc_id", F.col("r.keys").alias("key"), F.col("r.at").alias("at"))
    common = parsed.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    held = cut(run.join(cut(common), "key"))
    held = held.join(_first_of(held, "key"), "key")
    code = F.col("at").cast("long") * 4 + F.when(_is_first(), LEAD).otherwise(0) + F.when(F.col("n") > 2, MANY).otherwise(0)
    runs_of = held.groupBy("doc_id").agg(F.collect_list(code).alias("runs"))

    # paragraphs: components of what collides in a band
    lines = parsed.select("doc_id", F.posexplode(F.arrays_zip("h", "w0", "w1")).alias("k", "p"), "bands")
    lines = lines.select("doc_id", F.col("p.h").alias("h"), F.col("p.w0").alias("at"), F.col("p.w1").alias("stop"), F.slice("bands", F.col("k") * BANDS + 1, BANDS).alias("bands"))
    banded = lines.select("h", F.explode("bands").alias("key"))
    common = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = cut(banded.join(cut(common), "key").distinct())
    lead = met.groupBy("key").agg(F.min("h").alias("lead"), F.max("h").alias("other")).where("lead < other").drop("other")
    near = met.join(cut(lead), "key").where("h <> lead").select(F.col("h").alias("u"), F.col("lead").alias("v")).distinct()
    cand = components(near)
    cand = cut(cand.union(cand.select("component", "component").distinct()).toDF("h", "comp"))
    # one holder of each candidate sends its shingles
    holder = lines.select("h", "doc_id", "at").join(cand, "h").groupBy("h", "comp").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    sets_of = holder.groupBy("first.doc_id").agg(F.collect_list(F.struct("h", "first.at", "comp")).alias("sets"))

    marks = cut(runs_of.join(sets_of, "doc_id", "full_outer"))
    found = cut(only(texts, marks).join(marks, "doc_id").mapInArrow(_payload_rows, PAYLOADS))

    return _near_lines(lines, found).unionByName(_equal_windows(found))


def _near_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    sets = found.where("comp is not null").select("comp", F.col("key").alias("h"), F.col("payload").alias("shingles"))
    laid = block_pairs(sets, ["comp"], "h", BLOCK_ROWS)
    order = ["comp", "p", "q"]
    links = laid.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verify, LINKS)
    classes = components(links).withColumnRenamed("node", "h")
    units = lines.drop("bands").join(classes, "h", "left").withColumn("cls", F.coalesce("component", "h")).drop("component", "h")
    return units.join(_first_of(units, "cls"), "cls").select(
        "doc_id", _is_first().alias("kept"), "at", "stop", F.lit(0).cast("long").alias("mask"), "cls", F.col("first.doc_id").alias("first_doc")
    )


def _bits(places):
    """A mask with the bit of each place."""
    one = F.lit(1).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", one, i)))


def _moved(mask, by):
    """A mask with its bits ``by`` places up, or down where that is negative."""
    up = F.call_function("shiftleft", mask, by.cast("int"))
    return F.when(by >= 0, up).otherwise(F.call_function("shiftright", mask, (-by).cast("int")))


def _equal_windows(found: DataFrame) -> DataFrame:
    lead = F.col("flags").bitwiseAND(LEAD) > 0
    rows = found.where("comp is null").drop("comp")
    first = rows.where(lead).select("key", F.struct("doc_id", "at").alias("first"), F.col("place").alias("first_place"), F.col("payload").alias("model"))
    both = rows.where(~lead).join(first, "key")
    # window i of a run lies as its model's window i + by, seen from the least shingle
    by = F.col("first_place") - F.col("place")
    each = F.sequence(F.lit(0), F.size("payload") - 1)
    same = F.filter(each, lambda i: F.coalesce(F.get("payload", i) == F.get("model", i + by), F.lit(False)))
    both = both.withColumn("same", same)
    left = (F.col("flags").bitwiseAND(MANY) > 0) & (F.size("same") < F.size("payload"))
    both = both.select("doc_id", "at", "key", "first", _bits(F.col("same")).alias("mask"), by.alias("by"), F.when(left, F.col("payload")).alias("payload"))
    both = cut(both.where("mask <> 0 or payload is not null"))
    met = both.where("mask <> 0").drop("payload")
    unit = lambda kept, mask, first: [kept.alias("kept"), "at", F.lit(None).cast("int").alias("stop"), mask.alias("mask"), F.col("key").alias("cls"), first.alias("first_doc")]
    others = met.where("doc_id <> first.doc_id")
    members = others.select("doc_id", *unit(F.lit(False), F.col("mask"), F.col("first.doc_id")))
    models = others.groupBy("key", "first").agg(F.bit_or(_moved(F.col("mask"), F.col("by"))).alias("mask"))
    # again in the first document: what others hold too
    again = met.where("doc_id = first.doc_id").join(models.select("key", F.col("mask").alias("held")), "key")
    again = again.withColumn("mask", F.col("mask").bitwiseAND(_moved(F.col("held"), -F.col("by"))))
    again = again.where("mask <> 0").select("doc_id", *unit(F.lit(False), F.col("mask"), F.col("first.doc_id")))
    models = models.select("first.*", "key", "mask").select("doc_id", *unit(F.lit(True), F.col("mask"), F.col("doc_id")))
    # windows unlike their model's, among each other
    rest = both.where("payload is not null").select("doc_id", "at", "mask", F.posexplode("payload").alias("i", "key"))
    rest = rest.where(_moved(F.col("mask"), -F.col("i")).bitwiseAND(F.lit(1)) == 0).select("doc_id", (F.col("at") + F.col("i")).alias("at"), "key")
    common = rest.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    rest = cut(rest.join(cut(common), "key"))
    other = rest.join(_first_of(rest, "key"), "key").select("doc_id", *unit(_is_first(), F.lit(1).cast("long"), F.col("first.doc_id")))
    return members.unionByName(again).unionByName(models).unionByName(other)


SPANS = fields("doc_id long, kept boolean, w0 int, w1 int, cls long, first_doc long")


def _merge_rows(batches):
    out, size = [], 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=SPANS.names)
    for unit in runs(batches, ("doc_id", "kept")):
        at, mask, cls, first = (unit[c].to_numpy() for c in ("at", "mask", "cls", "first_doc"))
        stop = unit["stop"].fill_null(0).to_numpy()
        bits = np.unpackbits(mask.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        line = np.flatnonzero(stop)
        of = np.concatenate([row, line])
        w0 = np.concatenate([at[row] + bit, at[line]]).astype(np.int32)
        w1 = np.concatenate([at[row] + bit + MIN_WORDS, stop[line]]).astype(np.int32)
        order = np.argsort(w0, kind="stable")
        of, w0, w1 = of[order], w0[order], w1[order]
        cuts = np.flatnonzero(np.concatenate([[True], w0[1:] > np.maximum.accumulate(w1)[:-1]]))
        doc, kept = (np.full(len(cuts), unit[c][0].as_py()) for c in ("doc_id", "kept"))
        out.append((doc, kept, w0[cuts], np.maximum.reduceat(w1, cuts), np.minimum.reduceat(cls[of], cuts), np.minimum.reduceat(first[of], cuts)))
        size += len(cuts)
        if size >= BLOCK_ROWS:
            yield done()
            out, size = [], 0
    if out:
        yield done()


def spans(units: DataFrame) -> DataFrame:
    """Touching units of a document joined, by kept or not: doc_id and ``spans`` in word places."""
    # a document's places are bounded by its length
    order = ["doc_id", "kept"]
    merged = units.select(*UNITS).repartition("doc_id").sortWithinPartitions(*order).mapInArrow(_merge_rows, SPANS)
    return merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("w0", "w1", "kept", "cls", "first_doc"))).alias("spans"))


ROWS_OUT = fields("doc_id long, start long, stop long, n_words long, class_id long, first_doc_id long, kept boolean")


def _place_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for (doc, text), found in zip(_texts(batch), batch.column("spans").to_pylist()):
        words = [m.span() for m in WORD.finditer(text)]
        # rows of one id are one document: a place may lie beyond a shorter text
        rows += [
            (doc, words[s["w0"]][0], words[s["w1"] - 1][1], s["w1"] - s["w0"], s["cls"], s["first_doc"], s["kept"])
            for s in found if s["w1"] <= len(words)
        ]
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.bool_())], names=ROWS_OUT.names)


def repeated(docs: DataFrame) -> DataFrame:
    """One row per repeated passage: doc_id, start, stop, n_words, class_id, first_doc_id, kept.

    ``start`` and ``stop`` count code points. Where a passage joins units of several classes, the least stands.
    """
    found = cut(spans(occurrences(docs)))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(only(texts, found).join(found, "doc_id"), _place_rows, ROWS_OUT)


def without(text: str, found: list[tuple[int, int]]) -> str:
    """``text`` less the words of each (first, past last); the blanks after a passage go with it."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for w0, w1 in found:
        if w1 <= len(words):
            out.append(text[at : words[w0][0]])
            at = BLANKS.match(text, words[w1 - 1][1]).end()
    return "".join(out) + text[at:]


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the first occurrence of each repeated passage; all rows and columns kept.

    Only the passages and the blanks after them go; ``n_chars``, where there is one, follows the text.
    """
    found = cut(spans(occurrences(docs).where("not kept")))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    # texts without a passage are not shuffled
    rows = near(rows, found)
    cuts = found.select("doc_id", F.transform("spans", lambda s: F.struct(s["w0"].alias("w0"), s["w1"].alias("w1"))).alias("spans"))
    joined = rows.where("near").join(cuts, "doc_id", "left").select("text", "row", "spans")
    schema = joined.select("text", "row").schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, marks = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        done = [t if m is None or t is None else without(t, [(s["w0"], s["w1"]) for s in m]) for t, m in zip(texts, marks)]
        return pa.RecordBatch.from_arrays([pa.array(done, pa.string()), batch.column("row")], names=schema.names)

    out = map_arrow(joined, run, schema).unionByName(rows.where("not near").select("text", "row"))
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns))
