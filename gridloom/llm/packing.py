"""Packing of tokenised documents into sequences by first-fit decreasing in randomised groups.

Documents are dealt to groups by a hash, so groups are alike whatever ids or sources are frequent; a
group is packed by itself in one task of bounded size. A document is cut into full sequences and a
remainder. Remainders go, by falling length, to the first bin with room, found by walking down a
tournament tree of the bins' free room. Then bins are topped up: the emptiest are taken apart and their
pieces, cut where needed, fill the gaps of the fullest. What is left of a group, less than one
sequence, is cut into sequences whose lengths are powers of two, which need no padding.

A null text is empty: its document is the end id alone. Repeated ids are packed once for each row.
No rows: no sequences.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fields, give_back

LENGTH, END = 2048, 1
#: Bytes of text (and 256 for each row) that a group holds on average.
GROUP_BYTES = 8 << 20
#: Words whose ids one Python worker keeps at hand.
CACHE = 400_000


class Encoder:
    """Ids of whole texts; words are looked up, as this tokenizer's pieces never reach over white space.

    A word of plain letters and trailing marks is the letters' ids, whatever their case, and the marks';
    other words go through the whole tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:|]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        latin = [chr(c) for c in range(0xC0, 0x100)]
        self.bytewise = {ord(c): self._units(c) for c in latin}

    def _units(self, c: str) -> str:
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))

    def _full(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            base, marks = word.lower(), ""
        elif m := self.PLAIN.fullmatch(word):
            base, marks = m[1].lower(), m[2]
        else:
            return self._full(word)
        got = self.letters.get(base)
        if got is None:
            if len(self.letters) > CACHE:
                self.letters.clear()
            parts = self.model.tokenize(base if base.isascii() else base.translate(self.bytewise))
            got = self.letters[base] = struct.pack(f"<{len(parts)}I", *[t.id for t in parts])
        if marks:
            end = self.marks.get(marks)
            if end is None:
                end = self._full(marks)
                if len(self.marks) < CACHE:
                    self.marks[marks] = end
            got += end
        return got

    def encode(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            known[w] = self._ids(w)
        return np.frombuffer(b"".join([known[w] for w in words]), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Rooms:
    """Tournament tree over bins: each inner node knows the most room below it."""

    def __init__(self, bins: int) -> None:
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.most = [LENGTH] * (2 * self.width)

    def first(self, need: int) -> int:
        """The first bin with room for ``need``."""
        at, most = 1, self.most
        while at < self.width:
            at *= 2
            if most[at] < need:
                at += 1
        return at - self.width

    def take(self, bin_: int, used: int) -> None:
        at, most = bin_ + self.width, self.most
        most[at] -= used
        while at > 1:
            at //= 2
            now = max(most[2 * at], most[2 * at + 1])
            if most[at] == now:
                break
            most[at] = now


Piece = tuple[int, int, int]  # document, start, length


def pack(lengths: list[int]) -> list[list[Piece]]:
    """Sequences of pieces that hold every id of documents of these lengths once."""
    whole: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        full = n // LENGTH * LENGTH
        whole += [[(doc, at, LENGTH)] for at in range(0, full, LENGTH)]
        if n > full:
            rest.append((doc, full, n - full))
    rest.sort(key=lambda p: (-p[2], p[0]))
    rooms = Rooms(max(1, len(rest)))
    bins: list[list[Piece]] = []
    for piece in rest:
        b = rooms.first(piece[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(piece)
        rooms.take(b, piece[2])
    room = lambda b: LENGTH - sum(p[2] for p in b)
    bins.sort(key=room)
    # fullest first; pieces of the last bins fill the gaps
    a, z = 0, len(bins) - 1
    loose: list[Piece] = []
    while a < z or (a == z and loose):
        gap = room(bins[a])
        while gap and (loose or a < z):
            if not loose:
                loose = sorted(bins[z], key=lambda p: p[2])
                z -= 1
            doc, start, n = loose.pop()
            used = min(n, gap)
            bins[a].append((doc, start, used))
            if n > used:
                loose.append((doc, start + used, n - used))
            gap -= used
        a += 1
    bins = bins[: z + 1]
    last = loose
    if bins and not loose and room(bins[-1]):
        last = bins.pop()
    out = whole + bins
    # the rest of the group in powers of two
    total, queue = sum(p[2] for p in last), last[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        line: list[Piece] = []
        while size:
            doc, start, n = queue.pop()
            used = min(n, size)
            line.append((doc, start, used))
            if n > used:
                queue.append((doc, start + used, n - used))
            size -= used
        out.append(line)
    return out


PACKED = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Rows alike are dealt by themselves from so many on; then they are a share of all rows, so there are few such kinds.
ALIKE, KINDS = 1000, 1000


def deal(rows: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` with a group ``grp`` each, and the number of groups.

    A row's group follows from its id and text, so that a task run again deals alike whatever order its rows come in. Rows
    of one id and text would meet in one group; kinds of rows that make up a thousandth of all are spread by their place.
    """
    kind = F.xxhash64("doc_id", "text")
    size, n = rows.agg(F.sum(F.octet_length("text") + 256), F.count(F.lit(1))).first()
    groups = max(1, math.ceil((size or 0) / group_bytes))
    often = rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(ALIKE, n // KINDS)).select("kind")
    # at most KINDS rows
    both = rows.withColumn("kind", kind).join(F.broadcast(often.withColumn("often", F.lit(True))), "kind", "left")
    place = F.when(F.col("often"), F.monotonically_increasing_id()).otherwise(0)
    return both.select("doc_id", "text", F.pmod(F.xxhash64("kind", place, F.lit(17)), F.lit(groups)).alias("grp")), groups


def pack_documents(docs: DataFrame, tokenizer_path: str, group_bytes: int = GROUP_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Ids may be null or of any type; other columns are not read. A text is encoded whole, one at a time. Remainders of one
    length are packed in the order in which their group holds them.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt, groups = deal(rows, group_bytes)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *fields(PACKED + (", ids ints" if with_ids else ""))])
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(t: pa.Table) -> pa.Table:
        enc = encoder(tokenizer_path)
        grp = t["grp"][0].as_py()
        names = t["doc_id"].to_pylist()
        ids = [np.append(enc.encode(x), np.uint32(END)).astype("<u4") for x in t["text"].to_pylist()]
        out: list[tuple] = []
        pieces = []
        for k, line in enumerate(pack([len(x) for x in ids])):
            offset = 0
            for doc, start, n in line:
                piece = ids[doc][start : start + n]
                out.append((names[doc], start, n, zlib.crc32(piece.tobytes()), len(ids[doc]), (grp << 32) + k, offset))
                pieces.append(piece)
                offset += n
        cols = [pa.array(c, id_type if i == 0 else pa.int64()) for i, c in enumerate(zip(*out))]
        if with_ids:
            cols.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
        del out, pieces, ids, names
        give_back()
        return pa.Table.from_arrays(cols, names=schema.names)

    shuffled = dealt.repartition(max(1, min(groups, 100_000)), "grp")
    return shuffled.groupBy("grp").applyInArrow(run, schema)
