"""SentencePiece unigram encoding and decoding by Viterbi over a double-array trie.

The trie is built once from the pieces of a vocabulary file and their scores and is bounded by that
vocabulary, so it is broadcast. White space becomes the marker and one marker is put before the text.
As no piece has a marker after another character, the best path splits at every marker that follows a
character: each such word is solved once and looked up after that. Characters outside all pieces are
written as bytes (the byte pieces); their cost is the least score less ``UNKNOWN``.

Of paths of one score the one with the longest last piece stands, at every place that paths reach.

Decoding joins pieces, turns runs of byte pieces into text, turns markers into spaces and drops the
first space. Ids of control pieces have no text.

Defined cases: a null or empty text has no ids; very long texts and words are read whole, in time linear in their length;
repeated ids give a row each; no rows give no rows; ids may be of any type or null, other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, map_arrow

MARK, UNKNOWN = "▁", 10.0
#: Words whose ids one Python worker keeps at hand.
CACHE = 400_000
WORD = re.compile(f"{MARK}*[^{MARK}]*")


class DoubleArray:
    """A trie as two integer arrays: child = base[state] + code, valid where check[child] is the state."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        size = 1 << 12
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        free = 1
        stack = [(0, 0, len(order), 0)]  # state, first key, last key, depth
        while stack:
            state, a, b, depth = stack.pop()
            if a < b and len(keys[order[a]]) == depth:
                self.value[state] = values[order[a]]
                a += 1
            if a == b:
                continue
            codes, at = [], [a]
            for i in range(a, b):
                c = keys[order[i]][depth] + 1
                if not codes or codes[-1] != c:
                    if codes:
                        at.append(i)
                    codes.append(c)
            at.append(b)
            base, tried = max(0, free - codes[0]), 0
            while True:
                tried += 1
                if base + 257 >= len(self.check):
                    self.base = np.concatenate([self.base, np.zeros_like(self.base)])
                    self.check = np.concatenate([self.check, np.full_like(self.check, -1)])
                    self.value = np.concatenate([self.value, np.full_like(self.value, -1)])
                if all(self.check[base + c] < 0 for c in codes):
                    break
                base += 1
            self.base[state] = base
            for c in codes:
                self.check[base + c] = state
            if tried > 64:  # the cells before are nearly full; look no more there
                free = base + codes[0]
            for c, lo, hi in zip(codes, at, at[1:]):
                stack.append((base + c, lo, hi, depth + 1))


class Unigram:
    """Encoder and decoder over (piece, score, kind) rows; kinds: normal, control, unknown, byte, user."""

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        self.pieces = [p for p, *_ in pieces]
        self.kinds = [k for *_, k in pieces]
        self.scores = [float(s) for _, s, _ in pieces]
        plain = [i for i, k in enumerate(self.kinds) if k in ("normal", "user")]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a marker after another character")
        normal = [self.scores[i] for i in plain if self.kinds[i] == "normal"] or [0.0]
        self.worst, self.best = min(normal) - UNKNOWN, max(normal)
        trie = DoubleArray([self.pieces[i].encode() for i in plain], plain)
        # plain lists are quicker to index one by one
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == "unknown"), 0)
        self.weights = [self.weight(i) for i in range(len(pieces))]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == "byte" else " ⁇ ".encode() if k == "unknown" else b"" if k == "control" else p.encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self.known: dict[str, list[int]] = {}

    def weight(self, i: int) -> float:
        """A piece's score; a user-defined piece wins over what it is made of."""
        return len(self.pieces[i]) * self.best - 0.1 if self.kinds[i] == "user" else self.scores[i]

    def solve(self, word: str) -> list[int]:
        """Ids of the best path over one word."""
        raw = word.encode("utf-8", "replace")
        n = len(raw)
        base, check, value, weights = self.base, self.check, self.value, self.weights
        low = float("-inf")
        score, last, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        limit = len(check)
        at = 0
        while at < n:
            here = score[at]
            lead = raw[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single = False
            state, i = 0, at
            while i < n:
                child = base[state] + raw[i] + 1
                if child >= limit or check[child] != state:
                    break
                state = child
                i += 1
                v = value[state]
                if v >= 0:
                    s = here + weights[v]
                    if i == at + step:
                        single = True
                    if s > score[i]:
                        score[i], last[i], piece[i] = s, at, v
            if not single:
                s = here + self.worst
                if s > score[at + step]:
                    score[at + step], last[at + step], piece[at + step] = s, at, -2
            at += step
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte:
                out += [self.byte[b] for b in raw[last[at] : at][::-1]]
            else:
                out.append(self.unknown)
            at = last[at]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out: list[int] = []
        for word in WORD.findall(MARK + text.replace(" ", MARK)):
            if word:
                got = known.get(word)
                if got is None:
                    got = self.solve(word)
                    if len(word) <= 64:
                        known[word] = got
                out += got
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")


def load_pieces(path: str, ranks: bool = False) -> list[tuple[str, float, str]]:
    """(piece, log score, kind) of each id of a SentencePiece model file.

    With ``ranks``, for files whose scores are ranks of merges rather than log probabilities, a piece gets the log of
    Zipf's share of its rank among the pieces, by id.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [
        "unknown" if m.is_unknown(i) else "control" if m.is_control(i) else "byte" if m.is_byte(i) else "normal"
        for i in range(m.get_piece_size())
    ]
    plain = [i for i, k in enumerate(kinds) if k == "normal"]
    scores = {i: m.get_score(i) for i in plain}
    if ranks:
        whole = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
        scores = {i: -math.log(r) - whole for r, i in enumerate(plain, 1)}
    return [(m.id_to_piece(i), scores.get(i, 0.0), k) for i, k in enumerate(kinds)]


ENCODED = fields("n_ids long, ids ints, decoded string")


def encode_documents(docs: DataFrame, pieces: list[tuple[str, float, str]]) -> DataFrame:
    """One row per document: doc_id, n_ids, ids, and the text that decoding the ids gives."""
    model = Unigram(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        got = [m.encode(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(x) for x in got], pa.int64()),
                pa.array(got, pa.list_(pa.int32())),
                pa.array([m.decode(x) for x in got], pa.string()),
            ],
            names=["doc_id", *ENCODED.names],
        )

    return map_arrow(ids, run, T.StructType([ids.schema["doc_id"], *ENCODED.fields]))
