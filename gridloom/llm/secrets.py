"""Secret scans: assignment-aware lexing over whole texts.

Base patterns find `assign`, `access` and `hex` spans. Beyond them the text is lexed as source or
configuration syntax: name-literal pairs (``name = "literal"``, ``name: literal``, ``export name=literal``,
``<name>literal</name>``), adjacent or ``+``-joined literals, which make one value, and constants that
another name refers to (``a = "..."`` before or after ``db_password = a``, ``$a``, ``${a}``). A literal is scored by the sensitivity of the names it
reaches, its character classes and its entropy; those at or above a threshold become `literal` spans.

Positions are code points, end exclusive.

Defined cases: a null or empty text has no spans, and a null text stays null where it is masked; texts, names and
literals of any length are read whole, in about linear time; rows with equal ids are each scanned; no rows give no rows;
ids may be of any type or null; other columns, whatever their names, pass through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])"""
    r"""|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A cheap look for anything that the lexer could use.
HINT = re.compile(r"[:=>]")
#: Between a name and its value.
SEPARATOR = re.compile(r":=|=>|=|:|>")
NAME_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-"
BLANKS = re.compile(r"[ \t]*")
#: A literal up to its own quote on the same line; backslashes escape.
QUOTED = re.compile(r"""[bBfFrRuU]{0,2}(["'`])((?:(?!\1)[^\\\n]|\\.)++)\1""")
#: Between the parts of one value, outside and inside of parentheses.
PLUS = re.compile(r"[ \t]*(?:\\?\n[ \t]*)?\+[ \t]*(?:\\?\n[ \t]*)?")
ADJACENT = re.compile(r"[ \t]*(?:\\\n[ \t]*)?")
OPEN, INSIDE = re.compile(r"\([ \t]*\n?[ \t]*"), re.compile(r"\s*(?:\+\s*)?")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*+")
REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_.-]*+)\}|([A-Za-z_][A-Za-z0-9_]*+))")
SHELL = re.compile(r"(?:\$\{[A-Za-z_][A-Za-z0-9_.-]*+\}|[A-Za-z0-9+/_.=~$@!#%^*-])++")
#: Parts of names that make a literal sensitive, with weights.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "api": 0.5, "key": 1.0, "private": 1.5, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "bearer": 2.0,
    "access": 1.0, "signature": 1.0, "salt": 1.0, "cert": 1.0, "session": 1.0, "dsn": 1.5, "connection": 1.0,
}
#: Literals that stand for no secret.
HARMLESS = re.compile(r"(?i)^(?:true|false|null|none|yes|no|on|off|todo|changeme|example.*|x+|\*+|<.*>|\$\{.*\}|%.*%|https?://[^@]*)$")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
THRESHOLD = 4.0


def name_weight(name: str) -> float:
    """Sum of the weights of the sensitive words that a name is made of."""
    parts = [w.lower() for w in WORD.findall(name)]
    return sum(SENSITIVE.get(w, 0.0) for w in dict.fromkeys(parts))


def literal_weight(text: str) -> float:
    """0 to 3: random-looking literals score high, words and placeholders low."""
    if len(text) < 6 or HARMLESS.match(text) or " " in text:
        return 0.0
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    classes = sum(map(bool, (re.search("[a-z]", text), re.search("[A-Z]", text), re.search("[0-9]", text), re.search("[^A-Za-z0-9]", text))))
    return min(3.0, max(0.0, bits - 2.0) + 0.5 * (classes - 1))


def term(text: str, at: int, bare: bool) -> tuple[int, tuple[int, int] | None, list[str]] | None:
    """(end, span, names referred to) of a literal or, if ``bare``, of an unquoted value.

    The span is None where the term is nothing but ``$`` references.
    """
    m = QUOTED.match(text, at)
    span = m and m.span(2)
    if not m and bare and (m := SHELL.match(text, at)):
        span = m.span()
    if not m:
        return None
    inside = text[span[0] : span[1]]
    names = [r[1] or r[2] for r in REFERENCE.finditer(inside)] if "$" in inside else []
    return m.end(), span, names


def pairs(text: str):
    """(name, terms of its value), in one pass: a name is looked for behind its separator, never before the
    last pair or separator, so that lengths need no bounds. A term is its span and the names it refers to."""
    at = 0
    while sep := SEPARATOR.search(text, at):
        before = text[at : sep.start()].rstrip(" \t")
        before = before[:-1] if before.endswith(('"', "'")) else before
        name = before[len(before.rstrip(NAME_CHARS)) :].lstrip("0123456789.-")
        at = sep.end()
        if not name:
            continue
        start = BLANKS.match(text, at).end()
        opened = OPEN.match(text, start)
        found = term(text, opened.end() if opened else start, not opened)
        if not found:
            continue
        at, span, names = found
        quoted, terms = text[at - 1] in "\"'`", [(span, names)]
        if not quoted:  # an unquoted sum of names, maybe up to a literal
            parts = text[span[0] : span[1]].rstrip("+").split("+")
            if all(map(IDENTIFIER.fullmatch, parts)):
                terms = [(span, parts)]
            if text[at - 1] == "+" and (found := term(text, at, False)):
                at, quoted = found[0], True
                terms.append(found[1:])
        while True:
            if opened:
                plus = INSIDE.match(text, at)
            else:
                plus = PLUS.match(text, at) or (ADJACENT.match(text, at) if quoted else None)
            if not plus:
                break
            if found := term(text, plus.end(), False):
                if len(terms) == 1 and not quoted and IDENTIFIER.fullmatch(text, *terms[0][0]):
                    terms[0] = (None, terms[0][1])
                at, quoted = found[0], True
                terms.append(found[1:])
            elif "+" in plus[0] and (m := IDENTIFIER.match(text, plus.end())):
                at, quoted = m.end(), False
                terms.append((None, [m[0]]))
            else:
                break
        yield name, terms


def literals(text: str) -> list[tuple[str, int, int]]:
    """`literal` spans of a text by assignment-aware lexing."""
    if not HINT.search(text):
        return []
    values = list(pairs(text))
    defined: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(values):
        defined.setdefault(name, []).append(i)
    # the weight of each name, and of all names that it reaches: the heaviest first, each name once
    weights = {n: name_weight(n) for n in defined}
    reach: dict[str, float] = {}
    for name in sorted(weights, key=weights.get, reverse=True):
        if weights[name] <= 0:
            break
        stack = [name]
        while stack:
            if (n := stack.pop()) not in reach:
                reach[n] = weights[name]
                stack += [r for i in defined[n] for _, refs in values[i][1] for r in refs if r in defined]

    def spans(i: int) -> list[tuple[int, int]]:
        """The spans of a value, names replaced by their last definition before, else the first."""
        out, seen, stack = [], {values[i][0]}, [(i, t) for t in values[i][1][::-1]]
        while stack:
            k, (span, refs) = stack.pop()
            known = [r for r in refs if r in defined]
            whole = span and (text[span[0] : span[1]] in known or set(text[span[0] : span[1]].rstrip("+").split("+")) <= set(known) or known and not REFERENCE.sub("", text[span[0] : span[1]]))
            if span and not whole:
                out.append(span)
            for r in known[::-1]:
                if r not in seen:
                    seen.add(r)
                    places = defined[r]
                    j = places[max(0, bisect_left(places, k) - 1)]
                    stack += [(j, t) for t in values[j][1][::-1]]
        return list(dict.fromkeys(out))

    found = set()
    for i, (name, _) in enumerate(values):
        if name in reach:
            parts = spans(i)
            value = literal_weight("".join(text[a:b] for a, b in parts))
            if value > 0 and reach[name] + value >= THRESHOLD:
                found.update(parts)
    return [("literal", a, b) for a, b in sorted(found)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, each leftmost and non-overlapping within its kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_text(text: str | None) -> tuple[list, list]:
    """(base spans, all spans); a `literal` that a base span holds whole is not repeated."""
    text = text or ""
    base = base_spans(text)
    # base spans go by their starts: one that begins no later and reaches at least as far holds a literal
    starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    extra = []
    for s in literals(text):
        k = bisect_right(starts, s[1])
        if not k or reach[k - 1] < s[2]:
            extra.append(s)
    return base, base + extra


SCAN = fields("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base, spans = scan_text(text)
            n = Counter(k for k, _, _ in base)
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *SCAN.names]
        )

    ids = docs.select("doc_id", "text")
    return map_arrow(ids, run, T.StructType([ids.schema["doc_id"], *SCAN.fields]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each maximal run of overlapping spans by ``[SECRET:kind]`` of its first span."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[SECRET:{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span masked; all columns kept, null texts stay null. ``n_chars`` is set anew if present."""
    at = docs.columns.index(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else mask(t, scan_text(t)[1]) for t in batch.column(at).to_pylist()]
        cols = list(batch.columns)
        cols[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema.set(at, pa.field(column, pa.string())))

    out = map_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(column).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
