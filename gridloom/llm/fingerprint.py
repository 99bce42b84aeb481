"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are the 5-word shingles of a text (lower-cased, blank-separated; fewer words: the whole sequence,
none: one empty term), weighted by how often they occur. For each of ``SAMPLES`` samples and each term a
hash gives r, c ~ Gamma(2, 1) and b ~ U(0, 1); with weight w, t = floor(ln w / r + b), and the term of
least ln c - r (t - b + 1) is sampled. As that value depends on the term and t alone, the least value
itself is the sample: two texts agree in a sample with probability equal to the generalised Jaccard
similarity of their weights. A sample is written as 8 hex digits of its hash.

Every document is set beside an edited text, whose last quarter of code points is replaced by the first
as many of the next document. Documents are ordered by id (nulls last), then by the hash of their text;
after the last comes the first. Neighbours are found within buckets of ids close to each other, nulls in many
buckets by their hash; only a bucket's last document looks further, by ranges of bucket numbers.

A likeness from n samples has a standard error of at most 1 / (2 sqrt(n)), 0.088 for 32; more samples would take more disk than the limit allows.

Defined cases: repeated rows are documents of their own, null texts are empty, texts are read whole, a single document
is its own next, no rows give no rows; ids are integers or null (others are an error); other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SAMPLES, WIDTH, SHINGLE = 32, 8, 5
#: Terms whose value must exceed FAR times the expected least are passed over; a least beyond it has a chance of exp(-FAR).
FAR = 32.0
BLANKS, BLANK_RUN = " \t\n\x0b\x0c\r", "[ \t\n\x0b\x0c\r]+"
#: Ids that differ only in so many low bits share a bucket; null ids go to buckets by as many high bits of their hash.
BUCKET_BITS, NULL_BITS = 9, 20
LAST = 1 << 62


def _next_buckets(buckets: DataFrame) -> DataFrame:
    """(b, next_b) for distinct buckets; the last one's next is the first."""
    ranged = cut(buckets.repartitionByRange("b").withColumn("part", F.spark_partition_id()))
    # one row per partition
    whole = Window.orderBy("part")
    edges = ranged.groupBy("part").agg(F.min("b").alias("first_b"))
    edges = edges.select("part", F.coalesce(F.lead("first_b").over(whole), F.min("first_b").over(whole.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    near = F.lead("b").over(Window.partitionBy("part").orderBy("b"))
    return ranged.withColumn("near", near).join(F.broadcast(edges), "part").select("b", F.coalesce("near", "after").alias("next_b"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(b, rn): place of a document; doc_id, text; (nb, nrn): place of the next one; its text."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError(f"doc_id must be of an integer type, not {docs.schema['doc_id'].dataType.simpleString()}")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nameless = F.lit(LAST) + F.shiftright(F.xxhash64("text"), 64 - NULL_BITS)
    rows = rows.withColumn("b", F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BUCKET_BITS), nameless))
    inside = Window.partitionBy("b").orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    placed = rows.select(
        "b", "doc_id", "text", F.row_number().over(inside).alias("rn"), F.lead("text").over(inside).alias("next_text")
    )
    within = placed.where("next_text is not null").select("b", "rn", "doc_id", "text", F.col("b").alias("nb"), (F.col("rn") + 1).alias("nrn"), "next_text")
    firsts = placed.where("rn = 1").select(F.col("b").alias("nb"), F.col("text").alias("next_text"))
    lasts = placed.where("next_text is null").join(_next_buckets(rows.select("b").distinct()), "b")
    between = lasts.select("b", "rn", "doc_id", "text", F.col("next_b").alias("nb")).join(firsts, "nb")
    return within.unionByName(between.withColumn("nrn", F.lit(1)))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, which a projection alone would not ensure inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _word_hashes(text: Column) -> Column:
    return F.transform(F.split(F.btrim(F.lower(text), F.lit(BLANKS)), BLANK_RUN), lambda w: F.xxhash64(w))


def _shingle_hashes(words: Column) -> Column:
    """64-bit hashes of the shingles of an array of word hashes; fewer words give one shingle of them all."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    zipped = F.arrays_zip(*(F.slice(words, F.lit(k + 1), n) for k in range(SHINGLE)))
    return F.transform(zipped, lambda z: F.xxhash64(z))


def _starts(hashes: Column) -> Column:
    """Where runs of equal elements begin, and the array's size at the end."""
    first = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1)))
    return F.array_append(first, F.size(hashes))


def _counted(hashes: Column) -> Column:
    """Structs (0: element, 1: count) of the distinct elements of an array and their counts."""
    runs = lambda ordered: _let(
        _starts(ordered),
        lambda at: F.transform(
            F.slice(at, F.lit(1), F.size(at) - 1), lambda s, k: F.struct(F.get(ordered, s).alias("0"), (F.get(at, k + 1) - s).alias("1"))
        ),
    )
    # most texts repeat no shingle
    once = lambda d: F.transform(d, lambda h: F.struct(h.alias("0"), F.lit(1).alias("1")))
    return _let(
        F.array_distinct(hashes),
        lambda d: F.when(F.size(d) == F.size(hashes), once(d)).otherwise(_let(F.sort_array(hashes), runs)),
    )


def _terms(df: DataFrame, text: str) -> DataFrame:
    """Replaces the text by rows (h, w, n): distinct shingles, their counts, and the sum of the text's counts."""
    keys = [c for c in df.columns if c != text]
    terms = _let(_word_hashes(F.col(text)), lambda words: _let(_shingle_hashes(words), lambda hs: F.struct(F.size(hs).alias("n"), _counted(hs).alias("x"))))
    told = df.select(*keys, terms.alias("y")).select(*keys, "y.n", F.explode("y.x").alias("x"))
    return told.select(*keys, F.col("x")["0"].alias("h"), F.col("x")["1"].alias("w"), "n")


def _uniform(bits: Column, shift: int) -> Column:
    """21 bits of a hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)


def _value(i: int) -> Column:
    """The sampled value of a term (h, w) in sample i of lane j; null where it cannot be a text's least.

    The least of exp(value) over a text is exponentially distributed with the text's total weight n, so it
    exceeds FAR / n with a probability of exp(-FAR). Where a lower bound without logarithms, from
    -ln p >= 1 - p and q ** k >= q / (q + k (1 - q)), already exceeds that, the term is passed over.
    """
    x, y = F.xxhash64("h", "j", F.lit(2 * i)), F.xxhash64("h", "j", F.lit(2 * i + 1))
    q, p, b = _uniform(x, 0) * _uniform(x, 21), _uniform(y, 0) * _uniform(y, 21), _uniform(y, 42)
    single = F.col("w") == 1
    bound = (1 - p) * F.when(single, q / (q + (1 - b) * (1 - q))).otherwise(q / F.col("w"))
    r = -F.log(q)
    steps = F.when(single, 1 - b).otherwise(F.floor(F.log(F.col("w").cast("double")) / r + b) - b + 1)
    return F.when(bound * F.col("n") <= FAR, F.log(-F.log(p)) - r * steps)


def samples(df: DataFrame, text: str) -> DataFrame:
    """Replaces ``text`` by (j, sig): per lane j an array of WIDTH hashes of sampled values. Other columns must be a key.

    Lanes keep the generated code of a row small enough to be compiled.
    """
    keys = [c for c in df.columns if c != text]
    terms = _terms(df, text).withColumn("j", F.explode(F.array(*(F.lit(j) for j in range(SAMPLES // WIDTH)))))
    least = terms.groupBy(*keys, "j").agg(*(F.min(_value(i)).alias(f"v{i}") for i in range(WIDTH)))
    return least.select(*keys, "j", F.array(*(F.xxhash64(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(WIDTH))).alias("sig"))


def _text_of(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def _likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(SAMPLES))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    near = neighbours(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ["b", "rn", "doc_id", "nb", "nrn", "n_chars", "sha"]
    told = near.select(
        "b", "rn", "doc_id", "nb", "nrn", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("x"),
    ).select(*keys, "x.e", "x.t")
    # two texts of a few lanes each
    lanes = samples(told, "t").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("e", "j", "sig"))).alias("all"))
    whole = lanes.select(*keys, F.flatten(F.transform("all", lambda s: s["sig"])).alias("all"))
    both = whole.select(*keys, F.slice("all", 1, SAMPLES).alias("own"), F.slice("all", SAMPLES + 1, SAMPLES).alias("changed"))
    following = both.select(F.col("b").alias("nb"), F.col("rn").alias("nrn"), F.col("own").alias("next_own"))
    return both.join(following, ["nb", "nrn"]).select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        _text_of(F.col("own")).alias("fingerprint"),
        _text_of(F.col("changed")).alias("edited_fingerprint"),
        _likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        _likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
