"""Quality and latency of prediction sets.

Detections: variant, image, ord, label, score, l, t, r, b. Timings: document, stage, run, ms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .lineage import cut, within_tables


def ranked(found: DataFrame) -> DataFrame:
    """Detections numbered within their image by falling score."""
    order = Window.partitionBy("variant", "image").orderBy(F.desc("score"), "ord")
    return found.withColumn("id", (F.row_number().over(order) - 1).cast("long"))


def paired(found: DataFrame, variant: str, base: str = "baseline", by: str = "ord") -> DataFrame:
    """The i-th detection of the base beside the i-th of a variant in the order of ``by``, with their IoU and greatest corner difference."""
    place = Window.partitionBy("image").orderBy(by)
    numbered = lambda v: found.where(F.col("variant") == v).withColumn("k", F.row_number().over(place))
    a, b = numbered(base).alias("a"), numbered(variant).alias("b")
    return a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.k") == F.col("b.k"))).select(
        F.col("a.image").alias("image"),
        F.col("a.k").cast("long").alias("k"),
        G.iou(G.box("a."), G.box("b.")).alias("iou"),
        (F.col("a.label") == F.col("b.label")).alias("same"),
        F.abs(F.col("a.score") - F.col("b.score")).alias("d_score"),
        F.greatest(*(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "ltrb")).alias("d_box"),
    )


def quality(pairs: DataFrame) -> DataFrame:
    """Mean IoU, shares at 0.5 and 0.75, label agreement and mean score difference; 1 and 0 without pairs."""
    share = lambda c: F.avg(c.cast("double"))
    return pairs.agg(
        F.coalesce(F.avg("iou"), F.lit(1.0)).alias("mean_iou"),
        F.coalesce(share(F.col("iou") >= 0.5), F.lit(1.0)).alias("iou_50"),
        F.coalesce(share(F.col("iou") >= 0.75), F.lit(1.0)).alias("iou_75"),
        F.coalesce(share(F.col("same")), F.lit(1.0)).alias("agreement"),
        F.coalesce(F.avg("d_score"), F.lit(0.0)).alias("d_score"),
    )


def box_count_change(found: DataFrame, variant: str, base: str = "baseline") -> DataFrame:
    """Mean change of the number of boxes per image, absolute and in percent of the base's."""
    n = found.groupBy("image").agg(F.count_if(F.col("variant") == base).alias("n"), F.count_if(F.col("variant") == variant).alias("m"))
    return n.agg(F.avg(F.col("m") - F.col("n")).alias("d_boxes"), F.avg((F.col("m") - F.col("n")) / F.greatest(F.lit(1), F.col("n")) * 100).alias("d_percent"))


def greedy_pairs(found: DataFrame, variant: str, base: str = "baseline", least: float = 0.1) -> DataFrame:
    """One-to-one pairs per image and label: base boxes in order take the best unused box, if its IoU reaches ``least``.

    Candidates come from an equi-join with overlap; the order-dependent choice runs over an image's candidates as they come in order.
    """
    within_tables(found.sparkSession)
    a, b = found.where(F.col("variant") == base).alias("a"), found.where(F.col("variant") == variant).alias("b")
    near = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.label") == F.col("b.label")) & G.overlaps(G.box("a."), G.box("b."))).select(
        F.col("a.image").alias("image"), F.col("a.label").alias("label"), F.col("a.ord").alias("x"), F.col("b.ord").alias("y"), G.iou(G.box("a."), G.box("b.")).alias("iou")
    )

    order, names = Window.partitionBy("image").orderBy("x", F.desc("iou"), "y"), near.columns

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an image may go over several batches
        used, last = set(), ()
        for batch in batches:
            keep = []
            for place, x, y, iou in zip(*(batch.column(c).to_pylist() for c in ("place", "x", "y", "iou"))):
                if place == 1:
                    used, last = set(), ()
                # a base box takes the first unused box, and none if that overlaps too little
                free = x != last and y not in used
                keep.append(free and iou >= least)
                if free:
                    last = x
                    if iou >= least:
                        used.add(y)
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return near.withColumn("place", F.row_number().over(order)).mapInArrow(choose, near.schema)


def label_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("variant", "label").agg(F.count(F.lit(1)).alias("n"))


def confidence(found: DataFrame) -> DataFrame:
    s = F.coalesce("score", F.lit(0))
    return found.groupBy("variant").agg(F.avg(s).alias("mean"), F.max(s).alias("most"), F.min(s).alias("least"))


def box_areas(found: DataFrame) -> DataFrame:
    a = G.area(G.box())
    return found.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean"), F.max(a).alias("most"))


def latency(times: DataFrame, by: list[str]) -> DataFrame:
    """Mean, exact median and 95th percentile with linear interpolation."""
    return times.groupBy(*by).agg(F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"))


def stage_means(times: DataFrame, warm_up: int = 1, most: int = 6) -> DataFrame:
    """Mean per document and stage over the runs after the warm-up."""
    return times.where((F.col("run") >= warm_up) & (F.col("run") < most)).groupBy("document", "stage").agg(F.avg("ms").alias("ms"))


def stage_summary(means: DataFrame) -> DataFrame:
    """Sum over documents per stage and its share of all stages in percent."""
    s = means.groupBy("stage").agg(F.sum("ms").alias("ms"))
    whole = s.agg(F.sum("ms").alias("whole"))
    return s.join(F.broadcast(whole)).select("stage", "ms", (F.col("ms") / F.greatest(F.lit(1e-9), F.col("whole")) * 100).alias("share"))


def against_baseline(base: DataFrame, now: DataFrame, key: str, value: str = "ms") -> DataFrame:
    """Outer comparison by key: both values, their difference and the percent change (0 for a base of about 0)."""
    j = base.select(key, F.col(value).alias("base")).join(now.select(key, F.col(value).alias("now")), key, "full_outer")
    b, n = F.coalesce("base", F.lit(0.0)), F.coalesce("now", F.lit(0.0))
    return j.select(key, b.alias("base"), n.alias("now"), (n - b).alias("delta"), F.when(F.abs(b) < 1e-9, 0.0).otherwise((n - b) / b * 100).alias("percent"))


def best_run(times: DataFrame) -> DataFrame:
    """Per document the run of the least mean, the first on ties."""
    m = times.groupBy("document", "run").agg(F.avg("ms").alias("avg_ms"))
    return m.groupBy("document").agg(F.min(F.struct("avg_ms", "run")).alias("x")).select("document", F.col("x.run").alias("run"), F.col("x.avg_ms").alias("avg_ms"))


def last_runs(times: DataFrame, window: int = 20) -> DataFrame:
    """Mean and median per document and stage over the last ``window`` runs."""
    order = Window.partitionBy("document", "stage").orderBy(F.desc("run"))
    return times.withColumn("k", F.row_number().over(order)).where(F.col("k") <= window).groupBy("document", "stage").agg(
        F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"), F.count(F.lit(1)).alias("calls")
    )


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Counts per bin; values at ``high`` count in the last bin."""
    b = F.least(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("long")
    return values.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def parity(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether a variant may stand for the base, in all or per ``by``: corners apart by under 2 in the median, nearly all
    IoUs at 0.5, all labels equal, and no score off by more than 0.01. Pairs go by falling score."""
    q = pairs.groupBy(*by).agg(
        F.coalesce(F.median("d_box"), F.lit(0.0)).alias("d_median"),
        F.coalesce(F.avg((F.col("iou") >= 0.5).cast("double")), F.lit(1.0)).alias("iou_50"),
        F.coalesce(F.bool_and("same"), F.lit(True)).alias("labels"),
        F.coalesce(F.bool_and(F.col("d_score") <= 0.01), F.lit(True)).alias("scores"),
    )
    return q.withColumn("passes", (F.col("d_median") < 2) & (F.col("iou_50") > 0.98) & F.col("labels") & F.col("scores"))


def acceptance(q: DataFrame, change: DataFrame, speed_ratio: float, size_mb: float) -> DataFrame:
    """Verdict for a compressed model: quality kept, boxes within one percent, and faster or small."""
    j = q.join(F.broadcast(change))
    cheap = speed_ratio <= 0.9 or size_mb <= 50
    return j.select(((F.col("iou_50") >= 0.995) & (F.col("mean_iou") >= 0.99) & (F.abs("d_percent") <= 1) & F.lit(cheap)).alias("passes"))


def label_universe(*found: DataFrame) -> DataFrame:
    """All labels of some sets of detections."""
    out = found[0].select("label")
    for more in found[1:]:
        out = out.union(more.select("label"))
    return out.distinct()


def first_k(rows: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The first ``k`` rows by ``key`` of each ``by``."""
    order = Window.partitionBy(by).orderBy(key)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def placed(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with their ``place`` in the order of ``key`` over all rows: by ranges of keys, whose sizes are summed up."""
    ranged = cut(rows.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    return ranged.withColumn("at", at).join(F.broadcast(before.select("part", "before")), "part").select(*rows.columns, (F.col("before") + F.col("at")).alias("place"))


def guesses(scores: DataFrame) -> DataFrame:
    """(sample, rank, right) of scores (sample, label, k, x): classes by falling score, the lower class first on ties."""
    order = Window.partitionBy("sample").orderBy(F.desc("x"), "k")
    return scores.select("sample", (F.row_number().over(order) - 1).alias("rank"), F.coalesce(F.col("k") == F.col("label"), F.lit(False)).alias("right"))


def run_totals(times: DataFrame) -> DataFrame:
    """Per document, stage and run the sum of its calls."""
    return times.groupBy("document", "stage", "run").agg(F.sum("ms").alias("ms"))


def document_totals(times: DataFrame) -> DataFrame:
    """Per run the total over documents and the average per document."""
    each = times.groupBy("run", "document").agg(F.sum("ms").alias("ms"))
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    return each.groupBy("run").agg(F.sum("ms").alias("total_ms"), (F.sum("ms") / n).alias("average_ms"))


def speed_up(times: DataFrame, key: str, base: str, other: str) -> DataFrame:
    """Ratio of two columns of a comparison; null where the second is zero."""
    return times.select(key, F.try_divide(F.col(base), F.col(other)).alias("speed_up"))


def running_average(values: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Last value, sum, count and average of a weighted meter."""
    total, n = F.sum(F.col(value) * F.col(weight)), F.sum(weight)
    return values.groupBy(by).agg(total.alias("sum"), n.alias("n"), (total / n).alias("average"))


def top_k_accuracy(ranked_guesses: DataFrame, k: int) -> DataFrame:
    """Percent of samples whose label is among the first ``k`` guesses (sample, rank from 0, right)."""
    hit = ranked_guesses.where(F.col("rank") < k).groupBy("sample").agg(F.max(F.col("right").cast("int")).alias("hit"))
    return hit.agg((F.avg("hit") * 100).alias("accuracy"))


def array_difference(arrays: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Greatest absolute difference of two arrays of one length, and as a share of the first's greatest magnitude."""
    most = lambda x: F.array_max(F.transform(x, F.abs))
    gap = most(F.zip_with(a, b, lambda x, y: x - y))
    return arrays.select(key, gap.alias("d_max"), (gap / F.greatest(most(F.col(a)), F.lit(1e-9))).alias("d_relative"))


def profile(samples: DataFrame, window: int = 20) -> DataFrame:
    """Per session and section, over its last ``window`` cycles: mean and median of a cycle's time and calls, and the most memory.

    Samples: session, cycle, section, dt, kb.
    """
    cycles = samples.groupBy("session", "section", "cycle").agg(F.sum("dt").alias("dt"), F.count(F.lit(1)).alias("calls"), F.max("kb").alias("kb"))
    order = Window.partitionBy("session", "section").orderBy(F.desc("cycle"))
    last = cycles.withColumn("k", F.row_number().over(order)).where(F.col("k") <= window)
    return last.groupBy("session", "section").agg(
        F.avg("dt").alias("mean_dt"), F.median("dt").alias("median_dt"), F.avg("calls").alias("mean_calls"), F.median("calls").alias("median_calls"),
        F.max("kb").alias("most_kb"), F.count(F.lit(1)).alias("cycles"),
    )


def mean_elapsed(times: DataFrame, warm_up: int = 1) -> DataFrame:
    """Mean time per document over the runs after the warm-up."""
    return times.where(F.col("run") >= warm_up).groupBy("document").agg(F.avg("ms").alias("mean_ms"))


def comparison(found: DataFrame, times: DataFrame, sizes: DataFrame, base: str = "baseline") -> DataFrame:
    """One row per variant: mean IoU with the base (1 for itself), mean and 95th percentile of its times, size in MiB; zeros where unknown."""
    variants = found.select("variant").distinct()
    place = Window.partitionBy("variant", "image").orderBy("ord")
    k = found.withColumn("k", F.row_number().over(place))
    a, b = k.where(F.col("variant") == base).alias("a"), k.where(F.col("variant") != base).alias("b")
    iou = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.k") == F.col("b.k"))).groupBy(F.col("b.variant").alias("variant"))
    iou = iou.agg(F.avg(G.iou(G.box("a."), G.box("b."))).alias("mean_iou"))
    zero = F.lit(0.0)
    # one row per variant
    return variants.join(iou, "variant", "left").join(latency(times, ["variant"]), "variant", "left").join(sizes, "variant", "left").select(
        "variant", F.coalesce("mean_iou", F.lit(1.0)).alias("mean_iou"), F.coalesce("mean_ms", zero).alias("mean_ms"),
        F.coalesce("p95_ms", zero).alias("p95_ms"), F.coalesce(F.col("bytes") / 1048576, zero).alias("size_mb"),
    )
