"""Quality classifier by importance resampling.

Generative models over hashed n-grams (words, and byte 4- and 7-grams that keep case and punctuation) are
compared: the target, fitted on labelled good documents, against raw text, which is every document, and
against the two kinds of raw text that labels single out, low quality and toxic; their few telling words
drown in the first contrast alone. A feature's log ratio is log((t + K) / (e + K)), the counts scaled to
the smaller model, and 0 where the counts differ by less than SURE standard deviations or by less than a factor of
e**TELLING: common words say nothing, however many a long text has. A contrast's log weight is the sum over
a document's features, less the value that best parts held-out labelled documents; a document's log
weight is the least of the three. Rows are drawn by Gumbel top-k: the k largest of log weight plus Gumbel
noise, k being the number of documents with a log weight of 0 or more.

Model tables have a fixed number of slots. Labels beyond MAX_LABELS are left out of the fit, those with
the smallest hashes staying; all else covers every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import scan
from sightline.llm.exchange import pack, unpack
from sightline.llm.native import shared_checkpoints, small_batches, table, text_of

SLOTS = 1 << 18
SLICES = 16
GRAMS = (4, 7)
FAMILIES = 1 + len(GRAMS)
K = 3.0
SURE = 5.0
TELLING = 2.0
TYPICAL = 1000
GOOD_COST = 4.0
MAX_LABELS = 20_000
CALIBRATION = 5  # one labelled document in so many sets the threshold and fits nothing
BIN = 0.25
_LOWERED = scan.BYTES[scan.LOWER]
_SHIFT = np.uint64(46)


def features(data: np.ndarray, offsets: np.ndarray):
    """Yields (first text, last text, [(slots, their texts' bounds) of each family])."""
    for a, b in scan.pieces(offsets):
        part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, stop, begin = scan.words(part, offs, scan.ALNUM)
        families = [((scan.span_hash(scan.prefix(part, _LOWERED), start, stop) >> _SHIFT).astype(np.int64), begin)]
        p = scan.prefix(part)
        for i, size in enumerate(GRAMS, 1):
            m = max(len(part) - size + 1, 0)
            slots = (scan.mix((p[size:] - p[:m]) * scan.powers(m)[1]) >> _SHIFT).astype(np.int64) if m else np.zeros(0, np.int64)
            crossing = (offs[1:-1, None] - np.arange(1, size)).reshape(-1)  # grams that reach into the next text
            inside = np.ones(m, bool)
            inside[crossing[(crossing >= 0) & (crossing < m)]] = False
            families.append((slots[inside] + i * SLOTS, np.append(0, np.cumsum(inside))[np.clip(offs, 0, m)]))
        yield a, b, families


MODELS = ("raw", "good", "low", "toxic")
_COUNTED = "slice int, " + ", ".join(f"{m} binary" for m in MODELS)


def _count(batches):
    n = {m: np.zeros(FAMILIES * SLOTS, np.int64) for m in MODELS}
    for batch in batches:
        data, offsets = scan.buffers(batch.column("text"))
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        for a, b, families in features(data, offsets):
            for slots, at in families:
                n["raw"] += np.bincount(slots, minlength=FAMILIES * SLOTS)
                if (kind[a:b] > 0).any():
                    per = np.repeat(kind[a:b], np.diff(at))
                    for k, m in enumerate(MODELS[1:], 1):
                        n[m] += np.bincount(slots[per == k], minlength=FAMILIES * SLOTS)
    width = FAMILIES * SLOTS // SLICES
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(SLICES), pa.int32()), *(pa.array([pack(n[m][i * width : (i + 1) * width]) for i in range(SLICES)], pa.binary()) for m in MODELS)], names=["slice", *MODELS]
    )


def _add(group: pa.Table) -> pa.Table:
    sums = {m: pa.array([pack(sum((unpack(x.as_py(), np.int64) for x in group[m]), np.zeros(FAMILIES * SLOTS // SLICES, np.int64)))], pa.binary()) for m in MODELS}
    return pa.table({"slice": group["slice"].slice(0, 1), **sums})


def fit(docs: DataFrame) -> np.ndarray:
    """(FAMILIES * SLOTS, 3) log ratios of the good model to the others, from (text, kind), kind being the number of a labelled row's model, else 0."""
    rows = sorted(docs.mapInArrow(_count, _COUNTED).groupBy("slice").applyInArrow(_add, _COUNTED).collect(), key=lambda r: r.slice)
    out = np.zeros((FAMILIES, SLOTS, 3))
    if rows:
        n = {m: np.concatenate([unpack(bytes(r[m]), np.int64) for r in rows]).astype(float).reshape(FAMILIES, SLOTS) for m in MODELS}
        for c, other in enumerate(("raw", "low", "toxic")):
            for kind in range(FAMILIES):
                t, e = n["good"][kind], n[other][kind]
                if t.sum() and e.sum():
                    least = min(t.sum(), e.sum())
                    t, e = t * (least / t.sum()), e * (least / e.sum())
                    ratio = np.log((t + K) / (e + K))
                    out[kind, :, c] = np.where(((t - e) ** 2 >= SURE**2 * (t + e)) & (np.abs(ratio) >= TELLING), ratio, 0.0)
        for kind, size in enumerate(GRAMS, 1):
            out[kind] /= size  # each byte stands in so many grams
    return out.reshape(-1, 3).astype(np.float32)


def log_weights(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """(texts, 3): the sums of the three contrasts; that to low quality, where every feature tells, as for a text of TYPICAL features."""
    out, n = np.zeros((len(offsets) - 1, 3)), np.zeros(len(offsets) - 1)
    for a, b, families in features(data, offsets):
        for slots, at in families:
            for c in range(3):
                out[a:b, c] += np.diff(np.append(0.0, np.cumsum(ratio[slots, c], dtype=np.float64))[at])
            n[a:b] += np.diff(at)
    out[:, 1] *= TYPICAL / np.maximum(n, 1)
    return out


def gumbel(key: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise from 64-bit keys."""
    u = (scan.mix(key.view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    return -np.log(-np.log(u))


def _scored(ratio):
    def go(batches):
        r = ratio.value
        for batch in batches:
            data, offsets = scan.buffers(batch.column("text"))
            w = log_weights(data, offsets, r)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("seed"), batch.column("kind"), *map(pa.array, np.ascontiguousarray(w.T))], names=["doc", "seed", "kind", "c0", "c1", "c2"])

    return go


def _drawn(batches):
    for batch in batches:
        w = batch.column("log_weight").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("log_weight"), pa.array(w + gumbel(batch.column("seed").to_numpy(zero_copy_only=False).copy()))], names=["doc", "log_weight", "drawn"])


def _threshold(rows) -> float:
    """The value that parts bad from good with the smallest sum of the two error rates, a lost good text weighing GOOD_COST times; rows are (bin, good?, n)."""
    bins = sorted({r[0] for r in rows})
    good = np.array([sum(n for b, y, n in rows if b == x and y == 1) for x in bins], float)
    bad = np.array([sum(n for b, y, n in rows if b == x and y == 0) for x in bins], float)
    if not good.sum() or not bad.sum():
        return -np.inf
    lost = np.append(0, np.cumsum(good)) / good.sum()
    passed = 1 - np.append(0, np.cumsum(bad)) / bad.sum()
    cost = GOOD_COST * lost + passed
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    at = int(best[len(best) // 2])
    edges = [bins[0], *[(x + y + 1) / 2 for x, y in zip(bins, bins[1:])], bins[-1] + 1]
    return edges[at] * BIN


def _kth_largest(scores: DataFrame, k: int, most: int = 10_000) -> float:
    """The exact k-th largest of drawn, by narrowing a histogram until the bin that holds it is small."""
    low, high, n = scores.agg(F.min("drawn"), F.max("drawn"), F.count("*")).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return float("-inf")
    above = 0
    while True:
        inside = scores.filter((F.col("drawn") >= low) & (F.col("drawn") <= high))
        width = (high - low) / 1000
        if n <= most or width <= 0 or low + width == low:
            rows = inside.groupBy("drawn").count().orderBy(F.col("drawn").desc()).limit(most).collect()
            for r in rows:
                above += r["count"]
                if above >= k:
                    return r.drawn
            return low
        bins = inside.groupBy(F.least(F.floor((F.col("drawn") - low) / width), F.lit(999)).alias("b")).agg(F.count("*").alias("n"), F.min("drawn").alias("low"), F.max("drawn").alias("high")).collect()
        for r in sorted(bins, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n


class Classifier:
    """A fitted sampler: ratio (slots), thresholds (of the three contrasts), cutoff (drawn), kept (k).

    labels has label_id, quality and toxic; rows without an id or with a null quality that isn't toxic say nothing, and
    of repeated labels the worst counts. Null texts are empty. Empty texts have weight 0 before the thresholds.
    Repeated rows are scored alike and stay or go together. Without labels every threshold is minus infinity and all
    rows stay; an empty table stays empty. A text of any length is scored as a whole.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS, label_id: str = "doc_id"):
        spark = docs.sparkSession
        shared_checkpoints(spark)
        small_batches(spark)
        kind = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1)
        y = labels.select(F.col(label_id).cast("long").alias("doc"), kind.alias("kind")).filter(F.col("doc").isNotNull() & F.col("kind").isNotNull())
        y = y.groupBy("doc").agg(F.max("kind").alias("kind")).withColumn("h", F.xxhash64("doc")).orderBy("h", "doc").limit(max_labels)
        self.columns = (doc_id, text)
        x = self._prepared(docs).join(F.broadcast(y), "doc", "left")  # at most max_labels rows
        fold = F.pmod("h", F.lit(CALIBRATION))
        self.ratio = fit(x.select("text", F.coalesce(F.when(fold != 0, F.col("kind")), F.lit(0)).alias("kind")))
        self.shared = spark.sparkContext.broadcast(self.ratio)
        x = x.select("doc", "text", "seed", F.when(fold == 0, F.col("kind")).alias("kind"))
        sums = x.mapInArrow(_scored(self.shared), "doc long, seed long, kind int, c0 double, c1 double, c2 double").checkpoint()
        self.sums = sums
        labelled = sums.filter("kind is not null")
        self.thresholds = []
        for c, bad in (("c0", (2, 3)), ("c1", (2,)), ("c2", (3,))):
            bins = labelled.filter(F.col("kind").isin(1, *bad)).groupBy(F.floor(F.col(c) / BIN).alias("b"), (F.col("kind") == 1).cast("int").alias("good")).count().collect()
            self.thresholds.append(_threshold([tuple(r) for r in bins]))
        least = F.least(*(F.col(f"c{i}") - F.lit(t) for i, t in enumerate(self.thresholds)))
        self.scores = sums.select("doc", "seed", least.alias("log_weight")).mapInArrow(_drawn, "doc long, log_weight double, drawn double").checkpoint()
        self.kept = self.scores.filter("log_weight >= 0").count()
        self.cutoff = _kth_largest(self.scores.select("drawn"), self.kept)

    def _prepared(self, docs: DataFrame) -> DataFrame:
        doc_id, text = self.columns
        t = text_of(text)
        return docs.select(F.col(doc_id).cast("long").alias("doc"), t.alias("text"), F.xxhash64(F.col(doc_id).cast("long"), t).alias("seed"))

    def result(self) -> DataFrame:
        """(doc, log_weight, drawn, keep), one row for each input row."""
        return self.scores.select("doc", "log_weight", "drawn", (F.col("drawn") >= F.lit(self.cutoff)).alias("keep"))

    def sample(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are drawn, with their own columns."""
        doc_id, text = self.columns
        shared, thresholds, cutoff, names, t = self.shared, np.array(self.thresholds), self.cutoff, docs.columns, text_of(text)

        def go(batches):
            for batch in batches:
                data, offsets = scan.buffers(batch.column(len(names) + 1))
                drawn = (log_weights(data, offsets, shared.value) - thresholds).min(axis=1) + gumbel(batch.column(len(names)).to_numpy(zero_copy_only=False).copy())
                kept = batch.filter(pa.array(drawn >= cutoff))
                yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names=names)

        return docs.select("*", F.xxhash64(F.col(doc_id).cast("long"), t), t).mapInArrow(go, docs.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Weight and draw of every document. A null text is the empty one, repeated rows repeat their weight, long texts count whole and an empty table gives no rows."""
    out = Classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).result()
    return out.select(F.col("doc").alias("doc_id"), "log_weight", "drawn", "keep")
