"""Benchmark decontamination: hashed benchmark n-grams against every window of every document.

Method. The benchmark's word windows become a set of 64-bit hashes, which is broadcast where the counted
windows are at most ``max_set`` and shuffled otherwise; the plan is the same. A document is first probed at
every sixth word only: an occurrence of a ten-word window always contains a five-word run that starts
at a multiple of six, so the probe misses nothing. The probes' hashes meet the set, and a bitmap of the
texts that hit is broadcast (1 MB at most). Texts that pass have all their windows joined with the
benchmark's by their words. Items of fewer words are probed by all runs of their width.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.native import few_files, member_filter, shared_checkpoints, spare, table, text_of, words_of

MAX_SET = 100_000


def _gram(words: Column, start: Column, size) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """(item, gram, width): each window once an item. A shorter item is one window; an item without words has none."""
    words = items.select(F.col(item_id).alias("item"), words_of(text_of(text)).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(size))
    return (
        words.withColumn("width", width)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width"))))
        .select("item", _gram(F.col("w"), F.col("i"), F.col("width")).alias("gram"), "width")
        .distinct()
    )


def _starts(n: Column, width: int, step: int = 1) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width, F.lit(step))).otherwise(F.array().cast("array<int>"))


def hits(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 10, max_set: int = MAX_SET) -> DataFrame:
    """One row for each document and verified window occurrence: rid (names the row), doc, n_words, start, stop, item; the last three null for a clean document.

    rid tells rows with the same or no id apart; it holds within one result only.
    """
    shared_checkpoints(docs.sparkSession)
    windows = windows.checkpoint()
    few = F.broadcast if windows.count() <= max_set else (lambda x: x)  # counted
    part = size // 2
    probes = (
        windows.filter(F.col("width") == size)
        .withColumn("w", F.split("gram", " "))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - part))))
        .select(_gram(F.col("w"), F.col("i"), part).alias("gram"))
    )
    short = sorted(r.width for r in windows.select("width").distinct().collect() if r.width < size)  # fewer than size
    wanted = probes.unionByName(windows.filter(F.col("width") < size).select("gram")).select(F.xxhash64("gram").alias("h")).distinct()
    t = text_of(text)
    w, n = F.col("w"), F.col("n_words")

    def hashes(starts: Column, width: int) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(_gram(w, i, width)))

    x = docs.select(F.xxhash64(t).alias("key"), words_of(t).alias("w")).withColumn("n_words", F.size("w"))
    seen = x.select("key", F.explode(F.concat(hashes(_starts(n, part, size - part + 1), part), *(hashes(_starts(n, width), width) for width in short))).alias("h"))
    near = seen.join(few(wanted), "h", "left_semi").select("key").distinct().coalesce(few_files(docs)).checkpoint()
    plain = docs.select(F.col(doc_id).alias("doc"), t.alias("text"))

    def told(wanted: bool) -> DataFrame:
        rows = member_filter(plain, F.xxhash64("text"), near, "key", wanted).select((F.monotonically_increasing_id() * 2 + int(wanted)).alias("rid"), "doc", words_of(F.col("text")).alias("w"))
        return rows.withColumn("n_words", F.size("w"))

    def runs(width: int) -> Column:
        return F.transform(_starts(n, width), lambda i: F.struct(i.alias("start"), (i + width).alias("stop"), _gram(w, i, width).alias("gram")))

    found = told(True).select("rid", "doc", "n_words", F.explode_outer(F.concat(*map(runs, [*short, size]))).alias("run")).select("rid", "doc", "n_words", "run.start", "run.stop", "run.gram")
    found = found.join(few(windows.select("gram", "item")), "gram", "left").select(
        "rid", "doc", "n_words", *(F.when(F.col("item").isNotNull(), F.col(c)).alias(c) for c in ("start", "stop")), "item"
    )
    none = (F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(None).cast(windows.schema["item"].dataType).alias("item"))
    return found.unionByName(told(False).select("rid", "doc", "n_words", *none))


def _named(windows: DataFrame) -> DataFrame:
    return windows.withColumn("item", F.coalesce(F.col("item").cast("string"), F.lit("null")))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 10, max_set: int = MAX_SET) -> DataFrame:
    """One row for each input row: doc, n_words, n_hit, items (sorted strings), spans (maximal hit word ranges).

    Null and empty texts have no words and no hits. A repeated row gives a repeated result. A null
    item id counts as the string "null". Empty tables give no rows, or no hits; other columns are left out.
    """
    windows = item_windows(items, size=size)
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.when(F.col("item").isNotNull(), F.struct("start", "stop")))),
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    rows = hits(docs, _named(windows), doc_id, text, size, max_set)
    return (
        rows.groupBy("rid", "doc", "n_words")
        .agg(merged.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["stop"] - x["start"]))
        .drop("rid")
    )


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hits of every document. A null or empty text has no words and is clean, items without words hit nothing, rows of one id or none are told apart, repeated rows repeat; empty tables give no rows or clean ones."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def clean(docs: DataFrame, items: DataFrame, text: str = "text", size: int = 10, max_set: int = MAX_SET) -> DataFrame:
    """The rows of docs without any benchmark window, with their own columns, whatever their names. What a row is depends on its text alone, so rows go by its digest.

    Null and empty texts hold no window and stay, repeated rows stay or go together.
    """
    digest = F.md5(text_of(text))
    (key,) = spare(docs.columns, "clean_key")
    found = hits(docs.select(digest.alias("doc"), text_of(text).alias("text")), _named(item_windows(items, size=size)), "doc", "text", size, max_set)
    bad = found.filter(F.col("item").isNotNull()).select(F.col("doc").alias(key)).distinct().coalesce(few_files(docs)).checkpoint()
    looked_at = member_filter(docs, digest, bad, key).join(bad, digest == F.col(key), "left_anti")
    return member_filter(docs, digest, bad, key, wanted=False).unionByName(looked_at).coalesce(few_files(docs))
