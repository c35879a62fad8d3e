"""Document fingerprints: a Merkle tree over the sections, paragraphs and word runs of a text.

The root is a SHA-256 over the section digests, which are SHA-256 over the paragraph digests, which
are SHA-256 over the paragraph's characters. Splitting on fixed strings can be undone, so two texts
have the same root when they are the same text. The fingerprint is the root followed by the
smallest 64 leaf digests, the leaves being runs of three words counted from each paragraph's start.
Two trees are alike to the degree that their leaves are: twice the leaves that both hold by the leaves of each, over all
leaves, so an edit counts wherever it lies. op2_document_branches also returns the branches that differ.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.native import spare, table, text_of

LEAVES = 64
RUN = 3
SECTION, PARAGRAPH = "\n\n", "\n"


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def paragraph_digests(text: Column) -> Column:
    """array (sections) of array (paragraphs) of hex digests."""
    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), _sha))


def section_digests(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: _sha(F.array_join(s, "")))


def root_of(sections: Column) -> Column:
    return _sha(F.array_join(sections, ""))


def _runs(paragraph: Column) -> Column:
    words = F.array_remove(F.split(paragraph, " "), "")
    return F.flatten(
        F.transform(
            F.array(words),
            lambda w: F.transform(
                F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>")),
                lambda i: F.substring(F.md5(F.array_join(F.slice(w, i + 1, RUN), " ")), 1, 12),
            ),
        )
    )


def all_leaves_of(text: Column) -> Column:
    """The distinct leaf digests."""
    return F.array_distinct(F.flatten(F.transform(F.split(text, PARAGRAPH), _runs)))


def smallest(leaves: Column) -> Column:
    """The smallest LEAVES of some leaf digests, sorted."""
    return F.slice(F.array_sort(leaves), 1, LEAVES)


def _print(root: Column, leaves: Column) -> Column:
    return F.concat(root, F.lit(":"), F.array_join(smallest(leaves), ","))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, root, sections, paragraphs, fingerprint), one row for each input row; a null text is empty, an empty table gives no rows, other columns are left out."""
    x = docs.select(F.col(doc_id).alias("doc"), text_of(text).alias("t"))
    x = x.withColumn("paragraphs", paragraph_digests(F.col("t")))
    x = x.withColumn("sections", section_digests(F.col("paragraphs")))
    x = x.withColumn("root", root_of(F.col("sections")))
    return x.select(
        "doc", F.char_length("t").cast("long").alias("n_chars"), "root", "sections", "paragraphs",
        _print(F.col("root"), all_leaves_of(F.col("t"))).alias("fingerprint"),
    )


def locate_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, section, paragraph): the branches that differ between two outputs of fingerprint(), both counted from 0.

    Equal roots are not descended into. A document on one side only gives no row.
    """
    a = before.select("doc", F.col("root").alias("ra"), F.col("sections").alias("sa"), F.col("paragraphs").alias("pa"))
    b = after.select("doc", F.col("root").alias("rb"), F.col("sections").alias("sb"), F.col("paragraphs").alias("pb"))
    sections = a.join(b, "doc").filter(F.col("ra") != F.col("rb")).select("doc", F.posexplode(F.arrays_zip("sa", "sb", "pa", "pb")).alias("section", "x"))
    changed = sections.filter(~F.col("x.sa").eqNullSafe(F.col("x.sb")))
    paragraphs = changed.select("doc", "section", F.posexplode(F.arrays_zip(F.col("x.pa").alias("a"), F.col("x.pb").alias("b"))).alias("paragraph", "y"))
    return paragraphs.filter(~F.col("y.a").eqNullSafe(F.col("y.b"))).select("doc", "section", "paragraph")


def with_tree(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with <name>_paragraphs, _sections, _root and _leaves (all of them) of a text column."""
    x = rows.withColumn(f"{name}_paragraphs", paragraph_digests(F.col(text))).withColumn(f"{name}_leaves", all_leaves_of(F.col(text)))
    return x.withColumn(f"{name}_sections", section_digests(F.col(f"{name}_paragraphs"))).withColumn(f"{name}_root", root_of(F.col(f"{name}_sections")))


def whole_likeness(a: str, b: str) -> Column:
    """Twice the leaves that both trees hold by the leaves of each, 1 for equal roots."""
    common, both = F.size(F.array_intersect(f"{a}_leaves", f"{b}_leaves")), F.size(f"{a}_leaves") + F.size(f"{b}_leaves")
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), 1.0).when(both == 0, 0.0).otherwise(2.0 * common / both)


def differing(a: str, b: str) -> Column:
    """array of (section, paragraph), counted from 0: the branches that differ between two trees. Equal roots and sections are not descended into."""

    def pairs(x: Column, y: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)

    def section(i: Column) -> Column:
        x, y = F.get(f"{a}_paragraphs", i), F.get(f"{b}_paragraphs", i)
        apart = F.filter(pairs(x, y), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
        return F.transform(apart, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    sections = F.filter(pairs(F.col(f"{a}_sections"), F.col(f"{b}_sections")), lambda i: ~F.get(f"{a}_sections", i).eqNullSafe(F.get(f"{b}_sections", i)))
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), none).otherwise(F.flatten(F.transform(sections, section)))


def _bucket_of(at: Column, splits: list) -> Column:
    """How many splits lie below at, by halving; the plan holds one array, however many splits there are."""
    if not splits:
        return F.lit(0)
    known = F.lit(splits)

    def halve(x: Column, _: Column) -> Column:
        middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
        below = F.get(known, middle) < at
        return F.struct(F.when((x["low"] < x["high"]) & below, middle + 1).otherwise(x["low"]).alias("low"), F.when((x["low"] < x["high"]) & ~below, middle).otherwise(x["high"]).alias("high"))

    first = F.struct(F.lit(0).alias("low"), F.lit(len(splits)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(splits).bit_length())), first, halve)["low"]


def with_next(rows: DataFrame, key: str, buckets: int, *carried: str) -> DataFrame:
    """Each row with next_<c> for the row that follows it in descending key order, the first following the last.

    Ties go by the first carried column, nulls come last. The order is dealt over buckets whose
    splitters are sampled quantiles; the first row of each bucket is also put at the end of the bucket
    before it, so no task sees more than its own range. Other columns stay, whatever their names.
    """
    at, bucket, top, back, last, ghost, to = spare([*rows.columns, *(f"next_{c}" for c in carried)], "at", "bucket", "top", "back", "last", "ghost", "to")
    x = rows.withColumn(at, F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    splits = sorted(set(x.agg(F.percentile_approx(at, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or [])) if buckets > 1 else []
    x = x.withColumn(bucket, _bucket_of(F.col(at), splits).cast("int"))
    tops = sorted((tuple(r) for r in x.groupBy(bucket).agg(F.max(at)).collect()), reverse=True)
    before = [(b, t, tops[i - 1][0], int(i == 0)) for i, (b, t) in enumerate(tops)]
    before = rows.sparkSession.createDataFrame(before, f"{bucket} int, {top} long, {back} int, {last} int")
    x = x.join(F.broadcast(before), bucket)  # at most a row for each shuffle partition
    copies = F.when(F.col(at) == F.col(top), F.array(F.struct(F.col(bucket).alias("b"), F.lit(0).alias("ghost")), F.struct(F.col(back).alias("b"), (F.col(last) + 1).alias("ghost"))))
    x = x.withColumn(to, F.explode(F.coalesce(copies, F.array(F.struct(F.col(bucket).alias("b"), F.lit(0).alias("ghost"))))))
    x = x.withColumn(ghost, F.col(f"{to}.ghost")).withColumn(to, F.col(f"{to}.b"))
    w = Window.partitionBy(to).orderBy((F.col(ghost) == 2).asc(), F.col(at).desc(), *(F.col(c).asc() for c in carried[:1]), F.col(ghost).asc())
    x = x.select(*rows.columns, ghost, *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return x.filter(F.col(ghost) == 0).drop(ghost)


def _compared(spark, sf_dir: str) -> DataFrame:
    """doc_id, t, next_t, edited and the trees own_, edited_ and next_ of the three texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("t"))
    x = with_next(docs, "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")), "t")
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    x = x.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next_t"), F.lit(1), half)))
    for text, name in (("t", "own"), ("edited", "edited"), ("next_t", "next")):
        x = with_tree(x, text, name)
    return x


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and the likeness of their whole trees. A null text is empty; rows of one id follow one another by text, null ids come last."""
    x = _compared(spark, sf_dir)
    return x.select(
        "doc_id", F.char_length("t").cast("long").alias("n_chars"), _sha(F.col("edited")).alias("edited_sha256"),
        *(_print(F.col(f"{name}_root"), F.col(f"{name}_leaves")).alias(c) for name, c in (("own", "fingerprint"), ("edited", "edited_fingerprint"))),
        whole_likeness("own", "edited").alias("near_edited"), whole_likeness("own", "next").alias("near_next"),
    )


def op2_document_branches(spark, sf_dir: str) -> DataFrame:
    """The texts of op2_document_fingerprints with the branches of their trees that differ."""
    x = _compared(spark, sf_dir)
    return x.select(
        "doc_id", whole_likeness("own", "edited").alias("near_edited"), differing("own", "edited").alias("edited_branches"),
        whole_likeness("own", "next").alias("near_next"), differing("own", "next").alias("next_branches"),
    )


def _oracle() -> str:
    def leaves(t: str) -> str:
        words = "list_filter(string_split(p, ' '), lambda q: q <> '')"
        return f"list_distinct(flatten(list_transform(string_split({t}, chr(10)), lambda p: list_transform(range(0, len({words}), {RUN}), lambda i: left(md5(array_to_string({words}[i + 1 : i + {RUN}], ' ')), 12)))))"

    def fp(t: str, all_of: str) -> str:
        root = f"sha256(array_to_string(list_transform(string_split({t}, chr(10) || chr(10)), lambda s: sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), ''))"
        return f"{root} || ':' || array_to_string(list_sort({all_of})[1:{LEAVES}], ',')"

    def near(t: str, all_of: str) -> str:
        both = f"(len(l0) + len({all_of}))"
        return f"CASE WHEN t = {t} THEN 1.0 WHEN {both} = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(l0, {all_of})) / {both} END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT *, length(t) AS nc, left(t, CAST(length(t) - length(t) // 2 AS INTEGER)) || left(nt, CAST(length(t) // 2 AS INTEGER)) AS et FROM n),
l AS (SELECT *, {leaves("t")} AS l0, {leaves("et")} AS l1, {leaves("nt")} AS l2 FROM e)
SELECT doc_id, CAST(nc AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, {fp("t", "l0")} AS fingerprint, {fp("et", "l1")} AS edited_fingerprint,
       CAST({near("et", "l1")} AS DOUBLE) AS near_edited, CAST({near("nt", "l2")} AS DOUBLE) AS near_next
FROM l"""


ORACLE = _oracle()
