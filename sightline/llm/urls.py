"""URL filters: rules first, then a path-template tree for each host.

Tree. A path's segments become a template: runs of digits turn into #, long hexadecimal segments into *,
and at each level a position under one (host, prefix) that takes more than FAN values turns into *.
Paths of any length are followed to their end; a prefix with at most FAN paths can't have such a position
further down, so its paths leave the loop as they are.
Each template counts pages and labelled good and bad pages; sibling templates whose bad share doesn't
differ from their siblings' by a two-proportion z-test are merged into one branch. A branch's purity is
its share of good pages, smoothed towards that of the same template on all hosts, which is smoothed towards that of all templates that begin with the same
segment, that towards the host's and that towards the share of all pages. So branches of a host without labelled pages part by what like templates of other hosts
hold. Templates of branches below LEAST purity are rejected.

Statistics are grouped before anything is joined, so a host with most of the pages costs one row for each of
its templates, not one for each page.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.native import lower_ascii, shared_checkpoints, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FAN = 24
SMOOTH = 8.0
LEAST = 0.5
Z = 1.96


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. A rule fits its host and its subdomains."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _segments(path: Column) -> Column:
    """Digits and long hexadecimal runs generalised."""
    return F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("*")).otherwise(F.regexp_replace(s, r"\d+", "#")))


def templates(pages: DataFrame) -> DataFrame:
    """pages with host, path and template. Levels are generalised from the host down over grouped templates."""
    x = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("segments", _segments(F.col("path")))
    shared_checkpoints(pages.sparkSession)
    tree = x.select("host", "segments").distinct().withColumn("shape", F.array().cast("array<string>"))
    done = []
    for level in count():
        tree = tree.checkpoint()  # each level reads the one before twice
        if level:
            done.append(tree.filter(~F.col("open")))
            tree = tree.filter("open")
            if tree.isEmpty():
                break
        at = F.get("segments", F.lit(level))
        wide = tree.groupBy("host", "shape").agg((F.count("*") > FAN).alias("many"), (F.approx_count_distinct(at, 0.02) > FAN).alias("wide"))
        rest = F.slice("segments", level + 1, F.size("segments"))
        tree = tree.join(wide, ["host", "shape"]).select(
            "host", "segments", F.concat("shape", F.when(F.col("many"), F.array(F.when(F.col("wide"), "*").otherwise(at))).otherwise(rest)).alias("shape"),
            (F.col("many") & (F.size("segments") > level + 1)).alias("open"),
        )
    tree = reduce(DataFrame.unionByName, done).select("host", "segments", F.array_join("shape", "/").alias("template")).checkpoint()
    return x.join(tree, ["host", "segments"], "left").drop("segments")


def verdicts(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page, host, path, rule, verdict, template, purity), one row for each input row.

    labels has page, bad (boolean); a page is bad if any of its rows says so, and a null says nothing. A null
    url, or one without ://, has an empty host and path and goes by its labels as any other. Without any label
    nothing is rejected. An empty table gives no rows, repeated rows give repeated results and count as often.
    Other columns of pages are left out. A url may be of any length.
    """
    x = templates(pages.select(F.col(page_id).alias("page"), F.col(url).alias("url")))
    if labels is None:
        labels = x.select("page", F.lit(None).cast("boolean").alias("bad")).limit(0)
    labels = labels.groupBy("page").agg(F.max("bad").alias("bad"))
    known = x.join(labels, "page", "left")
    bad = F.sum(F.when(F.col("bad"), 1).otherwise(0))
    leaves = known.groupBy("host", "template").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), bad.alias("bad"))
    leaves = leaves.withColumn("parent", F.regexp_replace("template", r"/[^/]*$", "")).checkpoint()
    near = leaves.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("bad").alias("pbad"))
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("bad").alias("hbad"))
    every = leaves.agg(F.sum("n").alias("an"), F.sum("bad").alias("abad"))
    leaves = leaves.withColumn("top", F.regexp_extract("template", "^/?[^/]*", 0))
    same = leaves.groupBy("template").agg(F.sum("n").alias("sn"), F.sum("bad").alias("sbad"))
    tops = leaves.groupBy("top").agg(F.sum("n").alias("tn"), F.sum("bad").alias("tbad"))
    x_n, x_bad = F.col("pn") - F.col("n"), F.col("pbad") - F.col("bad")
    pooled = F.try_divide(F.col("pbad"), F.col("pn"))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), x_n)))
    z = F.try_divide(F.abs(F.try_divide(F.col("bad"), F.col("n")) - F.try_divide(x_bad, x_n)), spread)
    apart = (F.col("n") > 0) & (x_n > 0) & (pooled > 0) & (pooled < 1) & (z > Z)
    tree = leaves.join(near, ["host", "parent"]).join(hosts, "host").join(same, "template").join(tops, "top").join(F.broadcast(every))  # every is one row
    tree = tree.withColumn("apart", F.coalesce(apart, F.lit(False))).checkpoint()
    rest = tree.filter(~F.col("apart")).groupBy("host", "parent").agg(F.sum("n").alias("rn"), F.sum("bad").alias("rbad"))
    tree = tree.join(rest, ["host", "parent"], "left")
    n = F.when(F.col("apart"), F.col("n")).otherwise(F.col("rn"))
    b = F.when(F.col("apart"), F.col("bad")).otherwise(F.col("rbad"))
    overall = (F.coalesce("an", F.lit(0)) - F.coalesce("abad", F.lit(0)) + SMOOTH) / (F.coalesce("an", F.lit(0)) + SMOOTH)
    prior = overall
    for many, wrong in ((F.col("hn"), F.col("hbad")), (F.col("tn"), F.col("tbad")), (F.col("sn"), F.col("sbad")), (n, b)):
        prior = (many - wrong + SMOOTH * prior) / (many + SMOOTH)
    tree = tree.select("host", "template", prior.alias("purity"))
    x = x.join(tree, ["host", "template"], "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return x.select(
        "page", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") < LEAST, "block").otherwise("allow")).alias("verdict"), "template", "purity",
    )


def rule_labels(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page, bad): what the rules say of the pages that they fit."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    return pages.select(F.col(page_id).alias("page"), rule_of(host, path, rules)["verdict"].alias("verdict")).filter("verdict is not null").select("page", (F.col("verdict") == "block").alias("bad"))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Pages have no labels of their own, so the tree learns from the verdicts of the rules: pages that a rule fits are its labelled pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return verdicts(pages, rule_labels(pages)).withColumnRenamed("page", "page_id")
