"""Chat formatting: reply trees to training conversations.

Nodes (tree, node, parent, role, text, score) form trees of replies. Nodes that follow one another in a
tree's order, each the answer to the one before, are taken together as a run. Paths from root to leaf come from
iterative self-joins of runs that double the distance covered each round, so a leaf below n runs takes
log2(n) rounds. Branches are ranked by the mean score of their nodes, and each chosen path is written
as one string. Turns are marked ``### Role: text</turn>`` and control strings inside a text are escaped by
a backslash that ``unescape`` takes away again. The loss mask covers what stands between an assistant's
mark and its end.

Only DataFrame functions run here.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.exchange import release
from sightline.llm.native import lower_ascii, shared_checkpoints, table, text_of

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


#: What stands for a backslash, # and < inside a text. Every backslash of an escaped text starts one of these.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column) -> Column:
    """No mark can stand inside an escaped text, as none of its # and < are left."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def title(role: Column) -> Column:
    """The role with its first letter raised; colons and per cent signs are written %3A and %25, and %_ stands before a letter that was raised already."""
    coded = F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))
    first = F.substring(coded, 1, 1)
    return F.when(first.rlike("[A-Z]"), F.concat(F.lit("%_"), coded)).otherwise(
        F.concat(F.translate(first, string.ascii_lowercase, string.ascii_uppercase), F.substring(coded, F.lit(2), F.char_length(coded)))
    )


def untitle(coded: Column) -> Column:
    first = F.substring(coded, 1, 1)
    plain = F.when(coded.startswith("%_"), F.substring(coded, F.lit(3), F.char_length(coded))).otherwise(F.concat(lower_ascii(first), F.substring(coded, F.lit(2), F.char_length(coded))))
    return unescape(F.replace(F.replace(plain, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%")))


def runs(nodes: DataFrame) -> DataFrame:
    """nodes with run and place: by their order in a tree, nodes that answer the one before them make a run, named by its first node; places count from 1.

    Threads that are numbered as they are read come out as one run, whatever their length. Rows without a node are left out.
    """
    w = Window.partitionBy("tree").orderBy("node")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = nodes.filter(F.col("node").isNotNull()).withColumns({"run": F.when(F.col("parent") == F.lag("node").over(w), None).otherwise(F.col("node")), "place": F.row_number().over(w)})
    first = F.max(F.when(F.col("run").isNotNull(), F.col("place"))).over(so_far)
    return x.withColumns({"run": F.max("run").over(so_far), "place": F.col("place") - first + 1})


def keyed(rows: DataFrame) -> DataFrame:
    """rows with tree as a struct, which is a join key even where the id is null."""
    return rows.withColumn("tree", F.struct("tree"))


def branches(placed: DataFrame) -> DataFrame:
    """(tree, leaf, run, place, distance): for each leaf the runs on its way from the root, up to the place where the way leaves them, and that place's distance from the leaf.

    placed has tree, node, parent, run, place and is read again and again. Each round joins the table of runs 2**k above with
    itself, and the leaves that lie deeper than 2**k runs with it, so the rows are those of the result and a run is carried no
    more often than it is on a path.
    """
    shared_checkpoints(placed.sparkSession)
    up = placed.select("tree", F.col("node").alias("parent"), F.col("run").alias("up"), F.col("place").alias("up_place"))
    # steps lead from the run's first node to the place in up
    links = placed.filter((F.col("place") == 1) & F.col("parent").isNotNull()).join(up, ["tree", "parent"]).select("tree", "run", "up", "up_place", F.lit(1).alias("steps")).checkpoint()
    leaves = placed.groupBy("tree", "run").agg(F.max("node").alias("leaf"), F.max("place").alias("place"))
    leaves = leaves.join(links.select("tree", F.col("up").alias("run"), F.col("up_place").alias("place")), ["tree", "run", "place"], "left_anti")
    above, step, most = [], links, None
    while step.take(1):
        if most is None:
            most = placed.filter(F.col("place") == 1).groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if 2 ** len(above) >= most:  # an ancestor further off than the tree has runs: on a cycle, or hanging from one
            leaves = leaves.join(step, ["tree", "run"], "left_anti")
            break
        above.append(step)
        higher = step.select("tree", F.col("run").alias("up"), F.col("up").alias("up2"), F.col("up_place").alias("place2"), F.col("steps").alias("steps2"))
        step = step.join(higher, ["tree", "up"]).select("tree", "run", F.col("up2").alias("up"), F.col("place2").alias("up_place"), (F.col("steps") + F.col("up_place") - 1 + F.col("steps2")).alias("steps")).checkpoint()
    found = live = leaves.select("tree", "leaf", F.col("run").alias("own"), "run", "place", F.lit(0).alias("distance"))
    for table_ in above:
        deep = live.join(table_.select("tree", F.col("run").alias("own")), ["tree", "own"], "left_semi").checkpoint()
        new = deep.join(table_, ["tree", "run"]).select(
            "tree", "leaf", "own", F.col("up").alias("run"), F.col("up_place").alias("place"), (F.col("distance") + F.col("place") - 1 + F.col("steps")).alias("distance")
        ).checkpoint()
        found = found.unionByName(new)
        live = deep.unionByName(new)
    return found.drop("own")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, distance): a row for each leaf and node on its way from the root, distance counted up from the leaf.

    nodes has tree, node (unique in its tree), parent (null for a root). A parent that isn't there
    makes its children roots; nodes on a cycle, and those that hang from one, are on no path.
    """
    shared_checkpoints(nodes.sparkSession)
    placed = keyed(runs(nodes.select("tree", "node", "parent"))).checkpoint()
    told = branches(placed).withColumnRenamed("place", "last").join(placed, ["tree", "run"]).filter(F.col("place") <= F.col("last"))
    return told.select("tree.tree", "leaf", "node", (F.col("distance") + F.col("last") - F.col("place")).alias("distance"))


def conversations(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, turns array<struct<role, text>>): each root-to-leaf path, ranked by its mean score in its tree.

    best keeps so many branches of a tree; None keeps all. A null score counts as 0, ties go to the smaller leaf.
    Null roles and texts are empty ones. An empty table gives no rows; other columns are left out.

    Texts are gathered by run; only where a run hangs from another node are the runs of a path looked for and joined.
    """
    shared_checkpoints(nodes.sparkSession)
    placed = runs(nodes.select("tree", "node", "parent", text_of("role").alias("role"), text_of("text").alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    out = placed.groupBy("tree", "run").agg(F.max("node").alias("leaf"), F.array_sort(F.collect_list(F.struct("place", "role", "text", "score"))).alias("turns"))
    hanging = placed.filter((F.col("place") == 1) & F.col("parent").isNotNull()).take(1)
    release(nodes.sparkSession)  # the search shuffles the texts, as the result will
    if hanging:
        way = branches(keyed(placed.select("tree", "node", "parent", "run", "place")).checkpoint())
        part = F.struct((-F.col("distance")).alias("at"), F.slice("turns", 1, F.col("place")).alias("turns")).alias("part")
        told = way.join(keyed(out.select("tree", "run", "turns")), ["tree", "run"]).select("tree", "leaf", part)
        out = told.groupBy("tree", "leaf").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["turns"])).alias("turns")).withColumn("tree", F.col("tree.tree"))
    out = out.select(
        "tree",
        "leaf",
        (F.aggregate("turns", F.lit(0.0), lambda acc, x: acc + x["score"]) / F.size("turns")).alias("score"),
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
    )
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("leaf").asc())))
    return out if best is None else out.filter(F.col("rank") <= best)


def formatted(turns: Column) -> Column:
    """The string of an array of struct<role, text>; a null role or text is an empty one."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), title(text_of(x["role"])), F.lit(MIDDLE), escape(text_of(x["text"])), F.lit(CLOSE))), "")


def read_back(text: Column) -> Column:
    """array<struct<role, text, loss_start, loss_stop>> from a formatted string; the loss mask holds code points start..stop for assistants, else nulls."""
    pieces = F.split(text, CLOSE, -1)

    def turn(acc: Column, piece: Column) -> Column:
        cut = F.instr(piece, F.lit(MIDDLE)) - 1
        role = untitle(F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN)))
        body = F.substring(piece, cut + len(MIDDLE) + 1, F.char_length(piece))
        start = acc["at"] + cut + len(MIDDLE)
        stop = acc["at"] + F.char_length(piece)
        assistant = role == "assistant"
        return F.struct(
            (stop + len(CLOSE)).alias("at"),
            F.concat(
                acc["turns"],
                F.array(F.struct(role.alias("role"), unescape(body).alias("text"), F.when(assistant, start).alias("loss_start"), F.when(assistant, stop).alias("loss_stop"))),
            ).alias("turns"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,text:string,loss_start:int,loss_stop:int>>").alias("turns"))
    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), empty, turn)["turns"]


def nodes_of(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees; turns that repeat follow one another."""
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    x = rows.select(F.col("conv_id").alias("tree"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    x = x.withColumn("node", F.row_number().over(w).cast("long"))
    return x.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back. Null roles and texts are empty ones, turns that repeat follow one another; an empty table gives the planted one alone."""
    planted = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = conversations(nodes_of(rows)).select(F.col("tree").alias("conv_id"), formatted(F.col("turns")).alias("out"))
    out = out.withColumn("back", read_back(F.col("out")))
    loss = F.array_join(
        F.transform(
            F.filter("back", lambda x: x["loss_start"].isNotNull()),
            lambda x: unescape(F.substring(F.col("out"), x["loss_start"] + 1, x["loss_stop"] - x["loss_start"])),
        ),
        "",
    )
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("out").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS x(t)),
e AS (SELECT *, '### ' || upper(left(role, 1)) || substr(role, 2) || ': ' || replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') || '</turn>' || chr(10) AS f FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
