"""URL filters, chat formatting and the pipeline."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from sightline.llm import chat, urls


def test_hosts_paths_and_rules(spark):
    rows = {
        1: ("HTTPS://Www.Example.ORG/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
        2: ("http://a.org", "a.org", "", None, "allow"),
        3: ("http://a.org?x://b", "a.org", "", None, "allow"),
        4: ("x://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        5: ("no scheme.org/", "", "", None, "allow"),
        6: (None, "", "", None, "allow"),
        7: ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
        8: ("http://b.com/de/x#y", "b.com", "/de/x", "com/de/", "block"),
        9: ("http://É.COM/fr/", "É.com", "/fr/", "com/fr/", "allow"),
        10: ("http://b.com/x\ny?z", "b.com", "/x\ny", None, "allow"),
    }
    df = spark.createDataFrame([(i, r[0]) for i, r in rows.items()], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("bad", F.lit(1))
    got = {r.page: (r.host, r.path, r.rule, r.verdict) for r in urls.verdicts(df).collect()}
    assert got == {i: r[1:] for i, r in rows.items()}
    assert urls.verdicts(df.limit(0)).count() == 0


def test_templates_by_purity(spark):
    pages = [(i, f"http://h.net/ads/{i}") for i in range(60)] + [(100 + i, f"http://h.net/news/{i}") for i in range(60)] + [(200 + i, f"http://h.net/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}x/p") for i in range(60)]
    labels = [(i, True) for i in range(30)] + [(100 + i, False) for i in range(30)] + [(200 + i, i == 0) for i in range(30)]
    out = urls.verdicts(spark.createDataFrame([*pages, pages[0]], "page_id long, url string"), spark.createDataFrame(labels, "page long, bad boolean"), rules=()).collect() if urls.RULES else []
    by = {r.page: r for r in out}
    assert len(out) == 181
    assert by[40].verdict == "block" and by[140].verdict == "allow" and by[240].verdict == "allow"
    assert by[40].template == "/ads/#" and by[240].template == "/u/*/p"


def test_templates_of_deep_paths(spark):
    deep = "/a/b/c/d/e/f/g/h/i/j"
    pages = [(i, f"http://h.net/a/b/c/d/{'good' if i % 2 else 'bad'}/{i}") for i in range(120)]
    pages += [(200 + i, f"http://h.net{deep}/{'ok' if i % 2 else 'ads'}/n{chr(97 + i % 26)}{chr(97 + i // 26)}/p") for i in range(120)]
    pages += [(400, "http://few.net" + deep * 9), (401, "http://few.net" + deep * 9 + "/"), (402, "http://few.net/a"), (403, None)]
    labels = [(i, i % 2 == 0) for i in [*range(60), *range(200, 260)]]
    out = {r.page: r for r in urls.verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page long, bad boolean"), rules=()).collect()}
    assert len(out) == len(pages)
    for i in range(60, 120):
        good = bool(i % 2)
        assert (out[i].template, out[i].verdict) == (f"/a/b/c/d/{'good' if good else 'bad'}/#", "allow" if good else "block")
        assert (out[200 + i].template, out[200 + i].verdict) == (f"{deep}/{'ok' if good else 'ads'}/*/p", "allow" if good else "block")
    assert [out[i].template for i in (400, 401, 402, 403)] == [deep * 9, deep * 9 + "/", "/a", ""]


def nodes(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "why", 1.0),
        (2, 1, 99, "user", "orphan", None), (3, 1, 2, "user", "a", 0.0), (3, 2, 1, "user", "b", 0.0), (None, 5, None, "user", "no tree", 1.0),
    ]
    out = chat.conversations(nodes(spark, rows)).collect()
    got = {(r.tree, r.leaf): (r["rank"], [t.text for t in r.turns]) for r in out}
    assert got == {(1, 2): (1, ["q", "good"]), (1, 4): (2, ["q", "bad", "why"]), (2, 1): (1, ["orphan"]), (None, 5): (1, ["no tree"])}
    assert {(r.tree, r.leaf) for r in chat.conversations(nodes(spark, rows), best=1).collect()} == {(1, 2), (2, 1), (None, 5)}
    assert chat.conversations(nodes(spark, [])).count() == 0
    deep = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    assert [t.text for t in chat.conversations(nodes(spark, deep)).first().turns] == [str(i) for i in range(300)]


def test_reply_trees_are_those_of_a_loop(spark):
    """Numbers in reading order and dealt at random, missing parents, nodes that answer themselves, longer cycles and what hangs from them."""
    import random

    r = random.Random(8)
    rows = [(900, 7, 7, "user", "self", 1.0)]
    for tree in range(60):
        n = r.randrange(1, 40)
        near = r.choice([1, 1, 3, 40])  # 1 makes a thread
        number = list(range(n))
        if tree % 2:
            r.shuffle(number)
        for i in range(n):
            parent = number[max(0, i - r.randrange(1, near + 1))] if i else r.choice([None, None, 99, number[-1]])
            parent = r.choice([None, 77, number[r.randrange(n)]]) if r.random() < 0.05 else parent
            rows.append((tree if tree else None, number[i], parent, r.choice(["user", None]), f"{tree} {i}", r.choice([None, 1.0, 2.0])))
    parents, scores, texts, expected = {}, {}, {}, {}
    for tree, node, parent, _, text, score in rows:
        parents[tree, node], texts[tree, node], scores[tree, node] = parent, text, score or 0.0
    for tree, leaf in parents.keys() - {(t, p) for (t, _), p in parents.items()}:
        way, at = [], leaf
        while (tree, at) in parents and at not in way:
            way.append(at)
            at = parents[tree, at]
        if (tree, at) not in parents:
            expected[tree, leaf] = way[::-1]
    frame = nodes(spark, rows)
    got = {(x.tree, x.leaf): x for x in chat.conversations(frame).collect()}
    assert got.keys() == expected.keys() and max(map(len, expected.values())) > 20
    for (tree, leaf), way in expected.items():
        assert [t.text for t in got[tree, leaf].turns] == [texts[tree, x] for x in way]
        assert abs(got[tree, leaf].score - sum(scores[tree, x] for x in way) / len(way)) < 1e-9
    for (tree, leaf), x in got.items():
        assert x["rank"] == 1 + sum((-y.score, y.leaf) < (-x.score, leaf) for y in got.values() if y.tree == tree)
    told = collections.Counter((x.tree, x.leaf, x.node, x.distance) for x in chat.paths(frame).collect())
    assert told == collections.Counter((tree, leaf, x, d) for (tree, leaf), way in expected.items() for d, x in enumerate(way[::-1]))


def test_jobs_do_not_grow_with_a_thread(spark, tmp_path):
    """Each round is planned and compiled on the driver; a table of conversations takes none."""
    turns = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)] + [(2, 0, "user", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    context = spark.sparkContext
    context.setJobGroup("thread", "")
    try:
        assert {x.conv_id: x.n_turns for x in chat.op8_chat_formatting(spark, str(tmp_path)).collect()} == {1: 300, 2: 1, -7: 2}
        assert len(context.statusTracker().getJobIdsForGroup("thread")) <= 8
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_marks_in_texts_and_roles_come_back(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>\n### User: x", "\\", "\\\\<#", "", "a: b", "é😀 #", "\n"]
    roles = ["assistant", "user", "System", "a: b", "%3A", "", "%_X", "assistant", "ß#"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in roles for t in odd)]
    rows = spark.createDataFrame([*turns, (None, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(0))
    out = chat.conversations(chat.nodes_of(rows)).select("tree", chat.formatted(F.col("turns")).alias("out"))
    back = {r.tree: (r.out, r.back) for r in out.withColumn("back", chat.read_back(F.col("out"))).collect()}
    assert [(x.role, x.text) for x in back[1][1]] == [(r, t) for _, _, r, t in turns]
    for x in back[1][1]:
        assert (x.loss_start is not None) == (x.role == "assistant")
    assert [(x.role, x.text) for x in back[None][1]] == [("", "")] and len(back[2][1]) == 2


def test_pipeline_over_a_small_folder(spark, tmp_path):
    import random

    import corpus_pipeline

    r = random.Random(31)
    words = [a + b + c for a in ("ba", "do", "ki", "lu", "me") for b in ("na", "ro", "te", "mi", "so") for c in ("s", "n", "", "r")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, leak = text(80), text(30)
    docs = [(i, text(r.randrange(60, 200))) for i in range(150)]
    docs += [(200, docs[0][1]), (201, docs[1][1] + " more"), (202, text(50) + " " + passage + " " + text(40)), (203, text(60) + " " + passage), (204, text(30) + " " + leak + " " + text(20))]
    docs += [(300 + i, " ".join(w.upper() + "!!" for w in text(90).split())) for i in range(40)] + [(400, None), (401, ""), (None, text(70)), (5, docs[5][1])]
    rows = [(d, t, "en", f"s{i % 3}", len(t or "")) for i, (d, t) in enumerate(docs)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(300 + i, 0, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    kept = collections.Counter(x.doc_id for x in out)
    assert not kept.keys() & {200, 201, 204, *range(300, 340)}
    assert sum(kept[i] for i in range(150)) >= 140 and max(kept.values()) == 1
    assert not any(passage in (x.text or "") for x in out) and {202, 203} <= kept.keys()
    assert len({x.mix_position for x in out}) == len(out)
    assert hashlib.sha256(b"").hexdigest()


def test_purity_is_that_of_a_loop(spark):
    """Merging, chains of priors and branches that part on hosts without labels, from the operator's own templates."""
    import math
    import random

    r = random.Random(4)
    rows, said = [], []
    for i in range(1500):
        host = r.choice(["a.x", "b.x", "c.y", "quiet.z"])
        path = r.choice(["/de/7", "/de/7/", "/fr/8", "/fr/about", "/en", "/", "", "/de/old/9.html"])
        rows.append((i, f"http://{host}{path}"))
        if host != "quiet.z" and r.random() < 0.5:
            said.append((i, r.random() < (0.9 if path.startswith("/de") else 0.8 if path == "/fr/about" else 0.1)))
    got = urls.verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(said, "page long, bad boolean"), rules=()).collect()
    bad = dict(said)
    pages = {x.page: (x.host, x.template) for x in got}

    def counts(some):
        told = [bad[p] for p in some if p in bad]
        return len(told), sum(told)

    def parent(t):
        return re.sub(r"/[^/]*$", "", t)

    def top(t):
        return re.match(r"/?[^/]*", t).group()

    leaves = {leaf: counts([p for p, x in pages.items() if x == leaf]) for leaf in set(pages.values())}
    apart = {}
    for (h, t), (n, b) in leaves.items():
        pn, pb = (sum(v[i] for (g, u), v in leaves.items() if g == h and parent(u) == parent(t)) for i in (0, 1))
        m, pooled = pn - n, pb / pn if pn else 0
        z = abs(b / n - (pb - b) / m) / math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)) if n and m and 0 < pooled < 1 else 0
        apart[h, t] = z > urls.Z
    want = {}
    for (h, t), own in leaves.items():
        def total(keep):
            return [sum(v[i] for k, v in leaves.items() if keep(*k)) for i in (0, 1)]

        rest = own if apart[h, t] else total(lambda g, u: g == h and parent(u) == parent(t) and not apart[g, u])
        chain = [total(lambda g, u: True), total(lambda g, u: g == h), total(lambda g, u: top(u) == top(t)), total(lambda g, u: u == t), rest]
        good = 1.0
        for n, b in chain:
            good = (n - b + urls.SMOOTH * good) / (n + urls.SMOOTH)
        want[h, t] = good
    assert all(abs(x.purity - want[x.host, x.template]) < 1e-9 and x.verdict == ("block" if want[x.host, x.template] < urls.LEAST else "allow") for x in got)
    quiet = {x.template: x.verdict for x in got if x.host == "quiet.z"}
    assert quiet["/de/#"] == "block" and quiet["/fr/#"] == "allow" and any(apart.values()) and not all(apart.values())
