"""Draws, picks, searches over settings and nested documents against loops."""

import hashlib
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import nested, selection, settings


def test_quotas_hand_on_what_strata_lack(spark):
    r = random.Random(1)
    sizes = {("a", "x"): 50, ("a", "y"): 3, ("a", None): 20, ("b", "x"): 2, ("c", "x"): 9, ("c", "y"): 9, ("c", "z"): 9}
    rows = [(g, s, i) for i, (g, s) in enumerate(x for k, n in sizes.items() for x in [k] * n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, s string, id long").withColumn("extra", F.lit(1))

    def draw(g, s, i):
        return (hashlib.md5(f"5:{g}:{s or ''}:{i}".encode()).hexdigest(), i)

    for n in (1, 7, 10, 200):
        got = {tuple(x)[:3] for x in selection.quotas(df, ["g"], "s", ["id"], n, seed=5).collect()}
        want = set()
        for g in "abc":
            strata = sorted({s for h, s, _ in rows if h == g}, key=lambda s: (s is not None, s))
            share = math.ceil(n / len(strata))
            pools = [sorted((x for x in rows if x[:2] == (g, s)), key=lambda x: draw(*x)) for s in strata]
            chosen = [x for p in pools for x in p[:share]]
            chosen += sorted((x for p in pools for x in p[share:]), key=lambda x: draw(*x))[: max(0, n - len(chosen))]
            want |= set(chosen[:n])
        assert got == want
    assert selection.quotas(df.limit(0), ["g"], "s", ["id"], 5).count() == 0


def test_spaced_picks_are_those_of_a_loop(spark):
    r = random.Random(2)
    rows = [(k, r.randrange(120), round(r.random(), 2), r.random() < 0.3) for k in range(3) for _ in range(200)] + [(7, 5, 0.5, True), (8, None, 0.1, True)]
    given = {0: [60, 61, 200], 1: None, 2: [], 7: None, 8: None}
    df = spark.createDataFrame([(*x, given[x[0]]) for x in rows], "k long, at long, score double, near boolean, start array<long>")
    phases = [selection.Phase("near", F.col("near"), [(F.col("score"), True)], 2), selection.Phase("all", F.lit(True), [(F.col("score"), True)], 4), selection.Phase("draw", F.lit(True), [(selection.drawn(9, "k", "at"), False)], 30)]
    got = {}
    for x in selection.spaced(df, ["k"], "at", 9, phases, "start").collect():
        got.setdefault(x.k, []).append((x.turn, x.at, x.phase))
    for k in (0, 1, 2, 7):
        own = [x for x in rows if x[0] == k]
        chosen = [(p, "given") for p in given[k] or []]
        orders = [("near", 2, sorted((x for x in own if x[3]), key=lambda x: (-x[2], x[1]))), ("all", 4, sorted(own, key=lambda x: (-x[2], x[1]))), ("draw", 30, sorted(own, key=lambda x: hashlib.md5(f"9:{k}:{x[1]}".encode()).hexdigest()))]
        for name, most, order in orders:
            n = 0
            for x in order:
                if n < most and all(abs(x[1] - p) >= 9 for p, _ in chosen):
                    chosen.append((x[1], name))
                    n += 1
        assert [(p, n) for _, p, n in sorted(got[k])] == chosen
    assert 8 not in got


def test_a_grid_is_each_setting_alone(spark):
    r = random.Random(3)
    rows = [(r.choice(["p", "q", None]), r.choice([None, r.random()]), r.random(), r.choice([True, False, None])) for _ in range(400)] + [("only", None, 0.9, True)]
    df = spark.createDataFrame(rows, "fold string, a double, b double, good boolean")
    axes = {"a": [0.2, 0.5, 0.9], "b": [0.1, 0.6]}
    counts = settings.grid_counts(df, ["fold"], F.col("good"), axes)
    got = {(x.fold, x.a, x.b): (x.tp, x.found, x.positives) for x in counts.collect()}
    want = {}
    for fold, a, b in itertools.product(["p", "q", None, "only"], *axes.values()):
        own = [x for x in rows if x[0] == fold]
        through = [x for x in own if x[1] is not None and x[1] >= a and x[2] >= b]
        want[fold, a, b] = (sum(x[3] is True for x in through), len(through), sum(x[3] is True for x in own))
    assert got == want
    objective = [(F.col("tp") >= 10).cast("int"), F.try_divide(F.col("tp"), F.col("found"))]
    for x in settings.chosen_settings(counts, ["fold"], ["a", "b"], objective).collect():
        totals = {s: [sum(v[i] for k, v in want.items() if k[1:] == s and k[0] != x.fold) for i in range(3)] for s in itertools.product(*axes.values())}
        best = min(totals, key=lambda s: (-(totals[s][0] >= 10), -(totals[s][0] / totals[s][1] if totals[s][1] else -1), s))
        assert (x.a, x.b) == best and [x.train_tp, x.train_found, x.train_positives] == totals[best] and (x.tp, x.found, x.positives) == want[(x.fold, *best)]
    with pytest.raises(ValueError):
        settings.grid_counts(df, ["fold"], F.col("good"), {"a": [0.5, 0.2]})


def flat(value, volatile, path="$"):
    if isinstance(value, dict) and value:
        out = {}
        for k, v in value.items():
            p = f"{path}.{k}"
            generic = "".join("[]" if c.startswith("[") else c for c in __import__("re").split(r"(\[\d+\])", p))
            if k not in volatile.keys and not k.endswith(tuple(volatile.suffixes)) and generic not in volatile.paths:
                out |= flat(v, volatile, p)
        return out
    if isinstance(value, list) and value:
        return {k: v for i, x in enumerate(value) for k, v in flat(x, volatile, f"{path}[{i}]").items()}
    if isinstance(value, str):
        for a, b in volatile.texts:
            value = __import__("re").sub(a, b, value)
    return {path: value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))}


DOCS = [
    {"generated_at": "2026", "run_id": "r", "nested": {"made_at": 1, "kept": 1, "uri": "runs/before/a"}, "list": [{"seen_at": "y", "value": 2}, [], {}, [[1, [2, {"deep": None}]]]], "sha": "dead", "drop": {"this": 1}},
    {"list": [{"value": 2, "seen_at": "z"}, [], {}, [[1, [2, {"deep": None}]]]], "sha": "dead", "nested": {"uri": "runs/after/a", "kept": 1}, "run_id": 5, "drop": {"this": 2}},
    {"list": [{"value": 3}, []], "sha": "dead"},
    {"a": True, "b": "true", "c": 1.5, "d": -2, "e": "", "f": "{}"},
    [],
    "text runs/before/x",
    None,
    7,
    {"only_at": 1},
]
VOLATILE = nested.Volatile(keys=("run_id",), suffixes=("_at",), paths=("$.drop.this", "$.list[].none"), texts=(("runs/(before|after)/", "runs/<run>/"),))


def documents(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, None)], "id long, raw string").select("id", F.parse_json("raw").alias("doc"))


def test_leaves_digests_and_differences_of_nested_documents(spark):
    df = documents(spark, DOCS)
    got = {}
    for x in nested.leaves(df, ["id"], "doc", VOLATILE).collect():
        got.setdefault(x.id, {})[x.path] = x.value
    assert got == {i: f for i, d in enumerate(DOCS) if (f := flat(d, VOLATILE))}
    digest = {x.id: (x.leaves, x.digest) for x in nested.digests(df, ["id"], "doc", VOLATILE).collect()}
    assert digest[0] == digest[1] and digest[8] == digest[99] == (0, "0-0") and len({d for _, d in digest.values()}) == len(digest) - 2
    plain = {x.id: x.digest for x in nested.digests(df, ["id"], "doc").collect()}
    assert plain[0] != plain[1]
    other = documents(spark, [DOCS[1], DOCS[1], DOCS[1], {**DOCS[3], "a": "true", "z": 1}])
    found = sorted(tuple(x) for x in nested.differences(df.filter("id < 4"), other, ["id"], "doc", VOLATILE).collect())
    assert [x[:3] for x in found if x[0] == 3] == [(3, "$.a", "both"), (3, "$.z", "right")] and not [x for x in found if x[0] in (0, 1)]
    assert {x[1] for x in found if x[0] == 2} == {"$.list[0].value", "$.list[2]", "$.list[3][0][0]", "$.list[3][0][1][0]", "$.list[3][0][1][1].deep", "$.nested.kept", "$.nested.uri"}
    with pytest.raises(ValueError):
        nested.leaves(df, ["id"], "doc", deepest=2)
    assert nested.leaves(df.limit(0), ["id"], "doc").count() == 0


def test_shallow_documents_take_one_pass_and_deep_ones_are_whole(spark, monkeypatch):
    df = spark.range(3).select("id", F.parse_json(F.concat(F.lit('{"a": {"b": [1, {"c": '), F.col("id").cast("string"), F.lit("}]}}"))).alias("doc"))
    plan = nested.leaves(df, ["id"], "doc")._jdf.queryExecution().toString()
    assert "variant_explode" in plan and "ExistingRDD" not in plan
    whole = sorted(map(tuple, nested.leaves(df, ["id"], "doc").collect()))
    monkeypatch.setattr(nested, "LEVELS", 2)
    assert sorted(map(tuple, nested.leaves(df, ["id"], "doc").collect())) == whole and len(whole) == 6
    assert nested.leaves(df, ["id"], "doc", deepest=5).count() == 6
    with pytest.raises(ValueError):
        nested.leaves(df, ["id"], "doc", deepest=4)


def test_differences_look_only_into_keys_that_differ(spark):
    same, pair = {"a": [1, {"b": "x"}]}, [{"a": 1, "b": 1}, {"a": 2, "b": 2}]
    left = [(None, same), (1, same), (2, same), (3, pair[0]), (3, pair[1]), (4, None), (5, {"z": 1}), (7, {})]
    right = [(None, same), (1, same), (2, {"a": [1, {"b": "y"}]}), (3, pair[0]), (3, pair[1]), (4, None), (6, {"z": 1}), (7, {})]
    a, b = (spark.createDataFrame([(k, d and json.dumps(d)) for k, d in rows], "id long, raw string").select("id", F.parse_json("raw").alias("doc")) for rows in (left, right))
    found = nested.differences(a, b, ["id"], "doc")
    got = sorted(map(str, (tuple(x) for x in found.collect())))
    assert got == sorted(map(str, [(2, "$.a[1].b", "both", "x", "y"), (5, "$.z", "left", "1", None), (6, "$.z", "right", None, "1")] + [(3, f"$.{k}", "both", *v) for k in "ab" for v in (("1", "2"), ("2", "1"))]))
