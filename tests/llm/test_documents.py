"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import components, decontaminate, fingerprint, jaccard, licenses, lm, mixing, quality, scan, suffix
from sightline.llm.exchange import unpack

WORDS = ["alpha", "beta", "gamma", "delta", "Émile", "straße", "x", "of", "the", "9"]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("doc", "tag", "spans", "rid", "item", "block", "n", "label", "score", "a", "b", "h", "seed", "kind"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def corpus(seed=1, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            words = (r.choice(out)[1] or "").split()
            for _ in range(r.randrange(4)):
                words.insert(r.randrange(len(words) + 1), r.choice(WORDS))
            out.append((i, " ".join(words)))
        else:
            out.append((i, r.choice(["\n", " "]).join(r.choice(WORDS) + r.choice(["", "", ",", "!"]) for _ in range(r.randrange(0, 120)))))
    return [*out, (1000, None), (1001, ""), (1002, out[3][1]), (1002, out[3][1]), (1003, "word " * 3000), (1004, "a" * 5000), (1005, "one two")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def visible(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def test_words_and_hashes():
    import pyarrow as pa

    texts = [t for _, t in corpus()]
    data, offsets = scan.buffers(pa.array(texts, pa.string()))
    for keep, brute in ((scan.VISIBLE, visible), (scan.ALNUM, alnum)):
        start, stop, first = scan.words(data, offsets, keep)
        raw = data.tobytes()
        for i, t in enumerate(texts):
            found = [lower(raw[start[j] : stop[j]].decode()) for j in range(first[i], first[i + 1])]
            assert found == brute(t)
    p = scan.prefix(data, scan.BYTES[scan.LOWER])
    h = scan.span_hash(p, start, stop)
    by = collections.defaultdict(set)
    for a, b, x in zip(start, stop, h):
        by[lower(raw[a:b].decode())].add(int(x))
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_fingerprints(spark):
    rows = corpus()
    fp = {(r.doc, r.fingerprint) for r in fingerprint.fingerprint(frame(spark, rows)).collect()}
    by = collections.defaultdict(set)
    text = collections.defaultdict(set)
    for d, t in rows:
        text[d].add(t or "")
    for d, f in fp:
        by[f] |= text[d]
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({t or "" for _, t in rows})
    before = fingerprint.fingerprint(frame(spark, [(1, "a\nb\n\nc\nd"), (2, "same")]))
    after = fingerprint.fingerprint(frame(spark, [(1, "a\nb\n\nc\nX"), (2, "same")]))
    assert [tuple(r) for r in fingerprint.locate_edits(before, after).collect()] == [(1, 1, 1)]
    assert fingerprint.fingerprint(frame(spark, [])).count() == 0


def test_whole_trees_tell_every_edit(spark, tmp_path):
    from sightline.llm import queries

    words = [f"w{i}" for i in range(3000)]
    text = lambda w: "\n\n".join("\n".join(" ".join(w[i : i + 30]) for i in range(s, s + 300, 30)) for s in range(0, 3000, 300))
    leaves = lambda t: {tuple(p.split()[i : i + 3]) for p in t.split("\n") for i in range(0, len(p.split()), 3)}
    texts = {2: text(words), 1: text([*words[:1234], "other", *words[1235:]]), 0: "a\n\nb"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.queries()["op2_document_branches"](spark, str(tmp_path)).collect()}
    for d, e in ((2, 1), (1, 0), (0, 2)):
        half = len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - half] + texts[e][:half]
        for other, near, branches in ((texts[e], got[d].near_next, got[d].next_branches), (edited, got[d].near_edited, got[d].edited_branches)):
            a, b = leaves(texts[d]), leaves(other)
            assert abs(near - 2 * len(a & b) / (len(a) + len(b))) < 1e-12
            x, y = ([s.split("\n") for s in t.split("\n\n")] for t in (texts[d], other))
            at = lambda t, i, j: t[i][j] if i < len(t) and j < len(t[i]) else None
            assert [tuple(r) for r in branches] == [(i, j) for i in range(40) for j in range(400) if at(x, i, j) != at(y, i, j)]
    assert got[2].near_next == 0.999 and [tuple(r) for r in got[2].next_branches] == [(4, 1)]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_next_document(spark, buckets):
    rows = [(7, "g"), (3, "c"), (3, "b"), (None, "n"), (9, "i"), (5, "e"), (1, "a")]
    got = {r.t: r.next_t for r in fingerprint.with_next(frame(spark, rows, False).withColumnRenamed("text", "t"), "doc_id", buckets, "t").collect()}
    order = ["i", "g", "e", "b", "c", "a", "n"]
    assert got == dict(zip(order, order[1:] + order[:1]))
    one = frame(spark, [(4, "x")], False).withColumnRenamed("text", "t")
    assert fingerprint.with_next(one, "doc_id", buckets, "t").first().next_t == "x"
    assert fingerprint.with_next(one.limit(0), "doc_id", buckets, "t").count() == 0


def test_suffix_dedup(spark):
    r = random.Random(5)
    shared = "".join(r.choice("abé\n ") for _ in range(700))
    rows = corpus(3) + [(2000 + i, "".join(r.choice("xyzü") for _ in range(50)) + shared[i * 31 : i * 31 + 230] + str(i)) for i in range(12)] + [(None, shared), (2100, "ab" * 400)]
    out = suffix.dedup(frame(spark, rows)).collect()
    counts = collections.Counter()
    raw = [((d, (t or "").encode())) for d, t in rows]
    for _, t in raw:
        counts.update(t[i : i + suffix.SIZE] for i in range(len(t) - suffix.SIZE + 1))
    want = collections.Counter()
    for d, t in raw:
        covered = [False] * len(t)
        for i in range(len(t) - suffix.SIZE + 1):
            if counts[t[i : i + suffix.SIZE]] > 1:
                covered[i : i + suffix.SIZE] = [True] * suffix.SIZE
        spans, at = [], 0
        for hit, run in itertools.groupby(covered):
            n = len(list(run))
            if hit:
                spans.append((at, at + n))
            at += n
        want[(d, len(t), tuple(spans), hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest())] += 1
    got = collections.Counter((x.doc, x.n_bytes, tuple((s.start, s.stop) for s in x.spans), x.kept_sha256) for x in out)
    assert got == want
    for hot in (1, 3):
        parts = suffix.dedup(frame(spark, rows, False), hot=hot).collect()
        assert collections.Counter((x.doc, x.n_bytes, tuple((s.start, s.stop) for s in x.spans), x.kept_sha256) for x in parts) == want
    cut = suffix.without_repeats(frame(spark, rows).withColumn("n_chars", F.lit(5).cast("long")))
    assert collections.Counter((x.doc_id, len(x.text or "")) for x in cut.collect()) == collections.Counter((x.doc, len(x.kept)) for x in out)
    assert suffix.dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_suffix_dedup_tells_texts_without_an_id_apart(spark, key):
    r = random.Random(41)
    passages = ["".join(r.choice("abcdé ") for _ in range(240)) for _ in range(40)]
    text = lambda n: "".join(r.choice("uvwxyz") for _ in range(n))
    texts = [text(r.randrange(0, 90)) + passages[i % 40][r.randrange(9) :] + text(r.randrange(90)) if i % 2 else text(r.randrange(200, 400)) for i in range(4000)]
    counts = collections.Counter(t[i : i + suffix.SIZE] for t in map(str.encode, texts) for i in range(len(t) - suffix.SIZE + 1))
    want = collections.Counter()
    for t in map(str.encode, texts):
        at = [i for i in range(len(t) - suffix.SIZE + 1) if counts[t[i : i + suffix.SIZE]] > 1]
        gone = {j for i in at for j in range(i, i + suffix.SIZE)}
        want[len(t), hashlib.sha256(bytes(b for j, b in enumerate(t) if j not in gone)).hexdigest()] += 1
    df = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")
    out = suffix.dedup(df).collect()
    assert {x.doc for x in out} == {key}
    assert collections.Counter((x.n_bytes, x.kept_sha256) for x in out) == want
    assert collections.Counter(x.text for x in suffix.without_repeats(df).collect()) == collections.Counter(x.kept for x in out)


@pytest.mark.parametrize("line", [150, 196, 230])
def test_suffix_dedup_sends_few_rows_for_a_common_line(spark, monkeypatch, line):
    r = random.Random(line)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common, rows = noise(line), []
    for i in range(400):  # two texts with the same line, its surroundings alike on one side or on both in every fifth pair
        before, after = noise(30 + i % 50), noise(90 - i % 40)
        rows += [(2 * i, noise(150) + before + common + after + noise(150)), (2 * i + 1, noise(150) + (before if i % 5 < 2 else noise(60)) + common + (after if i % 5 % 2 else noise(60)) + noise(150))]
    made = []
    real = type(frame(spark, rows)).mapInArrow

    def counted(self, go, *args):
        made.append(spark.sparkContext.accumulator(0))
        total = made[-1]

        def count(batches):
            for batch in go(batches):
                total.add(batch.num_rows)
                yield batch

        return real(self, count, *args)

    monkeypatch.setattr(type(frame(spark, rows)), "mapInArrow", counted)
    got = {x.doc: (x.n_bytes, [(s.start, s.stop) for s in x.spans]) for x in suffix.dedup(frame(spark, rows)).collect()}
    counts = collections.Counter(t[i : i + suffix.SIZE] for _, t in rows for i in range(len(t) - suffix.SIZE + 1))
    for d, t in rows:
        at = [i for i in range(len(t) - suffix.SIZE + 1) if counts[t[i : i + suffix.SIZE]] > 1]
        gone = sorted({j for i in at for j in range(i, i + suffix.SIZE)})
        want = [(a, b + 1) for a, b in zip([g for g in gone if g - 1 not in set(gone)], [g for g in gone if g + 1 not in set(gone)])]
        assert got[d] == (len(t), want)
    assert max(x.value for x in made) < 20 * len(rows)  # the ranges' sampler reads its rows once more


def test_multikey_quicksort():
    import numpy as np

    r = random.Random(2)
    data = np.frombuffer(("".join(r.choice("ab") for _ in range(900)) * 2 + "\0" * 8).encode(), np.uint8).copy()
    for size in (8, 12, 20):
        at = np.arange(1800 - size)
        group = at % 2
        hit = suffix.multikey(data, at, group.copy(), size)
        n = collections.Counter((int(g), data[a : a + size].tobytes()) for a, g in zip(at, group))
        assert hit.tolist() == [n[int(g), data[a : a + size].tobytes()] > 1 for a, g in zip(at, group)]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(spark, size, percent):
    rows = corpus(7, 140) + [(3000 + i, " ".join(["w%d" % ((i * 7 + j) % 40) for j in range(30)])) for i in range(40)]
    got = {(r.doc, r.n_shingles, r.component) for r in jaccard.join(frame(spark, [*rows, (None, "a b c d e f")]), size=size, percent=percent).collect()}
    sets = {}
    for d, t in rows:
        w = visible(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {(d, len(s), root(d)) for d, s in sets.items()} | {(None, max(1, 6 - size + 1), None)}
    kept = jaccard.keep_one(frame(spark, [*rows, (None, "a b c d e f")]), size=size, percent=percent)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted([(False, d) for d in sets if root(d) == d] + [(True, None)])
    assert jaccard.join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("small,large", [(8, 13), (18, 28), (39, 64), (61, 100)])
def test_jaccard_join_of_a_part_and_its_whole(spark, small, large):
    rows = [(2 * k + i, " ".join(f"w{k}x{j}" for j in range(n))) for k in range(20) for i, n in enumerate((small, large))]
    got = {r.doc: r.component for r in jaccard.join(frame(spark, rows, False), size=1, percent=60).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_jaccard_join_of_several_texts_under_one_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (2, two), (3, two), (3, one), (4, "other words")]
    assert {(r.doc, r.component) for r in jaccard.join(frame(spark, rows, False)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("limits", [{"hot": 2, "block": 300}, {"longest": 3, "block": 300}])
def test_jaccard_join_works_in_parts(spark, limits):
    """Chains of texts whose ends aren't alike, and near copies of one text, in more blocks than one."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(0, 160, 2)]
    for i in range(60):
        words = [f"c{j}" for j in range(50)]
        words[r.randrange(50)] = f"own{i}"
        rows.append((1000 + i, " ".join(words)))
    whole = {(x.doc, x.component) for x in jaccard.join(frame(spark, rows, False), size=2, percent=80).collect()}
    parts = {(x.doc, x.component) for x in jaccard.join(frame(spark, rows, False), size=2, percent=80, **limits).collect()}
    assert whole == parts == {(d, 0 if d < 1000 else 1000) for d, _ in rows}


def sent_batch(mb):
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(0, 10**6, 1000))) for _ in range(mb * 146)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])


def test_jaccard_block_is_sorted_in_little_memory():
    """A block's signatures are sorted a slice at a time: besides the block itself a task needs little."""
    batch = sent_batch(6)
    jaccard.signatures(*jaccard.shingles(*scan.buffers(batch.column("text").slice(0, 9)), 5), 80)  # tables that stay
    tracemalloc.start()
    try:
        packed = sum(b.nbytes for b in jaccard._send(8, 5, 80, 64)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * packed, (peak, packed)


def test_jaccard_batch_of_long_texts_is_sent_in_several_blocks(monkeypatch):
    batch = sent_batch(3)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1 << 20)
    sent = [r for b in jaccard._send(8, 5, 80, 64)(iter([batch])) for r in b.to_pylist()]
    docs = [unpack(r["part"], np.uint64).reshape(3, -1)[0].tolist() for r in sent if r["sketches"] is not None]
    assert len(docs) >= 2 and sum(docs, []) == batch.column("doc").to_pylist()


def test_every_band_has_a_plan():
    kinds = {jaccard.plan_of(b, 85)[2] for b in range(len(jaccard.bands()) - 2)}
    assert kinds == {0, 1, 3}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)]
    up = {x: x for e in edges for x in e}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


@pytest.mark.parametrize("max_set", [100_000, 3])
def test_decontamination(spark, max_set):
    rows = corpus(11)
    items = [(1, " ".join(alnum(rows[5][1])[:14])), (2, "One TWO"), (3, None), (4, "!!"), (None, " ".join(alnum(rows[8][1])[2:13])), (5, "never seen here")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    got = collections.Counter((r.doc, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(frame(spark, rows), bench, max_set=max_set).collect())
    want = collections.Counter()
    clean = []
    for d, t in rows:
        w = alnum(t)
        hit, found = set(), set()
        for item, text in items:
            x = alnum(text)
            k = min(10, len(x))
            grams = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add("null" if item is None else str(item))
        want[d, len(w), len(hit), tuple(sorted(found))] += 1
        if not hit:
            clean.append((d, t))
    assert got == want
    kept = decontaminate.clean(frame(spark, rows), bench, max_set=max_set)
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(clean)
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_lm(spark):
    rows = [*corpus(13, 120), (None, "alpha beta")]
    out, weights = lm.score(frame(spark, rows), block_bytes=20_000)
    got = collections.Counter()
    tokens = [(d, [*visible(t), None]) for d, t in rows]
    count = collections.Counter()
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in tokens}
    for d, t in tokens:
        if not held[d]:
            count.update(t)
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for d, t in tokens:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[d, held[d], len(t), sum(count[w] > 0 for w in t), n, round(base, 6)] += 1
    scores, want_scores = collections.defaultdict(list), collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] += 1
        scores[r.doc_id].append(round(r.score, 6))
    assert got == want

    # every training document teaches, seen by counts that leave it out
    begin, trained = "<begin>", [t for d, t in tokens if not held[d]]
    pairs = collections.Counter(p for t in trained for p in zip([begin, *t], t))
    before = collections.Counter({**count, begin: len(trained)})

    def bucket(c):
        return min(lm.BUCKETS - 1, 1 + int(math.log2(c))) if c else 0

    def octave(p):
        return round(lm.CELL * math.log2(p)) if p else lm.NONE

    cells = collections.Counter()
    for t in trained:
        own, own_pairs, own_before = collections.Counter(t), collections.Counter(zip([begin, *t], t)), collections.Counter([*t, begin])
        for u, w in zip([begin, *t], t):
            c = before[u] - own_before[u]
            cells[bucket(c), octave((count[w] - own[w]) / (n - len(t))), octave((pairs[u, w] - own_pairs[u, w]) / max(c, 1))] += 1
    assert np.abs(weights - lm.learn_weights([(*k, m) for k, m in cells.items()], v)).max() < 1e-6
    for d, t in tokens:
        total = 0.0
        for u, w in zip([begin, *t], t):
            x = weights[bucket(before[u])]
            total += math.log10(x[0] * pairs[u, w] / max(before[u], 1) + x[1] * count[w] / n + x[2] / (v + 1))
        want_scores[d].append(round(total, 6))
    assert {d: sorted(x) for d, x in scores.items()} == {d: sorted(x) for d, x in want_scores.items()}
    assert abs(weights.sum(axis=1) - 1).max() < 1e-9
    assert lm.score(frame(spark, []))[0].count() == 0


def test_em_finds_the_mixture():
    cells = [(3, lm.NONE, lm.NONE, 1), (3, -8, -4, 10_000), (3, -8, lm.NONE, 100)]
    w = lm.learn_weights(cells, 1000)
    assert w[3][0] > 0.9 and abs(w.sum(axis=1) - 1).max() < 1e-9


def test_licenses(spark):
    rows = [*corpus(17), (5000, "Under the MIT; license. cc by-nc\nApache License, Version 2.0 under THE mit license"), (5001, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0")]
    for r in licenses.licenses(frame(spark, rows)).collect():
        texts = [t for d, t in rows if d == r.doc]
        w = alnum(texts[0])
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r.n_words == len(w) and r.n_base == len(places)
        assert r.first_word == (min(places)[0] if places else None) and r.last_word == (max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1
        if r.doc == 5001:
            assert r.labels == "apache-2,gpl-2.0-or-later-with-classpath-exception-2,mit" and r.score == 1
    assert licenses.licenses(frame(spark, [])).count() == 0


def test_license_expressions():
    assert licenses.to_postfix("a OR b AND c") == ["a", "b", "c", "and", "or"]
    assert licenses.to_postfix("(a or b) and c trailing words") == ["a", "b", "or", "c", "and"]
    assert licenses.evaluate(licenses.to_postfix("(a or b) and c")) == [frozenset("ac"), frozenset("bc")]
    assert licenses.named(licenses.to_postfix("(MIT or gpl-2.0-only) and c with d-1.0")) == {"mit", "gpl-2", "c-with-d-1"}
    for owned, enough in (({"a", "c"}, True), ({"a", "b"}, False), ({"c"}, False), ({"b", "c"}, True)):
        assert licenses.holds(licenses.to_postfix("(a or b) and c"), owned) == enough
    clauses = " and ".join(f"(a{i} or b{i})" for i in range(2000))
    assert len(licenses.named(licenses.to_postfix(clauses))) == 4000  # has 2**2000 ways to comply
    assert licenses.holds(licenses.to_postfix(clauses), {f"b{i}" for i in range(2000)})
    tagged = f"x\nSPDX-License-Identifier: {clauses}\nspdx-license-identifier: mit".encode()
    assert len(licenses.scan_text(tagged)["labels"].copy()) == 4001
    for bad in ("", "or a", "a and", "(a", "a or )"):
        assert licenses.to_postfix(bad) is None


def labelled(seed, n):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = r.choice(["good", "good", "low", "toxic"])
        words = [r.choice(["ba", "do", "ki", "lu"]) + r.choice(["na", "ro", "te", "mi"]) + r.choice(["s", "n", ""]) for _ in range(r.randrange(30, 200))]
        if kind == "low":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vexing", "quaggy"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled(19, 900)
    known = spark.createDataFrame([*labels[:600], (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows += [(None, "bana doro"), (9000, None), (9001, ""), (9002, rows[0][1]), (9002, rows[0][1])]
    c = quality.Classifier(frame(spark, rows), known)
    keep = {r.doc: r.keep for r in c.result().collect()}
    truth = {i: q == 1 and t == 0 for i, q, t in labels[600:]}
    good = [keep[i] for i, y in truth.items() if y]
    bad = [keep[i] for i, y in truth.items() if not y]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.05 * len(bad)
    kept = collections.Counter(r.doc_id for r in c.sample(frame(spark, rows)).collect())
    assert sum(kept.values()) == c.result().filter("keep").count() and kept[9002] in (0, 2)
    none = quality.Classifier(frame(spark, rows[:20]), known.limit(0))
    assert none.result().filter("keep").count() == 20
    assert quality.Classifier(frame(spark, []), known).result().count() == 0


def test_kth_largest(spark):
    r = random.Random(1)
    x = [r.choice([r.gauss(0, 1), 0.5]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in x], "drawn double")
    for k in (1, 700, 1500, 2999):
        assert quality._kth_largest(df, k, most=50) == sorted(x, reverse=True)[k - 1]


def test_mixing(spark):
    r = random.Random(23)
    names = ["s0", "s1", "s2", None]
    rows = [(i, r.choice(["s0", "s0", "s0", *names])) for i in range(4000)] + [(7, "s0"), (7, "s0"), (None, "s1"), (8000, "left out")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix_slot", F.lit(1)).withColumn("extra", F.lit("x"))
    out = mixing.mix(df, {"s0": 5, "s1": 3, "s2": 1, None: 1}, block=8, period=100).collect()
    assert collections.Counter((x.doc_id, x.source) for x in out) == collections.Counter(rows)
    assert len({x.mix_position for x in out}) == len(out)
    blocks = {(x.mix_slot, x.source): x for x in out}
    assert len({s for s, _ in blocks}) == len(blocks)
    first_end = min(max(x.mix_slot for x in out if x.source == s) for s in ("s0", "s1", "s2", None))
    taken = collections.Counter()
    for slot in range(first_end):
        at = [x for (s, _), x in blocks.items() if s == slot]
        assert len(at) == 1 and at[0].mix_release <= slot < at[0].mix_deadline
        taken[at[0].source] += 1
        for s in ("s0", "s1", "s2", None):
            w = next(x.mix_weight for x in out if x.source == s)
            assert abs(taken[s] - w * (slot + 1)) < 1
    assert max(x.mix_position for x in out if x.source != "left out") < min(x.mix_position for x in out if x.source == "left out")
    assert mixing.mix(df.limit(0)).count() == 0


def test_schedule_meets_every_deadline():
    r = random.Random(29)
    for _ in range(30):
        slots = mixing.slots_of({f"s{i}": r.random() ** 3 for i in range(r.randrange(1, 30))}, 200)
        plan = mixing.schedule(slots)
        assert sorted(x[0] for x in plan.values()) == list(range(sum(slots.values())))
        assert all(release <= slot < deadline for slot, release, deadline in plan.values())


@pytest.mark.parametrize("target", [{"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}, {"a": 0.9, "b": 0.1}, {"a": 1, "b": 1e-6}, {"a": 2**0.5, "b": 3**0.5, "c": 0.01}])
def test_mixing_keeps_the_given_weights(spark, target):
    rows = [(i, "a" if i % 2 else "bcd"[i // 2 % (len(target) - 1)]) for i in range(9000)] + [(9001, "late"), (9002, "later")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), target, block=1).collect()
    assert len({x.mix_position for x in out}) == len(out) == 9002
    live = sorted((x.mix_slot, x.source) for x in out if x.source in target)
    end = min(max(s for s, n in live if n == m) for m in target)
    total = sum(mixing.exact(w) for w in target.values())
    taken = collections.Counter()
    for slot, (at, source) in enumerate(live[: end + 1]):
        taken[source] += 1
        assert at == slot and all(abs(taken[s] - mixing.exact(w) / total * (slot + 1)) < 1 for s, w in target.items())
    for x in out:
        if x.source in target:
            w = mixing.exact(target[x.source]) / total
            assert (x.mix_release, x.mix_deadline) == (math.floor(x.mix_block / w), math.ceil((x.mix_block + 1) / w)) and x.mix_release <= x.mix_slot < x.mix_deadline


@pytest.mark.parametrize("step", [jaccard.keep_one, suffix.without_repeats])
def test_checkpoints_of_few_documents_take_few_files(spark, tmp_path, step):
    """However many partitions the session has; each file of a checkpoint costs an executor on a local disk two processes."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before, sc = {k: spark.conf.get(k) for k in keys}, spark.sparkContext
    old, docs = sc.getCheckpointDir(), frame(spark, corpus(7), extra=False)
    want = sorted(map(str, step(docs).collect()))
    try:
        spark.conf.set(keys[0], "32")
        spark.conf.set(keys[1], "false")
        sc.setCheckpointDir(str(tmp_path))
        assert sorted(map(str, step(docs).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        if old:
            sc.setCheckpointDir(old)
    files = [len(list(x.glob("part-*"))) for x in tmp_path.glob("*/rdd-*")]
    assert files and max(files) <= 8
