"""Periodic runs, fill-in-middle and token files against brute force and exact round trips, with nulls, empty and long texts, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import fim, runs, tokenfile

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("doc", "n", "h", "h1", "row", "units", "low", "form", "prefix", "output", "runs", "words", "g", "a", "p", "file", "first", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def texts(seed=3, n=60):
    r = random.Random(seed)
    words = ["alpha", "beta", "Émile", "straße", "x,", "don't", "中文", "9", "😀", "<b>"]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            at, k, q = r.randrange(len(w) + 1), r.randrange(1, 9), r.randrange(1, 5)
            w[at:at] = w[at : at + q] * k
        out.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    return [*out, (100, None), (101, ""), (102, " \n "), (103, "one"), (104, out[1][1]), (104, out[1][1]), (105, out[2][1]), (105, None), (None, "a b"), (None, None), (-7, "x <P> y"), (106, "word " * 3000), (107, "z" * 70000), (108, "\x00 a\x00b \x85 \xa0 <|endoftext|>")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w, least=12):
    """Every pair of start and period by comparing words; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_of_word_numbers():
    r = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(r.randrange(1, 5)):
            n, k = r.randrange(70), r.choice([1, 2, 3, 5])
            w = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randrange(3, 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        least = r.choice([2, 3, 5, 12])
        offsets = np.cumsum([0, *map(len, docs)])
        x = np.array([v for w in docs for v in w], np.int64)
        want = [(s + int(o), m, q) for w, o in zip(docs, offsets) for s, m, q in brute_runs(w, least)]
        assert [tuple(map(int, v)) for v in runs.runs(x, offsets, least)] == want
        low, high = runs.segments(x, offsets, -(-least // 2), least)
        if len(low):  # the exact names, which only a lying hash would call for
            assert np.array_equal(runs._crossing(runs.named(x), low, high, least), runs._crossing(runs.hashed(x), low, high, least))


def test_words_outside_repeated_grams_join_no_run():
    w = [0, 1, 2, 3, 4, 5] * 3
    x = np.array([*range(50, 80), *w, *range(90, 120)], np.int64)
    low, high = runs.segments(x, np.array([0, len(x)]), 6, 12)
    assert (low.tolist(), high.tolist()) == ([30], [48])
    assert not len(runs.segments(x[:39], np.array([0, 39]), 6, 12)[0])


def test_a_lying_hash_is_noticed(monkeypatch):
    x = np.array([0, 1, 2, 3, 4, 5, 6] * 3 + [7, 8, 9], np.int64)
    offsets = np.array([0, len(x)])
    honest = runs.runs(x, offsets)
    monkeypatch.setattr(runs, "hashed", lambda words: lambda i, j, k: np.ones(len(i), bool))
    assert np.array_equal(runs.runs(x, offsets), honest) and honest.tolist() == [[0, 21, 7]]


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest_row(doc_id, text):
    w = planted(doc_id, text)
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    milli = best[1] * 1000 // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(row):
    return tuple((x is not None, x) for x in row)


def write_table(df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_runs_query(spark, tmp_path):
    rows = texts() + [(i, "a b c d e f g h " * (i % 7)) for i in range(200, 260)]
    got = sorted((tuple(x) for x in runs.op11_periodic_runs(spark, write_table(frame(spark, rows), tmp_path)).collect()), key=key)
    want = sorted((digest_row(*x) for x in rows), key=key)
    assert got == want and sum(x[1] > 0 for x in got) > 20 and any(planted(*x) != re.findall(r"[^\x20\x09-\x0D]+", x[1] or "") for x in rows)
    made = {x.doc: x for x in runs.periodic_runs(frame(spark, rows).filter("doc_id in (100, 101, 106)")).collect()}
    assert made[106].collapsed == "word" and [tuple(x) for x in made[106].runs] == [(0, 3000, 1)]
    assert made[100].collapsed == "" == made[101].collapsed and made[100].runs == [] and made[100].n_words == 0
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boundaries_are_those_of_the_grammar(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abA \n\r.9é😀中") for _ in range(r.randrange(40)))) for i in range(150)] + [(200, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for grammar in (fim.WORDS, fim.LINES, fim.CHARACTERS, r"[a-z]+|[A-Z]+|[^a-zA-Z]", r"[a-z]*[.]|[a-z]+|[^a-z.]", r"[A-Z][a-z]*|[a-z]+|[^A-Za-z]+"):
        for x in df.select("text", fim.units(F.col("text"), grammar).alias("u")).collect():
            assert x.u == re.findall(grammar, x.text)
    for bad in ("a+", "[a]+|", "[a]b"):
        with pytest.raises(ValueError):
            fim.boundary(bad)


def test_fill_in_middle(spark, tmp_path):
    rows = texts() + [(i, f"some text, number {i}") for i in range(200, 400)]
    got = sorted((tuple(x) for x in fim.op12_fill_in_middle(spark, write_table(frame(spark, rows), tmp_path)).collect()), key=key)
    want = []
    for doc_id, text in rows:
        t = text or ""
        u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        digest = sha(f"1:{'' if doc_id is None else doc_id}")
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = ("".join(x) for x in (u[:low], u[low:high], u[high:]))
        plain = not t or any(x in t for x in fim.MARKS) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((doc_id, len(u), form, None if plain else len(p), None if plain else len(m), sha(out), sha(t)))
    assert got == sorted(want, key=key) and {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame(spark, rows), marks=("<P>", "<S>", "<P<"))
    other = fim.fill_in_middle(frame(spark, rows), grammar=fim.LINES, seed=2, marks=("{p", "{s", "{m")).select("text", fim.restored(F.col("form"), F.col("output"), ("{p", "{s", "{m")).alias("back"))
    assert all(x.text == x.back for x in other.collect())


def tokenizer():
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_is_the_tokenizer():
    path, whole = tokenizer()
    encode, r = tokenfile.Encoder(path), random.Random(2)
    marks = [*"ÀþÿĀıİƀɏɐʰ×÷abAB'stlvd.,<|>09 \n\t\x00\x1c\x85\xa0éÉ́İßσΣς中😀²½‍", "<|endoftext|>", "'ll", "don't", "it'S"]
    for _ in range(1500):
        some = ["".join(r.choice(marks) for _ in range(r.randrange(30))) for _ in range(3)]
        ids, n = encode([x.encode() for x in some])
        want = [whole.encode(x, add_special_tokens=False).ids for x in some]
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


def test_a_word_is_looked_up_once_a_call(monkeypatch):
    path, whole = tokenizer()
    asked, real = [], tokenfile.Ragged.__call__
    monkeypatch.setattr(tokenfile.Ragged, "__call__", lambda self, keys, n: real(self, asked.extend(keys := list(keys)) or keys, n))
    encode, text = tokenfile.Encoder(path), "Word, word don't 12 " * 500
    ids, n = encode([text.encode(), b"", b" Word \n", text.encode()])
    want = [whole.encode(x, add_special_tokens=False).ids for x in (text, "", " Word \n", text)]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    assert sorted(asked) == sorted([b"word", b",", b"don't", b"1", b"2"])


def test_token_files(spark, tmp_path, monkeypatch):
    path, whole = tokenizer()
    rows = texts()
    (tmp_path / "in").mkdir()
    got = sorted((tuple(x) for x in tokenfile.op13_token_files(spark, write_table(frame(spark, rows), tmp_path / "in")).collect()), key=lambda x: x[1])
    ids = {t: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in {x or "" for _, x in rows}}
    assert [x[0] for x in got] == sorted((x for x, _ in rows), key=lambda x: (x is not None, x))
    assert [x[1] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1]]
    want = sorted(((d, len(ids[t or ""]), zlib.crc32(ids[t or ""].tobytes())) for d, t in rows), key=key)
    assert sorted(((x[0], x[2], x[3]) for x in got), key=key) == want


def test_frames_stand_alone_and_damage_is_seen(spark, tmp_path, monkeypatch):
    import zstandard
    from pyarrow import fs

    path, whole = tokenizer()
    monkeypatch.setattr(tokenfile, "_PART", 1000)  # long texts in parts
    rows = texts() + [(500 + i, f"text {i} " * 2000) for i in range(5)]
    places = tokenfile.write(frame(spark, rows), str(tmp_path / "out"), path, files=2)
    one = places.filter("doc = 503")
    (x,) = tokenfile.read(one, str(tmp_path / "out")).collect()
    want = [*whole.encode("text 3 " * 2000, add_special_tokens=False).ids, 2]
    assert np.frombuffer(x.ids, "<u4").tolist() == want
    names = sorted(p.name for p in (tmp_path / "out").glob("*.zst"))
    assert names == sorted(r.file for r in places.select("file").distinct().collect())
    raw = (tmp_path / "out" / x.file).read_bytes()
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(1 << 26) for _ in range(1))
    assert np.frombuffer(plain, "<u2")[x.first : x.first + x.n].tolist() == want
    folder = tmp_path / "frames"
    folder.mkdir()
    writer = tokenfile.Writer(open(folder / "f", "wb"), frame=1000)
    numbers = np.arange(5000, dtype="<u2")
    for part in np.split(numbers, [3, 3, 700, 4100]):
        writer.add(part)
    writer.close()
    opened = fs.LocalFileSystem().open_input_file
    reader = tokenfile.Reader(opened(str(folder / "f")))
    assert reader.span(2000, 2600) == numbers.tobytes()[2000:2600] and reader.frames_read == 1 and len(reader.table) == 10
    assert reader.span(0, 10000) == numbers.tobytes() and reader.span(7, 7) == b""
    with pytest.raises(ValueError):
        reader.span(0, 10001)
    body = bytearray((folder / "f").read_bytes())
    body[int(reader.packed[3]) + 60] ^= 1
    (folder / "g").write_bytes(body)
    damaged = tokenfile.Reader(opened(str(folder / "g")))
    assert damaged.span(0, 3000) == numbers.tobytes()[:3000]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.span(3000, 3002)
    (folder / "h").write_bytes(body[:-1])
    with pytest.raises(ValueError):
        tokenfile.Reader(opened(str(folder / "h")))
    empty = tokenfile.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), path)
    assert empty.count() == 0 and tokenfile.read(empty, str(tmp_path / "none")).count() == 0


def test_many_tags_on_one_line_take_linear_time():
    import time

    from sightline.llm import licenses

    parts = ["MIT", "Apache-2.0 OR (GPL-2.0-only WITH Classpath-exception-2.0)", "(MIT", "BSD-3-Clause AND", "x y z"]
    line = " ".join(f"// SPDX-License-Identifier: {parts[i % 5]};" for i in range(20000)).encode()
    began = time.time()
    found = licenses.scan_text(line)
    assert time.time() - began < 2
    alone = [licenses.scan_text(f"SPDX-License-Identifier: {p};".encode()) for p in parts]
    assert found["labels"] == sorted({x for a in alone for x in a["labels"]}) and len(found["expressions"]) == 12000
    assert set(found["expressions"]) == {e for a in alone for e in a["expressions"]} == {"MIT", parts[1], "x"}


def test_roles_of_any_length_come_back(spark):
    from sightline.llm import chat

    long = "r" * 1_200_000
    df = spark.createDataFrame([(long,), ("R" + long,), ("assistant",)], "role string")
    assert all(x.back == x.role for x in df.select("role", chat.untitle(chat.title(F.col("role"))).alias("back")).collect())
