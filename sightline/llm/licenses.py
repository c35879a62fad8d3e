"""License scans: an Aho-Corasick automaton over notice phrases and identifier tags, and a shunting-yard parser for license expressions.

The automaton runs over the words of a text joined by single spaces, so a phrase is found where its
words stand consecutively, whatever stands between them. SPDX-License-Identifier tags are found by a second
automaton on the raw text; the rest of the tag's line, up to the next tag, is parsed as an expression of identifiers
with AND, OR, WITH and parentheses. The licenses that it names become labels; ``holds`` evaluates it for a
set of licenses that one may use. Both take time in proportion to the expression, however it is nested.
"""

from __future__ import annotations

import functools
import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import scan
from sightline.llm.native import table, text_of

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of this method: words, label and how sure a lone hit makes it.
PHRASES = {
    "permission is hereby granted free of charge": ("mit", 0.8),
    "licensed under the apache license": ("apache-2", 0.8),
    "gnu general public license": ("gpl", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd 3 clause": ("bsd-3-clause", 0.7),
    "bsd 2 clause": ("bsd-2-clause", 0.7),
    "creative commons attribution": ("cc-by", 0.6),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "all rights reserved": ("proprietary", 0.4),
    "public domain": ("public-domain", 0.4),
}
BASE_SURE = 0.9
TAG_SURE = 1.0
TAGS = ("spdx-license-identifier:",)

#: Separators to a space, A-Z to lower case, as bytes.translate takes it.
_PLAIN = bytes(int(scan.LOWER[i]) if scan.ALNUM[i] else 32 for i in range(256))
_LEXEMES = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> tuple[list[str] | None, int]:
    """Shunting-yard: WITH binds before AND before OR. The postfix and where the expression ends; None if it isn't one. Nothing after its end is read."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # expected next
    end = 0
    for lexeme in _LEXEMES.finditer(expression):
        token = lexeme.group()
        low = token.lower()
        if low in _RANK:
            if operand:
                return None, end
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand:
                return None, end
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif operand:
            out.append(low.rstrip("."))
            operand = False
        else:
            break  # two identifiers in a row: the expression has ended
        end = lexeme.end()
    if operand or "(" in stack:
        return None, end
    return out + stack[::-1], end


def to_postfix(expression: str) -> list[str] | None:
    return parse(expression)[0]


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The ways to comply: each a set of licenses that hold together. x WITH y is one license named x-with-y.

    There may be as many ways as the product of all alternatives; scans use ``named`` and ``holds``, which don't list them.
    """
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append([frozenset([token])])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "or":
            stack.append(list(dict.fromkeys([*a, *b])))
        elif token == "and":
            stack.append(list(dict.fromkeys(x | y for x in a for y in b)))
        else:
            stack.append([frozenset(f"{x}-with-{'-'.join(sorted(y))}" for x in s) for s in a for y in b])
    return stack.pop()


def named(postfix: list[str]) -> set[str]:
    """The labels of the licenses in an expression. x WITH y is one license, x-with-y; where y is itself an expression all its names follow."""
    stack: list[list[str]] = []  # the smaller of two lists is put to the larger, so a long expression costs little more than its length
    for token in postfix:
        if token not in _RANK:
            stack.append([token])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            more = "-".join(sorted(b))
            stack.append([f"{x}-with-{more}" for x in a])
        else:
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a += b
            stack.append(a)
    return {label_of(x) for x in stack.pop()}


def holds(postfix: list[str], owned: set[str]) -> bool:
    """Whether licenses with these labels are enough to comply: AND asks for both sides, OR for one."""
    stack: list = []

    def value(x) -> bool:
        return x if isinstance(x, bool) else label_of(x) in owned

    for token in postfix:
        if token not in _RANK:
            stack.append(token)
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(f"{a}-with-{b}" if isinstance(a, str) and isinstance(b, str) else False)
        else:
            stack.append((value(a) or value(b)) if token == "or" else (value(a) and value(b)))
    return value(stack.pop())


def label_of(identifier: str) -> str:
    """The short label of an SPDX identifier: apache-2.0 is apache-2, gpl-3.0-or-later is gpl-3."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    return re.sub(r"\.0$", "", name)


@functools.cache
def automaton():
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **PHRASES}:
        a.add_word(f" {phrase} ", (phrase in BASE, phrase))
    a.make_automaton()
    return a


@functools.cache
def tag_automaton():
    a = ahocorasick.Automaton()
    for tag in TAGS:
        a.add_word(tag, len(tag))
    a.make_automaton()
    return a


def scan_text(raw: bytes) -> dict:
    """n_words, base (starts of base phrases in words, sorted), base_labels, labels, score, notices (start word, stop word, label), expressions."""
    words = raw.translate(_PLAIN).split()
    joined = b" ".join([b"", *words, b""])
    text = joined.decode("utf-8", "replace")
    notices, base, sure = [], [], 0.0
    base_labels, labels = set(), set()
    at, spaces = 0, 0
    for end, (is_base, phrase) in automaton().iter(text):
        begin = end - len(phrase) - 1
        if begin < at:
            start = spaces - text.count(" ", begin, at)
        else:
            spaces += text.count(" ", at, begin)
            at = begin
            start = spaces
        if is_base:
            label, p = BASE[phrase], BASE_SURE
            base.append(start)
            base_labels.add(label)
        else:
            label, p = PHRASES[phrase]
        labels.add(label)
        sure = 1 - (1 - sure) * (1 - p)
        notices.append((start, start + phrase.count(" ") + 1, label))
    expressions = []
    tags = [(end + 1, length) for end, length in tag_automaton().iter(raw.lower().decode("latin-1"))]  # one character a byte
    for (begin, _), (after, length) in itertools.pairwise([*tags, (len(raw), 0)]):
        limit = after - length  # what belongs to a tag ends at the next one, or at its line's end
        stop = raw.find(b"\n", begin, limit)
        line = raw[begin : stop if stop >= 0 else limit].decode("utf-8", "replace")
        postfix, end = parse(line)
        if postfix:
            expressions.append(line[:end].strip())
            labels |= named(postfix) - {"none", "noassertion"}
            sure = TAG_SURE
    return {"n_words": len(words), "base": sorted(base), "base_labels": sorted(base_labels), "labels": sorted(labels), "score": round(min(1.0, sure), 6), "notices": sorted(notices), "expressions": expressions}


_FOUND = "doc long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<start:int,stop:int,label:string>>, expressions array<string>"


def _go(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string())]))
    for batch in batches:
        data, offsets = scan.buffers(batch.column("text"))
        found = [scan_text(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                pa.array(np.array([x["n_words"] for x in found], np.int64)),
                pa.array(np.array([len(x["base"]) for x in found], np.int64)),
                pa.array([x["base"][0] if x["base"] else None for x in found], pa.int64()),
                pa.array([x["base"][-1] if x["base"] else None for x in found], pa.int64()),
                pa.array([",".join(x["base_labels"]) for x in found], pa.string()),
                pa.array([",".join(x["labels"]) for x in found], pa.string()),
                pa.array([x["score"] for x in found], pa.float64()),
                pa.array([[{"start": a, "stop": b, "label": c} for a, b, c in x["notices"]] for x in found], kind),
                pa.array([x["expressions"] for x in found], pa.list_(pa.string())),
            ],
            names=["doc", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices", "expressions"],
        )


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: words, base phrase places, labels, score 0 to 1, all notices and expressions.

    A null or empty text has no words, empty labels and score 0. Overlapping phrases all count. A
    malformed expression adds no label. Repeated rows give repeated results, an empty table gives none, and
    other columns of docs are left out. A text of any length is scanned as a whole, in linear time.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc"), text_of(text).alias("text")).mapInArrow(_go, _FOUND)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every text. A null or empty text has no words, null places, empty labels and score 0; repeated rows repeat, long texts take linear time, an empty table gives no rows."""
    return licenses(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
