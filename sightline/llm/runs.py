"""Periodic runs: maximal stretches of words with a smallest period that fits in twice.

Method. A run of length L >= max(least, 2q) repeats L - q words at distance q, and L - q is at least k = ceil(least / 2) whatever q is. So each
of its words lies in a k-gram that occurs twice in the document. Words outside such k-grams are masked; what survives falls into
segments of neighbouring words and no run crosses two of them. Main-Lorentz searches the segments alone: each is halved again and again,
and a run across a middle is found from how far the words on both sides agree at each distance. All halves of all segments of one depth
are searched together in NumPy, and the agreements come from prefix hashes by doubling widths. Every run is then compared
word by word; if a hash ever lied, its document is searched again with exact names for all stretches of 2**i words.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import scan
from sightline.llm.native import table, text_of

LEAST = 12
#: White space that separates words; bytes.split takes the same.
SPACE = r"[\x20\x09-\x0D]+"
_STEP = 1 << 20  # distances looked at together
_PIECE = 1 << 19  # bytes of short texts searched together

Equal = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def hashed(words: np.ndarray) -> Equal:
    """Whether the 2**k words at i equal those at j, by 64-bit hashes."""
    power = scan.powers(len(words) + 1)[0]
    p = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(scan.mix(words.astype(np.uint64) + np.uint64(1)) * power[:-1], out=p[1:])

    def equal(i, j, k):
        first, then = np.minimum(i, j), np.maximum(i, j)
        return (p[first + (1 << k)] - p[first]) * power[then - first] == p[then + (1 << k)] - p[then]

    return equal


def named(words: np.ndarray) -> Equal:
    """The same without a chance: equal stretches of 2**k words have equal numbers."""
    names = [np.unique(words, return_inverse=True)[1]]

    def equal(i, j, k):
        while len(names) <= k:
            x, half = names[-1], 1 << (len(names) - 1)
            names.append(np.unique(x[:-half] * np.int64(len(words)) + x[half:], return_inverse=True)[1])
        return names[k][i] == names[k][j]

    return equal


def agreement(equal: Equal, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from i and j on agree, at most room: forwards for step 1, backwards (i and j included) for -1."""
    reach = np.zeros(len(i), np.int64)
    risen = np.zeros(len(i), np.int64)

    def tried(at: np.ndarray, k: int) -> np.ndarray:
        at = at[reach[at] + (1 << k) <= room[at]]
        shift = reach[at] if step > 0 else 1 - reach[at] - (1 << k)
        at = at[equal(i[at] + shift, j[at] + shift, k)]
        reach[at] += 1 << k
        return at

    live, k = np.arange(len(i)), 0
    while len(live):
        live = tried(live, k)
        k += 1
        risen[live] = k
    order = np.argsort(risen, kind="stable")
    for k in range(int(risen[order[-1]]) - 1 if len(i) else -1, -1, -1):  # what was refused at 2**risen has less than that to go
        tried(order[np.searchsorted(risen[order], k, "right") :], k)
    return reach


def segments(words: np.ndarray, offsets: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of the stretches of at least so many words that all lie in size-grams repeated in their own document.

    Document d has words[offsets[d] : offsets[d + 1]]. A chance collision of hashes only adds words.
    """
    n = len(words) - size + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = scan.mix(words.astype(np.uint64) + np.uint64(1))
    gram = scan.mix(doc[:n].astype(np.uint64))
    for k in range(size):
        gram = gram * np.uint64(scan.BASE) + x[k : k + n]
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= doc[:n] == doc[size - 1 :]
    cover = np.zeros(len(words) + 1, np.int32)
    cover[:n] += twice
    cover[size:] -= twice
    inside = np.cumsum(cover[:-1]) > 0
    other = doc[1:] != doc[:-1]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | other
    closes[:-1] &= ~inside[1:] | other
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    keep = stop - start >= least
    return start[keep], stop[keep]


def _crossing(equal: Equal, low, high, least: int):
    """(start, stop, period) of the stretches in [low, high) that repeat at a period, twice at least, found at the middles of all halves of each segment."""
    found = []
    node_low, node_high, seg_low, seg_high = low, high, low, high
    while len(node_low):
        middle = (node_low + node_high) // 2
        for right in (True, False):
            ways = node_high - middle if right else middle - node_low
            total = np.cumsum(ways)
            for first in range(0, int(total[-1]), _STEP):
                flat = np.arange(first, min(first + _STEP, int(total[-1])))
                node = np.searchsorted(total, flat, "right")
                q = flat - (total - ways)[node] + 1
                m, a, b = middle[node], seg_low[node], seg_high[node]
                i, j = (m, m + q) if right else (m - q, m)
                ahead = agreement(equal, i, np.minimum(j, b - 1), np.where(j < b, b - j, 0), 1)
                behind = agreement(equal, np.maximum(i - 1, a), j - 1, i - a, -1)
                hit = (ahead + behind >= q) & (ahead + behind + q >= least)
                found.append(np.stack([(i - behind)[hit], (j + ahead)[hit], q[hit]], 1))
        halves = [np.concatenate(x) for x in ((node_low, middle), (middle, node_high), (seg_low, seg_low), (seg_high, seg_high))]
        keep = halves[1] - halves[0] >= least  # a run is no shorter and so crosses some middle above
        node_low, node_high, seg_low, seg_high = (x[keep] for x in halves)
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of some documents' word numbers, by start, then period. Starts count through all documents."""
    low, high = segments(words, offsets, -(-least // 2), least)
    if not len(low):
        return np.zeros((0, 3), np.int64)
    for way in (hashed, named):
        x = _crossing(way(words), low, high, least)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        first = np.ones(len(x), bool)
        first[1:] = (x[1:, :2] != x[:-1, :2]).any(axis=1)
        x = x[first]  # of equal stretches the smallest period
        if way is named or _are_runs(words, offsets, x):
            break
    x[:, 1] -= x[:, 0]
    return x[np.lexsort((x[:, 2], x[:, 0]))]


def _are_runs(words: np.ndarray, offsets: np.ndarray, found: np.ndarray) -> bool:
    """Whether each (start, stop, period) repeats and can't be made longer."""
    doc = np.searchsorted(offsets, found[:, 0], "right") - 1
    for (start, stop, q), low, high in zip(found.tolist(), offsets[doc].tolist(), offsets[doc + 1].tolist()):
        if not np.array_equal(words[start : stop - q], words[start + q : stop]):
            return False
        if (start > low and words[start - 1] == words[start - 1 + q]) or (stop < high and words[stop] == words[stop - q]):
            return False
    return True


def collapse(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: a word goes if any run holds it after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


_FOUND = "doc long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def _scan(least: int):
    def piece(docs: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, texts)])
        number: dict[bytes, int] = {}
        x = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64, offsets[-1])
        found = runs(x, offsets, least)
        keep = collapse(len(x), found)
        places = np.searchsorted(found[:, 0], offsets)  # the runs of each document stand together
        touched = np.diff(places) > 0
        left = [b" ".join(itertools.compress(words, keep[a : a + len(words)]) if hit else words) for words, a, hit in zip(texts, offsets, touched)]
        own = found[:, 0] - np.repeat(offsets[:-1], np.diff(places))
        listed = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in (own, found[:, 1], found[:, 2])], fields=list(_RUNS.value_type)))
        return pa.RecordBatch.from_arrays([docs, pa.array(np.diff(offsets)), listed, pa.array(left, pa.binary()).cast(pa.string())], names=["doc", "n_words", "runs", "collapsed"])

    def go(batches):
        for batch in batches:
            data, offsets = scan.buffers(batch.column("text"))
            for a, b in scan.pieces(offsets, _PIECE):
                yield piece(batch.column("doc").slice(a, b - a), [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(a, b)])

    return go


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc, n_words, runs (start, length, period, by start, then period), collapsed: one row for each input row.

    Words are what white space separates, compared byte by byte. A run has at least ``least`` words (2 or more) and two periods. ``collapsed`` has the words that
    no run holds after its first period, joined by single spaces. A null or empty text has no words, no runs and
    an empty ``collapsed``. Repeated rows give repeated results, an empty table none; other columns of docs are left out. A text
    of n words takes memory in proportion to n and, for s words in segments, time in proportion to n and s log(s)**2.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    return docs.select(F.col(doc_id).cast("long").alias("doc"), text_of(text).alias("text")).mapInArrow(_scan(least), _FOUND)


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and the text as the query has it: where crc32(doc_id) ends in 0, words from some word on repeat at some period; both follow from the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n, a, p = (F.col(x) for x in ("g", "n", "a", "p"))
    x = docs.select("doc_id", text_of("text").alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.array_remove(F.split(text_of("text"), SPACE), "")).alias("words"))
    x = x.withColumn("n", F.size("words")).withColumn("a", (g % F.greatest(n, F.lit(1))).cast("int"))  # columns, so no element splits the text again
    x = x.withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    planted = F.concat(F.slice("words", F.lit(1), a + p), F.transform(F.sequence(a + p, n - 1), lambda i: F.get("words", a + (i - a) % p)))
    return x.select("doc_id", F.when((n > 0) & (a + p < n), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """One row for each document: n_runs, the longest run (null without runs) and digests of all runs and of the collapsed text. A null text has no words, a null id no planted period."""
    x = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return x.withColumn("best", best).select(
        F.col("doc").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
