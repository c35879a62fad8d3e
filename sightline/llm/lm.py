"""Language-model scoring: deleted interpolation of bigram, unigram and uniform estimates.

P(w | u) = a(b) c(u w) / c(u) + k(b) c(w) / N + z(b) / (V + 1), where b is the bucket floor(log2 c(u)) of
the context's frequency. The weights of each bucket come from expectation-maximisation on deleted
documents: every training document, seen by counts that leave itself out. Without any the weights stay
as they begin.
Estimates for EM are gathered as counts over quarter-octave cells of the two estimates, which is a table
of bounded size over all deleted tokens.

Counts never leave the executors: blocks of about BLOCK_BYTES of text send their distinct token and
bigram keys to shards of the key space, which add them up and answer with totals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import scan
from sightline.llm.exchange import cuts, pack, release, unpack
from sightline.llm.native import shared_checkpoints, table, text_of

BLOCK_BYTES = 8 << 20
BUCKETS = 40
SHARDS = 4  # of the key space for each shuffle partition: messages grow with the blocks, not with their square
CELL = 4
NONE = -(1 << 20)
EMPTY = 4095  # an estimate of 0 among quantised ones, which stay below 4 * 64
FOLDS, HELD_OUT = 10, 0
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_LOWERED = scan.BYTES[scan.LOWER]


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of all texts, each text ended by END, and where each text starts (with the end)."""
    data, offsets = scan.buffers(texts)
    keys, first = [], [0]
    for a, b in scan.pieces(offsets):
        part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, stop, begin = scan.words(part, offs, scan.VISIBLE)
        hashed = scan.span_hash(scan.prefix(part, _LOWERED), start, stop)
        out = np.full(len(hashed) + b - a, END, np.uint64)
        out[np.arange(len(hashed)) + np.repeat(np.arange(b - a), np.diff(begin))] = hashed
        keys.append(out)
        first += (begin[1:] + np.arange(1, b - a + 1) + first[-1]).tolist()
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.array(first)


def bigrams(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[first[:-1]] = BEGIN
    return scan.mix(before * np.uint64(0xA24BAED4963EE407) + keys)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


_REQUEST = "kind int, shard int, block long, keys binary, counts binary"
_ANSWER = "kind int, shard int, block long, counts binary, total long, known long"


def _request(shards: int):
    def ask(block: pa.Table) -> pa.Table:
        keys, first = tokens(block["text"])
        weight = np.repeat(block["train"].to_numpy().astype(np.float64), np.diff(first))
        rows = []
        for kind, x in enumerate((keys, bigrams(keys, first))):
            u, inverse = _distinct(x)
            n = np.bincount(inverse, weights=weight, minlength=len(u)).astype(np.uint64)
            rows += [(kind, s, block["block"][0].as_py(), pack(u[a:b]), pack(n[a:b])) for s, a, b in cuts(u, shards)]
        return pa.table(dict(zip(("kind", "shard", "block", "keys", "counts"), zip(*rows))), schema=pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return ask


def _answer(shard: pa.Table) -> pa.Table:
    asked = [unpack(x.as_py(), np.uint64) for x in shard["keys"]]
    u, inverse = _distinct(np.concatenate(asked))
    n = np.bincount(inverse, weights=np.concatenate([unpack(x.as_py(), np.uint64) for x in shard["counts"]]).astype(np.float64), minlength=len(u)).astype(np.uint64)
    at = np.cumsum([0, *map(len, asked)])
    m = len(asked)
    return pa.table({
        "kind": shard["kind"], "shard": shard["shard"], "block": shard["block"],
        "counts": pa.array([pack(n[inverse[at[i] : at[i + 1]]]) for i in range(m)], pa.binary()),
        "total": pa.array([int(n.sum())] + [0] * (m - 1), pa.int64()), "known": pa.array([int((n > 0).sum())] + [0] * (m - 1), pa.int64()),
    })


def _looked_up(docs: pa.Table, answers: pa.Table):
    """Keys and their totals for every token of a block."""
    keys, first = tokens(docs["text"])
    order = np.lexsort((answers["shard"].to_numpy(), answers["kind"].to_numpy()))
    kinds = answers["kind"].to_numpy()[order]
    raw = answers["counts"].take(pa.array(order))
    own, two = [], []
    for kind, out in ((0, own), (1, two)):
        out += [unpack(raw[int(i)].as_py(), np.uint64) for i in np.flatnonzero(kinds == kind)]
    u, inverse = _distinct(keys)
    b, binverse = _distinct(bigrams(keys, first))
    return first, inverse, binverse, np.concatenate(own)[inverse].astype(np.float64), np.concatenate(two)[binverse].astype(np.float64)


def _contexts(count: np.ndarray, first: np.ndarray, n_docs) -> np.ndarray:
    before = np.empty_like(count)
    before[1:] = count[:-1]
    before[first[:-1]] = n_docs
    return before


def bucket_of(contexts: np.ndarray) -> np.ndarray:
    return np.where(contexts > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(contexts, 1)))), 0).astype(np.int64)


def _cells(total: int, n_docs: int):
    def gather(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Cells of a block's training tokens. Texts held out have asked for their keys too, so they are looked up with the others and left out after."""
        train = docs["train"].to_numpy()
        first, inverse, binverse, one, two = _looked_up(docs, answers)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))

        def own(x: np.ndarray) -> np.ndarray:
            _, at, n = np.unique(doc * (x.max() + 1) + x, return_inverse=True, return_counts=True)
            return n[at]

        mine = own(inverse).astype(np.float64)
        context = np.maximum(_contexts(one, first, n_docs) - _contexts(mine, first, 1), 0)
        p1 = np.maximum(one - mine, 0) / np.maximum(total - np.repeat(np.diff(first), np.diff(first)), 1)
        p2 = np.maximum(two - own(binverse), 0) / np.maximum(context, 1)
        q1, q2 = (np.where(p > 0, -np.rint(CELL * np.log2(np.where(p > 0, p, 1))), EMPTY).astype(np.int64) for p in (p1, p2))
        packed = (bucket_of(context) << 24 | q1 << 12 | q2)[np.repeat(train, np.diff(first))]
        cells, n = np.unique(packed, return_counts=True)
        one_cell, two_cell = (np.where(q == EMPTY, NONE, -q) for q in (cells >> 12 & 4095, cells & 4095))
        return pa.table({"b": cells >> 24, "one": one_cell, "two": two_cell, "n": n.astype(np.int64)})

    return gather


def learn_weights(cells, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3): weights of the bigram, unigram and uniform estimates by EM. Buckets without deleted tokens take those of the nearest below."""
    out = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    out[0] = last = np.array([0.0, 0.9, 0.1])
    if not len(cells):
        return out
    for b in range(BUCKETS):
        rows = np.array([(one, two, n) for bb, one, two, n in cells if bb == b], np.float64).reshape(-1, 3)
        if len(rows):
            p = np.stack([np.where(rows[:, 1] == NONE, 0, 2.0 ** (rows[:, 1] / CELL)), np.where(rows[:, 0] == NONE, 0, 2.0 ** (rows[:, 0] / CELL)), np.full(len(rows), 1 / (vocabulary + 1))], axis=1)
            w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
            for _ in range(rounds):
                share = p * w
                share *= (rows[:, 2] / share.sum(axis=1))[:, None]
                w = share.sum(axis=0) / rows[:, 2].sum()
            w = np.maximum(w, [0, 0, 1e-6])
            last = w / w.sum()
        out[b] = last
    return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(total: int, known: int, n_docs: int, weights: list):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        first, _, _, one, two = _looked_up(docs, answers)
        context = _contexts(one, first, n_docs)
        w = np.array(weights)[bucket_of(context)]
        p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(total, 1) + w[:, 2] / (known + 1)
        base = np.log10((one + 0.1) / (total + 0.1 * (known + 1)))
        at = first[:-1]
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": np.diff(first), "n_known": np.add.reduceat((one > 0).astype(np.int64), at),
            "train_tokens": np.full(len(at), total, np.int64), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at),
        })

    return score


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, np.ndarray]:
    """(one row for each input row, the mixture weights).

    Null and empty texts are one end token. A null id trains. Repeated rows count as often as they
    stand. An empty table gives no rows; other columns of docs are left out. A text of any length is one
    row of its block, which is scored as a whole.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    fold = F.crc32(F.col(doc_id).cast("string")) % FOLDS
    x = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), F.coalesce(fold, F.lit(FOLDS)).alias("fold"))
    size, n_docs = x.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(F.col("fold") != HELD_OUT, 1))).first()
    blocks = max(1, math.ceil(size / block_bytes))
    shards = SHARDS * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    h = F.xxhash64("doc_id", "text")
    x = x.select(
        "doc_id", "text", (F.col("fold") != HELD_OUT).alias("train"), (F.col("fold") == HELD_OUT).alias("held_out"), F.pmod(h, F.lit(blocks)).alias("block"),
    )
    answers = x.groupBy("block").applyInArrow(_request(shards), _REQUEST).groupBy("kind", "shard").applyInArrow(_answer, _ANSWER).checkpoint()
    total, known = answers.filter("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    release(spark)
    told = answers.select("kind", "shard", "block", "counts")
    cells = x.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cells(total, n_docs), "b long, one long, two long, n long").groupBy("b", "one", "two").agg(F.sum("n").alias("n"))
    weights = learn_weights([tuple(r) for r in cells.collect()], known)
    del cells  # its shuffle files stay while it can be reached
    release(spark)
    out = x.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(total, known, n_docs, weights.tolist()), _SCORED)
    return out, weights


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every document. A null or empty text has the end token alone, a row with a null id trains, repeated rows repeat; a text of any length is scored whole and an empty table gives no rows."""
    return score(table(spark, sf_dir, "documents"))[0]
