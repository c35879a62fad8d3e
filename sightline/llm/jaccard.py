"""N-gram Jaccard join: exact set similarity over distinct word shingles.

A partition of the shingle universe cuts every set into segments, three to a group. Two sets of a size
band whose similarity reaches the threshold differ in at most H shingles, so with H // 2 + 1 + slack
groups at least slack + 1 groups hold one difference or none, and there two of the three segments are
equal: each pair of segments of a group is a signature. Where it is cheaper, a band takes undivided groups
and indexes their one-deletion neighbourhoods instead, which finds a group with one difference too.
``plan_of`` chooses by estimated cost. A set could be missed by another set alone in which more groups
than the slack are too empty to be signed; these sets are indexed again under another partition, and
after ROUNDS partitions by each shingle, so nothing is missed.

Candidates meet in buckets, in shards of the signature space. Each step reports what connects texts, one edge
a text, never pairs. Buckets are sifted by sketches: the counts of a set's shingles in BINS bins, whose distance
never exceeds the sets' difference, so a pair whose sketches differ by more than the threshold allows is no
link. Buckets go to lots by their smallest member, those of one smallest member to one lot for each LOT of
them, so the buckets of one cluster meet in few lots. Members of
a bucket beyond LIST (HOT within a block of texts) are taken as connected without a sift, which only makes
the clusters larger. Clusters are verified on the whole texts: a text's common shingles with all
others come from an inverted index, and texts that are known to be connected aren't compared again. A cluster
beyond BLOCK_SHINGLES is cut into blocks, which share two pivots; the texts that this doesn't connect with the
main part of their cluster then meet all its blocks. So a task's size is bounded, a cluster of close copies
costs what it holds, and no link is lost.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm import scan
from sightline.llm.components import components
from sightline.llm.exchange import cuts, pack, release, unpack
from sightline.llm.native import few_files, member_filter, shared_checkpoints, small_batches, spare, table, text_of

GROWTH = 1.5
ROUNDS = 3
HOT = 64
LIST = 1000
FEW = 100_000
LOT = 64
BINS = 256
BLOCK_SHINGLES = 1_000_000  # some 100 MB in the task that verifies them
BLOCK_BYTES = 20 << 20
BATCH_BYTES = 4 << 20
SLICES = 16  # of the signatures of a block
_U = np.uint64
_LOWERED = scan.BYTES[scan.LOWER]
_STEPS = np.array([pow(0xC6BC279692B5C323, i + 1, 2**64) for i in range(64)], _U)
_PLACE = 54


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of each text, sorted, and where each text's start (with the end). Texts with fewer words have their whole sequence."""
    out, first = [], [np.zeros(1, np.int64)]
    done = 0
    for a, b in scan.pieces(offsets):
        for c in range(a, b, 1000):
            d = min(c + 1000, b)
            part, offs = data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]
            start, stop, begin = scan.words(part, offs, scan.VISIBLE)
            h = scan.span_hash(scan.prefix(part, _LOWERED), start, stop)
            n = np.diff(begin)
            doc = np.repeat(np.arange(d - c), n)
            m = max(len(h) - size + 1, 0)
            key = np.zeros(m, _U)
            for i in range(size):
                key += h[i : i + m] * _STEPS[i]
            inside = doc[:m] == doc[size - 1 :] if m else np.zeros(0, bool)
            key, owner = key[inside], doc[:m][inside]
            short = np.flatnonzero((n > 0) & (n < size))
            if len(short):
                whole = np.array([np.sum(h[begin[i] : begin[i + 1]] * _STEPS[: n[i]]) + _U(n[i]) for i in short], _U)
                key, owner = np.append(key, whole), np.append(owner, short)
            key = np.sort((owner.astype(_U) << _U(_PLACE)) | (scan.mix(key) >> _U(64 - _PLACE)))
            key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
            first.append(np.searchsorted(key >> _U(_PLACE), np.arange(1, d - c + 1)) + done)
            done += len(key)
            out.append(key & _U((1 << _PLACE) - 1))
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.concatenate(first)


@functools.cache
def bands() -> np.ndarray:
    low = [1]
    while low[-1] < 1 << 32:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    return np.array(low)


@functools.cache
def plan_of(band: int, percent: int) -> tuple[int, int, int]:
    """(groups, slack, segments of a group) for sets below the next band's smallest size; one segment means one-deletion neighbourhoods, no group the whole set only."""
    low, top = int(bands()[band]), int(bands()[band + 1]) - 1
    most = 2 * top * (100 - percent) // (100 + percent)
    if not most:
        return 1, 0, 0
    need = most // 2 + 1
    whole_slack = 0 if need == 1 else 1 + need // 8
    split_slack = 2 + need // 12

    def cost(signatures: float, shingles_each: float) -> float:
        return signatures * (1 + 64 * 4.0**-shingles_each)

    smallest = low * percent / 100
    whole = cost(top + need + whole_slack, smallest / (need + whole_slack) - 1)
    split = cost(3 * (need + split_slack), smallest * 2 / 3 / (need + split_slack))
    return (need + whole_slack, whole_slack, 1) if whole < split else (need + split_slack, split_slack, 3)


def signatures(keys: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number): two sets that reach the similarity share one."""
    n = np.diff(first)
    low = bands()
    own = np.searchsorted(low, n, "right") - 1
    found = []
    for step in range(len(low)):  # a set is signed in its own band and in all above that hold sets it can be linked with
        band = np.minimum(own + step, len(low) - 2)
        which = np.flatnonzero((n > 0) & (band == own + step) & ((step == 0) | (100 * n >= percent * low[band])))
        if not len(which):
            break
        _sign(keys, first, which, band[which], percent, found)
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([d for _, d in found])


def _sign(keys, first, which, band, percent, found) -> None:
    for rounds in range(ROUNDS + 1):
        if not len(which):
            return
        n = first[which + 1] - first[which]
        item = np.repeat(np.arange(len(which)), n)
        token = keys[np.repeat(first[which], n) + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)]
        salt = scan.mix(band.astype(_U) * _U(1000) + _U(rounds))
        if rounds == ROUNDS:
            found.append((scan.mix(token + salt[item]), which[item]))
            return
        plans = {b: plan_of(int(b), percent) for b in np.unique(band)}
        m, slack, parts = (np.array([plans[b][i] for b in band]) for i in range(3))
        base = np.cumsum(m) - m
        at = scan.mix(token ^ salt[item])
        cells = m * np.maximum(parts, 1)
        cell = (((at >> _U(32)) * cells[item].astype(_U)) >> _U(32)).astype(np.int64)  # the segment in its set
        value = scan.mix(at + _U(0x632BE59BD9B4E019))
        split = parts[item] == 3
        weak = np.zeros(len(which), np.int64)
        for kind in (False, True):
            rows = np.flatnonzero(split == kind)
            if not len(rows):
                continue
            width = 3 if kind else 1
            place = base[item[rows]] * width + cell[rows]
            order = np.argsort(place, kind="stable")
            rows, place = rows[order], place[order]
            heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            size = np.diff(np.append(heads, len(place)))
            owner = item[rows[heads]]
            group = cell[rows[heads]] // width
            mark = scan.mix(salt[owner] + group.astype(_U) * _U(0x9E6C63D0876A9A47))
            total = np.add.reduceat(value[rows], heads)
            if kind:
                where, row = np.unique(base[owner] + group, return_inverse=True)
                sums = np.zeros((len(where), 3), _U)
                sums[row, cell[rows[heads]] % 3] = total
                marks, owners = np.empty(len(where), _U), np.empty(len(where), np.int64)
                marks[row], owners[row] = mark, owner
                full = sums != 0
                for i, j in ((0, 1), (0, 2), (1, 2)):
                    signed = full[:, i] | full[:, j]
                    found.append((scan.mix(scan.mix(sums[signed, i] + _U(i + 1)) + sums[signed, j] * _U(2 * j + 1) + marks[signed]), which[owners[signed]]))
                strong = np.bincount(owners[full.sum(axis=1) > 1], minlength=len(which))
            else:
                found.append((scan.mix(total ^ mark), which[owner]))
                wide = np.repeat((parts[owner] == 1) & (size > 1), size)
                if wide.any():
                    less = np.repeat(total, size)[wide] - value[rows][wide]
                    found.append((scan.mix(less ^ np.repeat(mark, size)[wide]), which[item[rows[wide]]]))
                strong = np.bincount(owner[(size > 1) | (parts[owner] == 0)], minlength=len(which))
            mine = np.isin(parts, (3,) if kind else (0, 1))
            weak[mine] = (m - strong)[mine]
        again = weak > slack
        which, band = which[again], band[again]


_SENT = "shard int, part binary, sketches binary"
_MET = "kind int, a long, b long, raw binary"


def _send(shards: int, size: int, percent: int, hot: int):
    def batch_of(rows: list) -> pa.RecordBatch:
        shard, part, extra = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(part, pa.binary()), pa.array(extra, pa.binary())], names=["shard", "part", "sketches"])

    def flush(held: list):
        doc, n, one, two = (np.concatenate(x) for x in zip(*[h[:4] for h in held]))
        order = np.lexsort((doc, two, one))
        same = np.zeros(len(order), bool)
        same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]) & (n[order][1:] > 0)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        kin = np.empty(len(order), np.int64)
        kin[order] = doc[order][head]
        alone = np.empty(len(order), bool)
        alone[order] = ~same
        at = np.cumsum([0, *(len(h[0]) for h in held)])
        limits = (np.arange(1, SLICES) << 32) // SLICES
        ends = [[0, *np.searchsorted(h[4] >> _U(32), limits.astype(_U)), len(h[4])] for h in held]
        edges, rows, weight = [np.zeros((2, 0), np.int64)], [], 0
        for i in range(SLICES):  # a slice of the signatures at a time, so that sorting takes little
            sig = np.concatenate([h[4][e[i] : e[i + 1]] for h, e in zip(held, ends)])
            row = np.concatenate([h[5][e[i] : e[i + 1]] + x for h, e, x in zip(held, ends, at)])
            use = alone[row]
            sig, who = sig[use], doc[row[use]]
            if not len(sig):
                continue
            order = np.argsort(sig, kind="stable")
            sig, who = sig[order], who[order]
            heads = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            times = np.diff(np.append(heads, len(sig)))
            least = np.repeat(np.minimum.reduceat(who, heads), times)
            many = np.repeat(times > hot, times)
            edges.append(np.unique(np.stack([who[many], least[many]]), axis=1))
            sent = ~many | (who == least)
            sig, who = sig[sent], who[sent]
            for s, a, b in cuts(sig, shards):
                rows.append((s, pack(np.stack([sig[a:b], who[a:b].view(_U)]).reshape(-1)), None))
                weight += len(rows[-1][1])
                if weight >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, weight = [], 0
        own = -1 - int(one[0] % _U(shards))
        rows.append((own, pack(np.unique(np.concatenate(edges, axis=1), axis=1).reshape(-1).view(_U)), None))
        sketches = np.concatenate([h[6] for h in held])
        rows.append((own, pack(np.stack([doc, n, kin]).reshape(-1).view(_U)), pack(sketches.reshape(-1))))
        yield batch_of(rows)

    def go(batches):
        held, weight = [], 0
        for batch in batches:
            data, offsets = scan.buffers(batch.column("text"))
            doc = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in scan.pieces(offsets):
                keys, first = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.diff(first)
                sums = [np.zeros(len(n), _U), np.zeros(len(n), _U)]
                some = np.flatnonzero(n)
                if len(some):
                    for at, salt in enumerate((_U(0x8CB92BA72F3D8DD7), _U(0xAB5F6C1D2E3F4A5B))):
                        sums[at][some] = np.add.reduceat(scan.mix(keys + salt), first[:-1][some])
                sig, row = signatures(keys, first, percent)
                order = np.argsort(sig)
                bins = np.bincount(np.repeat(np.arange(b - a), n) * BINS + (keys % _U(BINS)).astype(np.int64), minlength=(b - a) * BINS)
                held.append((doc[a:b], n, *sums, sig[order], row[order].astype(np.int32), np.minimum(bins, 255).astype(np.uint8).reshape(-1, BINS)))
                weight += int(offsets[b] - offsets[a])
                if weight >= BLOCK_BYTES:
                    yield from flush(held)
                    held, weight = [], 0
        if held:
            yield from flush(held)

    return go


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges (u, v) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _table(kind, a, b, raw=None) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(len(a), kind), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "raw": pa.array(raw or [None] * len(a), pa.binary())})


def _meet(most: int):
    """kind 0: a and b are connected; kind 1: document a has b shingles and a sketch; kind 2: members of a bucket, a being the smallest; kind 3: a and b are the same set; kind 4: a bucket of a < b."""

    def go(shard: pa.Table) -> pa.Table:
        if shard["shard"][0].as_py() < 0:
            out = []
            for part, sketches in zip(shard["part"], shard["sketches"]):
                if sketches.is_valid:
                    doc, n, kin = unpack(part.as_py(), _U).reshape(3, -1).view(np.int64)
                    flat = unpack(sketches.as_py(), np.uint8).tobytes()
                    out += [_table(1, doc, n, [flat[i : i + BINS] for i in range(0, len(flat), BINS)]), _table(3, doc[doc != kin], kin[doc != kin])]
                else:
                    out.append(_table(0, *unpack(part.as_py(), _U).reshape(2, -1).view(np.int64)))
            return pa.concat_tables(out)
        parts = [unpack(p.as_py(), _U) for p in shard["part"]]
        sig, who = np.concatenate([p.reshape(2, -1) for p in parts], axis=1)
        who = who.view(np.int64)
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (who[1:] != who[:-1]))
        sig, who = sig[fresh], who[fresh]
        heads = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        n = np.diff(np.append(heads, len(sig)))
        two = heads[n == 2]
        pairs = np.unique(np.stack([who[two], who[two + 1]]), axis=1)
        lists = sorted({who[h : h + k].tobytes() for h, k in zip(heads[(n > 2) & (n <= most)], n[(n > 2) & (n <= most)])})
        least = np.array([np.frombuffer(x, np.int64, 1)[0] for x in lists], np.int64)
        large = np.repeat(n > most, n)
        edges = np.unique(np.stack([who[large], np.repeat(who[heads], n)[large]]), axis=1)
        return pa.concat_tables([_table(4, *pairs), _table(2, least, least, lists), _table(0, *edges)])

    return go


def _members(batches):
    """(lot, doc) of the members of each list, once a lot and batch."""
    for batch in batches:
        lot = batch.column("lot").to_numpy(zero_copy_only=False)
        lists = [np.frombuffer(x, np.int64) for x in batch.column("raw").to_pylist()]
        for i in range(0, len(lists), 1000):
            n = [len(x) for x in lists[i : i + 1000]]
            both = np.unique(np.stack([np.repeat(lot[i : i + 1000], n), np.concatenate(lists[i : i + 1000])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["lot", "doc"])


def _join_labels(label: np.ndarray, members: np.ndarray) -> None:
    """The components of the members become one, in place."""
    old = np.unique(label[members])
    if len(old) > 1:
        label[np.isin(label, old)] = old[0]


def _sift(percent: int):
    """One edge (u, v) for each text that pairs within the sketch bound connect, over the buckets of a lot; its texts come once."""

    def go(buckets: pa.Table, texts: pa.Table) -> pa.Table:
        doc = texts["doc"].to_numpy()
        order = np.argsort(doc)
        ids, n = doc[order], texts["n"].to_numpy()[order]
        sketch = np.frombuffer(b"".join(texts["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)[order]

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            distance = np.abs(sketch[i].astype(np.int16) - sketch[j]).sum(axis=1)
            return (distance * (100 + percent) <= (n[i] + n[j]) * (100 - percent)) | (n[i] < 0) | (n[j] < 0)

        pairs = buckets.filter(buckets["raw"].is_null())
        i, j = (np.searchsorted(ids, pairs[c].to_numpy()) for c in ("a", "b"))
        two = np.concatenate([x[near(i[x], j[x])] for x in np.array_split(np.arange(len(i)), len(i) // 10_000 + 1)])
        label = _labels(len(ids), i[two], j[two])
        for raw in buckets["raw"].drop_null().to_pylist():
            rows = np.searchsorted(ids, np.frombuffer(raw, np.int64))
            for i in rows[:-1]:
                others = rows[label[rows] != label[i]]  # those that it is connected with need no look
                if not len(others):
                    break
                close = others[near(np.full(len(others), i), others)]
                if len(close):
                    _join_labels(label, np.append(close, i))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[moved], pa.int64()), "v": pa.array(ids[label[moved]], pa.int64())})

    return go


def _few(x: DataFrame) -> DataFrame:
    return F.broadcast(x) if x.count() <= FEW else x  # counted


def candidates(met: DataFrame, lots: int, percent: int, files: int) -> DataFrame:
    """Edges (u, v) that connect at least what pairs within the sketch bound connect."""
    pairs = met.filter("kind = 4").select("a", "b").distinct().select(F.pmod(F.xxhash64("a"), F.lit(lots)).alias("lot"), "a", "b", F.lit(None).cast("binary").alias("raw"))
    lists = met.filter("kind = 2").select("a", "b", "raw")
    heavy = _few(lists.groupBy("a").agg(F.ceil(F.count("*") / LOT).alias("parts")).filter("parts > 1").coalesce(files).checkpoint())
    part = F.pmod(F.xxhash64("raw"), F.coalesce("parts", F.lit(1)))
    lists = lists.dropDuplicates(["raw"]).join(heavy, "a", "left").select(F.pmod(F.xxhash64("a", part), F.lit(lots)).alias("lot"), "a", "b", "raw")
    members = lists.select("lot", "raw").mapInArrow(_members, "lot long, doc long").unionByName(pairs.select("lot", F.explode(F.array("a", "b")).alias("doc"))).distinct()
    sketches = met.filter("kind = 1").groupBy(F.col("a").alias("doc")).agg(
        F.min("b").alias("n"), F.first("raw").alias("sketch"), F.min(F.xxhash64("raw")).alias("h"), F.max(F.xxhash64("raw")).alias("other")
    )
    sketches = sketches.select("doc", F.when(F.col("h") == F.col("other"), F.col("n")).otherwise(-1).alias("n"), "sketch")  # an id with several texts is near all
    texts = members.join(sketches, "doc").groupBy("lot")
    sifted = pairs.unionByName(lists).groupBy("lot").cogroup(texts).applyInArrow(_sift(percent), "u long, v long")
    return sifted.unionByName(met.filter("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))


def _verify(size: int, percent: int):
    """Links among texts, or with a side between those of side 1 and those of side 0: one edge (u, v) for each text that they connect."""

    def check(group: pa.Table) -> pa.Table:
        data, offsets = scan.buffers(group["text"])
        keys, first = shingles(data, offsets, size)
        n = np.diff(first)
        doc, side = group["doc"].to_numpy(), group["side"].to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(keys, kind="stable")
        sorted_keys, owner_of = keys[order], owner[order]
        head = np.append(True, sorted_keys[1:] != sorted_keys[:-1]) if len(keys) else np.zeros(0, bool)
        heads = np.flatnonzero(head)
        df = np.diff(np.append(heads, len(keys)))
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(head) - 1
        label = _labels(len(n), *_same_ids(doc))
        cross = bool(side.any())
        waiting = ((side == 1) | (not cross)) & (n > 0)
        while waiting.any():
            ends = np.flatnonzero(waiting)
            if not cross:
                kinds, times = np.unique(label[ends], return_counts=True)
                if len(kinds) == 1:
                    break  # all that haven't been compared with every other text are connected
                ends = ends[label[ends] != kinds[times.argmax()]]
            d = int(ends[0])
            waiting[d] = False
            token = number[first[d] : first[d + 1]]
            token = token[df[token] > 1]
            if not len(token):
                continue
            length = df[token]
            at = np.repeat(heads[token] - np.cumsum(length) + length, length) + np.arange(length.sum())
            common = np.bincount(owner_of[at], minlength=len(n))
            near = (100 * common >= percent * (n + n[d] - common)) & (common > 0)
            if cross:
                near &= side == 0
            near[d] = True
            _join_labels(label, np.flatnonzero(near))
        moved = np.flatnonzero(doc[label] != doc)
        return pa.table({"component": pa.array(np.full(len(moved), group["component"][0].as_py()), pa.int64()), "u": pa.array(doc[moved], pa.int64()), "v": pa.array(doc[label[moved]], pa.int64())})

    return check


def _same_ids(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(doc, kind="stable")
    same = np.flatnonzero(doc[order][1:] == doc[order][:-1])
    return order[same], order[same + 1]


_LINKS = "component long, u long, v long"


def verified(edges: DataFrame, texts: DataFrame, sizes: DataFrame, size: int, percent: int, files: int, most: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (u, v) that connect what links connect, among the clusters of edges (u, v)."""

    def spot(c: str):
        return F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")

    clusters = components(edges, files=files).join(sizes, F.col("node") == F.col("doc")).select("doc", "n", "component").coalesce(files).checkpoint()
    pivots = (F.min_by("doc", F.xxhash64("doc")).alias("p"), F.max_by("doc", F.xxhash64("doc")).alias("q"))
    big = clusters.groupBy("component").agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"), *pivots).filter("blocks > 1").coalesce(files).checkpoint()
    big = _few(big)
    placed = clusters.join(big, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", spot("blocks"))
    some = member_filter(texts, "doc", clusters, "doc")
    everywhere = F.col("doc").isin(F.col("p"), F.col("q"))
    spread = placed.select("component", "doc", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("block"))
    rows = some.join(_few(spread.coalesce(files).checkpoint()), "doc").select("component", "block", "doc", F.lit(0).alias("side"), "text")
    links = rows.groupBy("component", "block").applyInArrow(_verify(size, percent), _LINKS).coalesce(files).checkpoint()
    if not big.take(1):
        return links.select("u", "v")
    whole = placed.filter("blocks > 1").select("component", "doc", "n", "blocks", "own").coalesce(files).checkpoint()
    parts = components(links.join(big.select("component"), "component", "left_semi").select("u", "v"), files=files)
    whole = whole.join(parts.select(F.col("node").alias("doc"), F.col("component").alias("sub")), "doc", "left").withColumn("sub", F.coalesce("sub", "doc")).coalesce(files).checkpoint()
    main = whole.groupBy("component", "sub").agg(F.count("*").alias("c")).groupBy("component").agg(F.max_by("sub", F.struct("c", "sub")).alias("main"), F.count("*").alias("subs"))
    main = _few(main.filter("subs > 1").coalesce(files).checkpoint())
    rest = whole.join(main, "component").filter("sub != main").select("component", "doc", "n", "blocks")
    apart = _few(rest.groupBy("component").agg(F.ceil(F.sum("n") / most).cast("int").alias("lots")).coalesce(files).checkpoint())
    if not apart.take(1):
        return links.select("u", "v")
    one = rest.join(apart, "component").select("component", "doc", F.lit(1).alias("side"), spot("lots").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    all_ = whole.join(apart, "component").select("component", "doc", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("i"), F.col("own").alias("j"))
    crossed = some.join(_few(one.unionByName(all_).coalesce(files).checkpoint()), "doc").groupBy("component", "i", "j").applyInArrow(_verify(size, percent), _LINKS)
    return links.select("u", "v").unionByName(crossed.select("u", "v"))


def join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, hot: int = HOT, longest: int = LIST, block: int = BLOCK_SHINGLES
) -> DataFrame:
    """(doc, n_shingles, component), one row for each input row: component is the smallest id reachable by links.

    Two texts are linked if 100 * common >= percent * union over their distinct shingles of size words.
    Texts without words are linked with nothing. Rows with the same id are one node; a row without
    an id is linked with nothing and has no component. An empty table gives no rows. hot, longest and block
    say from which size on buckets and clusters are worked on in parts; the result doesn't depend on them.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    small_batches(spark)
    x = docs.select(F.col(doc_id).cast("long").alias("doc"), text_of(text).alias("text"))
    named = x.filter(F.col("doc").isNotNull())
    parts, files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), few_files(docs)
    # a shard is unpacked as a whole, so there are several to a partition
    met = named.mapInArrow(_send(4 * parts, size, percent, hot), _SENT).groupBy("shard").applyInArrow(_meet(longest), _MET).coalesce(files).checkpoint()
    release(spark)
    info = met.filter("kind = 1").select(F.col("a").alias("doc"), F.col("b").alias("n"))
    sizes = info.groupBy("doc").agg(F.max("n").alias("n"))
    same = met.filter("kind = 3").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = verified(candidates(met, 8 * parts, percent, files), named, sizes, size, percent, files, block)
    found = components(links.unionByName(same), files=files)
    release(spark)
    counted = x.filter(F.col("doc").isNull()).mapInArrow(_count(size), "doc long, n long")
    return info.join(found, F.col("doc") == F.col("node"), "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component")).unionByName(
        counted.select("doc", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"))
    )


def _count(size: int):
    def go(batches):
        for batch in batches:
            _, first = shingles(*scan.buffers(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.diff(first), pa.int64())], names=["doc", "n"])

    return go


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document. A null or empty text has no shingles and is alone, copies are linked, rows of one id or none are told apart; a text of any length counts whole, an empty table gives no rows."""
    out = join(table(spark, sf_dir, "documents"), size=4, percent=85)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with their own columns, whatever these are named.

    Of rows that repeat an id, the first by text and then the other plain columns stays. Rows without an
    id stay. Null, empty and wordless texts are linked with nothing and stay. An empty table stays empty.
    """
    key, rank = spare(docs.columns, "keep_key", "keep_rank")
    own = F.col(doc_id).cast("long")
    files = few_files(docs)
    found = join(docs, doc_id, text, size, percent)
    gone = found.filter(F.col("component") != F.col("doc")).select(F.col("doc").alias(key)).distinct().coalesce(files).checkpoint()
    again = docs.filter(own.isNotNull()).groupBy(own.alias(key)).count().filter("count > 1").select(key).coalesce(files).checkpoint()
    named = docs.filter(own.isNotNull())
    special = gone.unionByName(again)
    plain = [c for c, t in docs.dtypes if c not in (doc_id, text) and t in ("string", "bigint", "int", "double")]
    once = Window.partitionBy(own).orderBy(text, *plain)
    looked_at = member_filter(named, own, special, key).join(gone, own == F.col(key), "left_anti")
    looked_at = looked_at.withColumn(rank, F.row_number().over(once)).filter(F.col(rank) == 1)
    sure = member_filter(named, own, special, key, wanted=False)
    return sure.unionByName(looked_at.select(*docs.columns)).unionByName(docs.filter(own.isNull())).coalesce(files)
