"""Suffix-array dedup: every byte covered by a string of SIZE bytes that also starts anywhere else.

Which suffixes are sorted. A window of SIZE bytes has one anchor, the place of the smallest hash among
its runs of RUN bytes (the leftmost of equal ones). Equal windows have equal anchors at equal
distances, so windows need only be compared under the same anchor run. Neighbouring windows with the
same anchor form one stretch; a stretch carries the hash of its anchor run and that of all its bytes.

1. Scan: stretches of each block of texts. Stretches that repeat within the block are known at once,
   and one of each kind goes on, so a common passage is sent once a block however many texts hold it.
2. Shards of the hash space meet the blocks' stretches. A stretch that occurs twice as a whole is
   repeated as a whole. One whose anchor run occurs elsewhere with other surroundings is partial.
3. Partial stretches fetch their bytes. Sampled splitters deal them out in ranges by the tokens that
   lead their anchor suffix. A boundary is a splitter's lead and equal leads go to one range, so
   comparing across a boundary always finds different leads: no repeat lies across one.
   Stretches of an anchor with more than HOT kinds of surroundings are cut first, by the distance of the
   anchor from the window's start, into pieces of at most WIDTHS[0] windows, in turn WIDTHS[1]. All
   windows of a piece share SIZE - width + 1 bytes, which are the piece's anchor run, and pieces meet in
   step 2 as stretches do; a piece alone under its run is done. So neither a common anchor nor a common
   window fills a range, and a common line goes on with the few pieces that lie about its ends.
4. Each range sorts the suffixes that start at its windows by multikey quicksort over 8-byte
   characters: one pivot a group and round, groups split into less, equal and greater, equal ones move
   to the next character. Groups that stay equal for SIZE bytes are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import scan
from sightline.llm.exchange import cuts, pack, unpack
from sightline.llm.native import few_files, member_filter, shared_checkpoints, small_batches, spare, table, text_of

SIZE = 200
RUN = 73
SPREAD = SIZE - RUN + 1  # runs in a window; a power of two
BLOCK_BYTES = 16 << 20
BLOCK_PIECES = 1 << 18
RANGE_BYTES = 3 << 20
HOT = 500
WIDTHS = (8, 1)  # windows in a piece of a stretch under a hot anchor; each divides the one before and SPREAD
GROUPS = 4  # shards of hashes for each shuffle partition; a task holds one at a time
_U = np.uint64
_PLACE = _U((1 << 20) - 1)


def stretches(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """doc (number), start, length, lead (distance of the anchor from start), run and whole (hashes) of each stretch."""
    found = []
    for a, b in scan.pieces(offsets):
        base, stop = int(offsets[a]), int(offsets[b])
        for low in range(base, max(base + 1, stop - SIZE + 1), 1 << 19):  # windows that start at low and on; only a very long text has more than one round
            high = min(low + (1 << 19), stop - SIZE + 1)
            if high > low:
                found.append(_stretches(data[low : high + SIZE - 1], offsets[a : b + 1] - low, high - low, a, low))
    names = ("doc", "start", "length", "lead", "run", "whole")
    if not found:
        return {n: np.zeros(0, _U if n in ("run", "whole") else np.int64) for n in names}
    out = {n: np.concatenate([f[i] for f in found]) for i, n in enumerate(names)}
    out["start"] -= offsets[:-1][out["doc"]]
    return out


def _stretches(data: np.ndarray, offsets: np.ndarray, n: int, first_doc: int, shift: int):
    p = scan.prefix(data)
    m = len(data) - RUN + 1
    runs = scan.mix((p[RUN:] - p[:m]) * scan.powers(m)[1])
    least = (runs & ~_PLACE) | np.arange(m, dtype=_U)
    width = 1
    while width < SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    anchor = (least[:n] & _PLACE).astype(np.int64)
    own = np.diff(np.clip(offsets, 0, n))
    doc = np.repeat(np.arange(len(own)), own)
    inside = np.arange(n) + SIZE <= np.repeat(offsets[1:], own)
    edge = np.ones(n, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(edge)
    stops = np.append(starts[1:], n)
    keep = inside[starts]
    starts, stops = starts[keep], stops[keep] - 1 + SIZE
    lead = anchor[starts] - starts
    whole = scan.mix(scan.span_hash(p, starts, stops) + lead.astype(_U))
    return doc[starts] + first_doc, starts + shift, stops - starts, lead, runs[anchor[starts]], whole


def _place(start: np.ndarray, length: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """31 bits of start, 8 each of length - SIZE and lead, in one key."""
    return (start.astype(_U) << _U(16)) | ((length - SIZE).astype(_U) << _U(8)) | lead.astype(_U)


def _placed(x: np.ndarray):
    x = x.view(_U)
    return (x >> _U(16)).astype(np.int64), ((x >> _U(8)) & _U(255)).astype(np.int64) + SIZE, (x & _U(255)).astype(np.int64)


def _halves(tag: pa.Array) -> np.ndarray:
    """The two 64-bit halves of each tag, as columns."""
    return scan.buffers(tag)[0].copy().view(_U).reshape(-1, 2)


def _tags(halves: np.ndarray) -> pa.Array:
    """From two rows of halves."""
    n = halves.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, np.int32)), pa.py_buffer(np.ascontiguousarray(halves.T))])


_SENT = "shard int, part binary"
_FOUND = "partial boolean, doc long, tag binary, start int, stop int, lead int, run long, times long, kinds long"
_FOUND_ARROW = pa.schema([("partial", pa.bool_()), ("doc", pa.int64()), ("tag", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("lead", pa.int32()), ("run", pa.int64()), ("times", pa.int64()), ("kinds", pa.int64())])


def _found(partial: bool, doc, tag, place, run, times, kinds=None) -> pa.RecordBatch:
    start, length, lead = _placed(place)
    n = len(start)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.full(n, partial), doc, _tags(tag), start, start + length, lead, run.view(np.int64), times, np.ones(n, np.int64) if kinds is None else kinds), _FOUND_ARROW.types)], schema=_FOUND_ARROW)


def _block(held: list, shards: int) -> pa.RecordBatch:
    """Rows with a negative shard hold what is repeated within the block; the others go to their shard, one of each kind."""
    run, whole, doc, place, times, tag = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((whole, run))
    run, whole, doc, place, times, tag = run[order], whole[order], doc[order], place[order], times[order], tag[order].T
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (whole[1:] != whole[:-1])
    at = np.flatnonzero(first)
    sums = np.add.reduceat(times, at)
    again = np.repeat(sums > 1, np.diff(np.append(at, len(run)))) & (times == 1)  # others are known as wholes
    rows = [(s, np.stack([run[at][a:b], whole[at][a:b], doc[at][a:b].view(_U), place[at][a:b], sums[a:b].astype(_U), *tag[:, at[a:b]]])) for s, a, b in cuts(run[at], shards)]
    if again.any():
        rows.append((-1 - int(run[0] % _U(shards)), np.stack([doc[again].view(_U), place[again], *tag[:, again]])))
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([pack(x.reshape(-1)) for _, x in rows], pa.binary())], names=["shard", "part"])


def _scan(shards: int):
    """Sends the stretches of each block of texts."""

    def go(batches):
        held, size = [], 0
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            data, offsets = scan.buffers(batch.column("text"))
            s = stretches(data, offsets)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[s["doc"]]
            tag = _halves(batch.column("tag"))[s["doc"]]
            if len(doc):
                held.append((s["run"], s["whole"], doc, _place(s["start"], s["length"], s["lead"]), np.ones(len(doc), np.int64), tag))
            size += len(data)
            if held and size >= BLOCK_BYTES:
                yield _block(held, shards)
                held, size = [], 0
        if held:
            yield _block(held, shards)

    return go


def _meet(shard: pa.Table) -> pa.Table:
    """Stretches repeated as wholes, and one of each kind of the partial ones."""
    if shard["shard"][0].as_py() < 0:
        out = [_found(False, x[0].view(np.int64), x[2:], x[1], np.zeros(len(x[0]), _U), np.full(len(x[0]), 2)) for x in (unpack(p.as_py(), _U).reshape(4, -1) for p in shard["part"])]
        return pa.Table.from_batches(out, _FOUND_ARROW)
    parts = [unpack(p.as_py(), _U).reshape(7, -1) for p in shard["part"]]
    run, whole, doc, place, times, *tag = (np.concatenate([p[k] for p in parts]) for k in range(7))
    del parts
    order = np.lexsort((whole, run))
    run, whole, times = run[order], whole[order], times[order]
    new_run = np.ones(len(run), bool)
    new_run[1:] = run[1:] != run[:-1]
    new = new_run.copy()
    new[1:] |= whole[1:] != whole[:-1]
    at = np.flatnonzero(new)
    sums = np.add.reduceat(times, at)
    kinds = np.bincount(np.cumsum(new_run)[at] - 1)  # kinds of surroundings of each run
    kinds = np.repeat(kinds, kinds)
    rows = np.diff(np.append(at, len(run)))
    full = np.flatnonzero(np.repeat(sums > 1, rows) & (times == 1))  # those repeated within a block are known already
    partial = at[kinds > 1]
    f, p = order[full], order[partial]
    out = [_found(False, doc[f].view(np.int64), np.stack([x[f] for x in tag]), place[f], run[full], times[full].astype(np.int64)), _found(True, doc[p].view(np.int64), np.stack([x[p] for x in tag]), place[p], run[partial], sums[kinds > 1].astype(np.int64), kinds[kinds > 1])]
    return pa.Table.from_batches(out, _FOUND_ARROW)


def _sent_bytes(anchor, run, doc, tag, start, stop, lead, times, text) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64(), None, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = [_tags(x) if t is None else pa.array(x, t) for x, t in zip((anchor, run, doc, tag, start, stop, lead, times, text), types)]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "run", "doc", "tag", "start", "stop", "lead", "times", "bytes"])


def _parts(batches):
    """text bytes, where each stretch's text begins, its columns and its tag (as columns of halves), for each batch of texts with lists of stretches."""
    for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
        data, offsets = scan.buffers(batch.column("text"))
        lists = batch.column("parts")
        rows = lists.flatten()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        columns = [rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "stop", "lead", "times", "run", "width")]
        doc = np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), n)
        yield data, (np.repeat(offsets[:-1], n), *columns, doc), np.repeat(_halves(batch.column("tag")), n, axis=0).T


def _split(width: int, shards: int):
    """Cuts stretches into pieces whose windows have their anchor at distances of one multiple of width and on, and sends these as _scan does."""

    def pieces(data, at, start, stop, lead, times, run, _, doc, tag):
        length = stop - start
        before = np.cumsum(length) - length
        p = scan.prefix(data[np.repeat(at + start - before, length) + np.arange(length.sum())])
        high, low = lead // width, (lead - length + SIZE) // width
        n = high - low + 1
        row = np.repeat(np.arange(len(n)), n)
        number = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        far = np.minimum(lead[row], number * width + width - 1)
        near = np.maximum((lead - length + SIZE)[row], number * width)
        anchor = (before + lead)[row]
        key = scan.span_hash(p, anchor - number * width, anchor - number * width + SIZE - width + 1)
        whole = scan.mix(scan.span_hash(p, anchor - far, anchor - near + SIZE) + far.astype(_U))
        own = scan.mix(key ^ scan.mix(run.view(_U)[row] + number.astype(_U)))
        return own, whole, doc[row], _place((start + lead)[row] - far, far - near + SIZE, far), times[row], tag[:, row].T

    def go(batches):
        held, size = [], 0
        for data, columns, tag in _parts(batches):
            for i in range(0, len(columns[0]), 5000):
                j = slice(i, i + 5000)
                held.append(pieces(data, *(c[j] for c in columns), tag[:, j]))
                size += len(held[-1][0])
                if size >= BLOCK_PIECES:
                    yield _block(held, shards)
                    held, size = [], 0
        if held:
            yield _block(held, shards)

    return go


def _bytes_of(batches):
    """The bytes of each partial stretch or piece with the tokens that lead its anchor suffix, which are those that all its windows share."""
    for data, columns, tag in _parts(batches):
        raw = data.tobytes()
        for i in range(0, len(columns[0]), 20_000):
            at, start, stop, lead, times, run, width, doc = (c[i : i + 20_000] for c in columns)
            anchor = at + start + lead % width
            yield _sent_bytes(
                [raw[a:b] for a, b in zip(anchor, anchor + SIZE - width + 1)], run, doc, tag[:, i : i + 20_000], start, stop, lead, times,
                [raw[a:b] for a, b in zip(at + start, at + stop)],
            )


_BYTES = "anchor binary, run long, doc long, tag binary, start int, stop int, lead int, times long, bytes binary"


def multikey(data: np.ndarray, at: np.ndarray, group: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Which suffixes data[at:] share their first size bytes with another of their group, by multikey quicksort over 8-byte characters.

    data has 8 bytes to spare at its end. Groups are refined round by round; a suffix alone in its group is done.
    """
    characters = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    depths = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    same = np.zeros(len(at), bool)
    live = np.arange(len(at))
    group = group.astype(np.int64)
    while len(live):
        order = np.argsort(group[live])
        live = live[order]
        g = group[live]
        first = np.ones(len(live), bool)
        first[1:] = g[1:] != g[:-1]
        heads = np.flatnonzero(first)
        n = np.diff(np.append(heads, len(live)))
        keep = np.repeat(n > 1, n)
        pivot = at[live[np.repeat(heads + n // 2, n)]][keep]
        live, number = live[keep], np.repeat(np.cumsum(n > 1) - 1, n)[keep]
        side = np.zeros(len(live), np.int64)
        level = np.flatnonzero(at[live] != pivot)
        for d in depths:  # suffixes level with the pivot go on to the next character
            x, y = characters[at[live[level]] + d].astype(_U), characters[pivot[level] + d].astype(_U)
            side[level] = np.where(x < y, -1, np.where(x > y, 1, 0))
            level = level[x == y]
            if not len(level):
                break
        equal = side == 0
        members = np.bincount(number[equal], minlength=int(number[-1]) + 1 if len(number) else 0)
        same[live[equal & (members[number] > 1)]] = True
        live, number, side = live[~equal], number[~equal], side[~equal]
        group[live] = number * 2 + (side > 0)
    return same


def _sort_range(batches):
    """Covered spans of the partial stretches of one range; comes sorted by anchor, and works through it in whole anchor groups."""

    def spans(rows, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows["doc"], rows["tag"], pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["doc", "tag", "start", "stop"])

    def work(rows: pa.Table) -> pa.RecordBatch:
        data, offsets = scan.buffers(rows["bytes"])
        data = np.append(data, np.zeros(8, np.uint8))
        n = np.diff(offsets) - SIZE + 1
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        run = rows["run"].to_numpy()
        group = np.cumsum(np.append(True, run[1:] != run[:-1]))
        distance = rows["lead"].to_numpy()[row] - within + SIZE
        hit = multikey(data, offsets[:-1][row] + within, group[row] * 1024 + distance)
        hit &= rows["times"].to_numpy()[row] == 1  # others are known as wholes
        edge = hit.copy()
        edge[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
        last = hit.copy()
        last[:-1] &= ~(hit[1:] & (row[1:] == row[:-1]))
        a, b = np.flatnonzero(edge), np.flatnonzero(last)
        start = rows["start"].to_numpy()[row[a]]
        at = pa.array(row[a], pa.int64())
        return spans({c: rows[c].take(at).combine_chunks() for c in ("doc", "tag")}, start + within[a], start + within[b] + SIZE)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= RANGE_BYTES:
            rows = pa.Table.from_batches(held).combine_chunks()
            run = rows["run"].to_numpy()
            others = np.flatnonzero(run != run[-1])
            split = int(others[-1]) + 1 if len(others) else 0
            if split:
                yield work(rows.slice(0, split))
                held = rows.slice(split).to_batches()
                size = sum(b.nbytes for b in held)
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def _tag_of(text: Column) -> Column:
    return F.unhex(F.md5(text)).alias("tag")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = text_of(text)
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc"), _tag_of(t), t.alias("text"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc, tag, start, stop): byte spans, overlapping ones included, whose every byte is covered by a repeated string.

    A null id stands as -2**63, a null text is empty. tag holds the MD5 of the text, which tells texts
    under one id apart. Texts are at most 2 GiB.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    small_batches(spark)
    x = _rows(docs, doc_id, text)
    shards, files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), few_files(docs)

    def meet(sent: DataFrame, width: int) -> DataFrame:
        return sent.groupBy("shard").applyInArrow(_meet, _FOUND).withColumn("width", F.lit(width)).coalesce(files).checkpoint()

    def with_text(partial: DataFrame) -> DataFrame:
        parts = partial.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop", "lead", "run", "times", "width")).alias("parts"))
        return member_filter(x, "doc", partial, "doc").join(parts, ["doc", "tag"]).select("doc", "tag", "text", "parts")

    met = last = meet(x.mapInArrow(_scan(shards * GROUPS), _SENT), SPREAD)
    for width in WIDTHS:  # windows that are equal have equal runs and wholes, so no kinds are left after the last
        common = last.filter(F.col("partial") & (F.col("kinds") > hot))
        if common.isEmpty():
            break
        last = meet(with_text(common).mapInArrow(_split(width, shards * GROUPS), _SENT), width)
        met = met.unionByName(last)
    raw = with_text(met.filter(F.col("partial") & (F.col("kinds") <= hot))).mapInArrow(_bytes_of, _BYTES)
    ranges = raw.repartitionByRange(shards, "anchor").sortWithinPartitions("anchor", "run")
    covered = ranges.mapInArrow(_sort_range, "doc long, tag binary, start int, stop int")
    return met.filter(~F.col("partial")).select("doc", "tag", "start", "stop").unionByName(covered)


def _merged(found) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in found or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _left(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _cut(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
        data, offsets = scan.buffers(batch.column("text"))
        raw = data.tobytes()
        spans = [_merged(s) for s in batch.column("spans").to_pylist()]
        left = [_left(raw[offsets[i] : offsets[i + 1]], s) for i, s in enumerate(spans)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"), pa.array(np.diff(offsets), pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind),
                pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()),
            ],
            names=["doc", "n_bytes", "spans", "kept_sha256", "kept"],
        )


_CUT = "doc long, n_bytes long, spans array<struct<start:int,stop:int>>, kept_sha256 string, kept string"


def _spans(docs: DataFrame, doc_id: str, text: str, hot: int = HOT) -> DataFrame:
    return repeats(docs, doc_id, text, hot).groupBy("doc", "tag").agg(F.array_distinct(F.collect_list(F.struct("start", "stop"))).alias("spans")).coalesce(few_files(docs)).checkpoint()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each input row: doc, n_bytes, spans (maximal removed byte runs), kept_sha256, kept (the text that is left, without broken characters).

    Repeated rows are repeats of each other and lose all that is SIZE bytes long. Texts shorter than SIZE lose nothing.
    """
    x = _rows(docs, doc_id, text)
    spans = _spans(docs, doc_id, text, hot)
    touched = member_filter(x, "doc", spans, "doc").join(spans, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(_cut, _CUT)
    clean = member_filter(x, "doc", spans, "doc", wanted=False).select(
        "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"),
    )
    out = touched.unionByName(clean)
    return out.withColumn("doc", F.when(F.col("doc") != -(2**63), F.col("doc")))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of docs with their own columns, text holding what is left and length (if there) its code points. Texts that lose nothing stay as they are, nulls too."""
    names = docs.columns
    key, digest, found = spare(names, "cut_key", "cut_digest", "cut_spans")
    own, tag = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), F.unhex(F.md5(text_of(text)))
    spans = _spans(docs, doc_id, text).select(F.col("doc").alias(key), F.col("tag").alias(digest), F.col("spans").alias(found))

    def cut(batches):
        at = names.index(text)
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            data, offsets = scan.buffers(batch.column(at))
            raw = data.tobytes()
            columns = list(batch.columns[: len(names)])
            left = [_left(raw[offsets[i] : offsets[i + 1]], _merged(s)).decode("utf-8", "ignore") for i, s in enumerate(batch.column(len(names)).to_pylist())]
            columns[at] = pa.array(left, columns[at].type)
            if length in names:
                columns[names.index(length)] = pa.array([len(s) for s in left], columns[names.index(length)].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    maybe = member_filter(docs, own, spans, key)
    known = (own == F.col(key)) & (tag == F.col(digest))
    touched = maybe.join(spans, known).select(*names, found).mapInArrow(cut, docs.schema)
    whole = maybe.join(spans, known, "left_anti")
    return touched.unionByName(whole).unionByName(member_filter(docs, own, spans, key, wanted=False)).coalesce(few_files(docs))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is cut out of every text. A null or empty text has no bytes, equal rows are told apart by nothing and cut alike, texts of one id or none by their digests; a text of any length is scanned whole, an empty table gives no rows."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
    )
