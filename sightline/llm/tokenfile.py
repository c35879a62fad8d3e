"""Token files: the token ids of texts in files of independent zstandard frames with a seek table at the end.

File format. Each file holds the ids of consecutive documents as little-endian integers of 2 or 4 bytes, cut into frames of at most
``FRAME`` bytes, each compressed by itself. The last frame is skippable, as the public seekable format of zstandard has it: 4 bytes
0x184D2A5E and the size of what follows; for each frame its compressed size, its plain size and the low 32 bits of the XXH64 of its plain
bytes; the number of frames, a byte 0x80 (checksums present) and 0x8F92EAB1. Any zstandard decoder reads a whole file; a reader that wants some
documents takes the table from the end, then those frames alone, and compares their checksums. Where a document lies
stands in the Parquet table ``index`` beside the files: doc, file, first (ids before it in the file), n.

Spark sorts documents over ranges of their ids, so the files in order of their names hold all documents in ascending order. A task writes one file
under a name of its own attempt and then renames it; an attempt that is repeated writes the same bytes again.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm import scan
from sightline.llm.native import shared_checkpoints, spare, table, text_of

FRAME = 1 << 18  # plain bytes
LEVEL = 3
END = 2
_SKIPPABLE, _SEEKABLE, _CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_PART = 1 << 22  # bytes of texts looked at together
_KNOWN = 1_000_000  # pieces of words whose ids are kept
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: What stands alone within a lower-cased word: digits, and runs of ASCII characters that are neither letters nor digits.
_APART = r"([0-9]|[^a-z0-9\x{80}-\x{10FFFF}]+)"
#: All but ASCII without apostrophes and <, and letters from U+00C0 to U+027F but the dotted capital I, which lower case takes apart.
_ODD = r"[^\x00-&(-;=-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{27F}]"


def _check(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class Writer:
    """Frames of one file, put out as they fill."""

    def __init__(self, out, frame: int = FRAME):
        self.out, self.frame, self.rest, self.table = out, frame, bytearray(), []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress

    def add(self, ids: np.ndarray) -> None:
        self.rest += ids.tobytes()
        while len(self.rest) >= self.frame:
            self._put(self.frame)

    def _put(self, n: int) -> None:
        plain = bytes(self.rest[:n])
        del self.rest[:n]
        packed = self.pack(plain)
        self.out.write(packed)
        self.table.append((len(packed), n, _check(plain)))

    def close(self) -> None:
        if self.rest:
            self._put(len(self.rest))
        entries = np.array(self.table, _ENTRY).tobytes()
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + _FOOTER.size) + entries + _FOOTER.pack(len(self.table), _CHECKED, _SEEKABLE))
        self.out.close()


class Reader:
    """Spans of plain bytes of one file; the frame read last is kept."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        count, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, end - _FOOTER.size))
        if magic != _SEEKABLE or flags != _CHECKED:
            raise ValueError("no seek table with checksums at the end of the file")
        size = count * _ENTRY.itemsize
        self.table = np.frombuffer(file.read_at(size, end - _FOOTER.size - size), _ENTRY)
        self.packed = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.plain = np.concatenate([[0], np.cumsum(self.table["plain"], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.held, self.bytes, self.frames_read = -1, b"", 0

    def frame(self, k: int) -> bytes:
        if k != self.held:
            plain = self.unpack(self.file.read_at(int(self.table["packed"][k]), int(self.packed[k])))
            if len(plain) != self.table["plain"][k] or _check(plain) != self.table["check"][k]:
                raise ValueError(f"frame {k} is damaged")
            self.held, self.bytes = k, plain
            self.frames_read += 1
        return self.bytes

    def span(self, start: int, stop: int) -> bytes:
        if not 0 <= start <= stop <= self.plain[-1]:
            raise ValueError("the file has no such bytes")
        out, k = [], int(np.searchsorted(self.plain, start, "right")) - 1
        while start < stop:
            last = min(stop, int(self.plain[k + 1]))
            out.append(self.frame(k)[start - int(self.plain[k]) : last - int(self.plain[k])])
            start, k = last, k + 1
        return b"".join(out)


class Numbers(dict):
    """Numbers keys as they are asked for; new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Ragged:
    """Some ids for each key. Keys that are new to a call are handed to ``learn`` for their ids and how many each has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.number, self.ids, self.starts = Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, keys: Iterable[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n keys one after another, and how many each has."""
        if len(self.number) > _KNOWN:
            self.forget()
        k = np.fromiter(map(self.number.__getitem__, keys), np.int64, n)
        if self.number.new:
            ids, counts = self.learn(self.number.new)
            self.number.new.clear()
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        return _picked(self.ids, np.diff(self.starts), k)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of so many values."""
    total = np.concatenate([[0], np.cumsum(values)])
    stop = np.cumsum(counts)
    return total[stop] - total[stop - counts]


def _picked(ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids at some places, one after another, and how many ids each has."""
    first, n = (np.cumsum(counts) - counts)[at], counts[at]
    total = np.cumsum(n)
    return ids[np.repeat(first - total + n, n) + np.arange(total[-1] if len(n) else 0)], n


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """At white space: how many words each text has, the distinct words, and for each word its number among these."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    some = pc.not_equal(words, "")  # white space at an end of a text leaves an empty word
    counts = _sums(some.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy())
    words = words.filter(some).dictionary_encode()
    return counts, words.dictionary, words.indices.to_numpy()


class Encoder:
    """Ids of texts by a tokenizer that folds case, drops white space and splits texts into letter runs, digits and runs of other characters.

    No piece crosses white space, so Arrow numbers the words of some texts, and the pieces of their distinct words, and the ids of pieces are kept. A word of ASCII
    characters and Latin letters is put together from such pieces; one with other characters, an apostrophe (whose endings are pieces of their own) or a < (added
    tokens) is a piece as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own cores only
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        (self.mark,) = self.encode(["\0"], add_special_tokens=False)[0].ids
        self.pieces = Ragged(self._pieces)

    def _pieces(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All in one text, between marks of zero bytes, whose id no other bytes have; a piece that holds one is encoded alone."""
        own = {i: self.encode([x.decode()], add_special_tokens=False)[0].ids for i, x in enumerate(new) if b"\0" in x}
        ids = np.array(self.encode([b" \0 ".join(b"" if i in own else x for i, x in enumerate(new)).decode()], add_special_tokens=False)[0].ids, np.uint32)
        mark = ids == self.mark
        counts = np.diff(np.flatnonzero(np.concatenate([[True], mark, [True]]))) - 1
        ids = ids[~mark]
        if own:
            at = np.cumsum(counts)
            ids = np.insert(ids, np.repeat([at[i] for i in own], [len(x) for x in own.values()]), list(itertools.chain.from_iterable(own.values())))
            counts[list(own)] = [len(x) for x in own.values()]
        return ids, counts

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after another, and how many each has."""
        counts, words, at = _split(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        apart = pc.replace_substring_regex(pc.ascii_lower(words), _APART, r" \1 ")
        parts, pieces, piece = _split(pc.if_else(pc.match_substring_regex(words, _ODD), words, apart))
        own = _picked(*self.pieces(pieces.cast(pa.large_binary()).to_pylist(), len(pieces)), piece)
        ids, n = _picked(own[0], _sums(own[1], parts), at)
        return ids, _sums(n, counts)


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    at = 0
    while at < len(raw) or at == 0:
        cut = _GAP.search(raw, at + _PART) if at + _PART < len(raw) else None
        stop = cut.end() if cut else len(raw)
        yield raw[at:stop]
        at = max(stop, 1)


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


_PLACES = pa.schema([("doc", pa.int64()), ("file", pa.string()), ("first", pa.int64()), ("n", pa.int64())])


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, width: int = 2, files: int | None = None) -> DataFrame:
    """Writes the ids of every text, each followed by ``end``, and the index; returns the index.

    ``folder`` is one that the driver and all executors share, as a path or a URI. Documents are in ascending order of their id, null ids first and rows of one id
    by their text's hash. A null or empty text has the end id alone; repeated rows are all written; an empty table makes an empty
    index and no file. A text of any length goes through in parts, a single word as a whole. Ids must fit in ``width`` bytes (2 or 4).
    ``files`` is the number of ranges, the session's shuffle partitions if not given.
    """
    spark = docs.sparkSession
    kind = np.dtype({2: "<u2", 4: "<u4"}[width])
    salt = spare(docs.columns, "row")[0]

    def go(batches):
        path, writer, first = "", None, 0
        encode = _encoder(tokenizer)
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}.zst"
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            data, offsets = scan.buffers(batch.column("text"))
            for a, b in scan.pieces(offsets, _PART):
                if writer is None:
                    path = f"{root}/.{name}.{task.taskAttemptId()}"
                    store.create_dir(root)
                    writer = Writer(store.open_output_stream(path))
                lengths = np.zeros(b - a, np.int64)
                groups = [[data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]] if b - a > 1 else [[x] for x in _parts(data[offsets[a] : offsets[b]].tobytes())]
                for group in groups:
                    ids, n = encode(group)
                    lengths += n
                    ids = np.insert(ids, np.cumsum(n), end) if b - a > 1 else ids
                    if len(ids) and ids.max() > np.iinfo(kind).max:
                        raise ValueError(f"ids beyond {width} bytes")
                    writer.add(ids.astype(kind))
                if b - a == 1:
                    writer.add(np.array([end], kind))
                lengths += 1
                places = first + np.cumsum(lengths) - lengths
                first += int(lengths.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), pa.array([name] * (b - a), pa.string()), pa.array(places), pa.array(lengths)], schema=_PLACES)
        if writer is not None:
            writer.close()
            store.move(path, f"{root}/{name}")

    folder = _uri(folder)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), text_of(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias(salt))
    keys = ["doc", "h", salt]  # the last parts rows that are equal, so no id or row is too frequent for a range
    ranges = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc", "text")
    sorted_rows.mapInArrow(go, "doc long, file string, first long, n long").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _uri(folder: str) -> str:
    """file:/x, as Spark writes it, is file:///x for Arrow; a bare path is a local one."""
    return "file://" + re.sub(r"^file:/*", "/", folder) if folder.startswith(("file:", "/")) else folder


def read(places: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """doc, file, first, n, ids (binary, little-endian integers of 4 bytes) of the documents whose index rows are given.

    Only frames that hold them are read and decompressed; a frame whose checksum differs is an error. No rows give no rows.
    """
    folder = _uri(folder)

    def go(batches):
        store, root = fs.FileSystem.from_uri(folder)
        reader, opened = None, None
        for batch in batches:
            ids = []
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n"))):
                if file != opened:
                    reader, opened = Reader(store.open_input_file(f"{root}/{file}")), file
                ids.append(np.frombuffer(reader.span(first * width, (first + n) * width), f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PLACES.names), pa.array(ids, pa.binary())], names=[*_PLACES.names, "ids"])

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = places.select(*_PLACES.names).repartition(parts, "file").sortWithinPartitions("file", "first")
    return at.mapInArrow(go, "doc long, file string, first long, n long, ids binary")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written to the shared checkpoint folder and read back. A null text is the empty text: its end id alone."""
    import public_tokenizers

    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    places = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    before = F.sum("all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = places.groupBy("file").agg(F.sum("n").alias("all")).select("file", F.coalesce(before, F.lit(0)).alias("before"))  # one row a file
    return read(places, folder).join(F.broadcast(files), "file").select(
        F.col("doc").alias("doc_id"), (F.col("before") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
