"""Token files with a minimal perfect hash index.

A shard is one file: a head, the raw ids of its documents in ascending key order, then the index:
the documents' bounds, and for each key the slot that a minimal perfect hash gives it. A slot holds
a 64-bit fingerprint of its key, the key's first document and how many follow; keys themselves are
not stored. A look-up costs one hash, one slot, one range of the payload, whatever the shard's size.

Shards are bounded in documents and tokens, documents are dealt out by ranges of the key, and
a task streams its range into files, so memory does not grow with the corpus. A task writes under a
name of its own and lists it in the manifest, which Spark commits: files of lost or repeated
attempts are never listed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlake.llm.common import freeing, new_folder, tasks, typed
from itemlake.llm.encode import encode_texts, plain_strings

MAGIC = b"TOKSHRD1"
HEAD = struct.Struct("<8sB7x")  # magic, bytes per id
FOOT = struct.Struct("<QQQQ8s")  # keys, documents, tokens, hash buckets, magic
SHARD_DOCS, SHARD_TOKENS = 65_536, 64_000_000
MANIFEST = ("part int, shard int, file string, first_key long, last_key long, has_null boolean, "
            "docs long, tokens long")
SLOT = np.dtype([("print", "<u8"), ("first", "<u4"), ("docs", "<u4")])


def mixed(keys: np.ndarray, nulls: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit hashes of whole-number keys under a seed (or one each); NULL has a hash of its own."""
    with np.errstate(over="ignore"):
        seed = np.asarray(seed, np.uint64)
        x = keys.astype(np.int64).view(np.uint64) + seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x = np.where(nulls, (seed + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03), x)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by displacement: slot = (hash(key, step) + shift) mod n, with a step and
    a shift per bucket of about four keys.

    Large buckets are placed first. For a given step all shifts are tried at once: the places free
    for every key of a bucket are the intersection of the free places, shifted by each key.
    """

    def __init__(self, size: int, steps: np.ndarray, shifts: np.ndarray):
        self.size, self.steps, self.shifts = size, steps, shifts

    @classmethod
    def build(cls, keys: np.ndarray, nulls: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 4)
        steps, shifts = np.zeros(buckets, np.uint32), np.zeros(buckets, np.uint32)
        made = cls(n, steps, shifts)
        if not n:
            return made
        bucket = made._buckets(keys, nulls)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=buckets)
        ends = np.cumsum(counts)
        free = np.ones(n, bool)
        twice = np.ones(2 * n, bool)
        lowest = 0
        for b in np.argsort(-counts, kind="stable"):
            size = counts[b]
            if not size:
                break
            mine = order[ends[b] - size:ends[b]]
            at = made._places(keys[mine], nulls[mine], 0)
            if size == 1:
                while not free[lowest]:
                    lowest += 1
                place = np.array([lowest])
                shifts[b] = (lowest - int(at[0])) % n
            else:
                for step in range(1 << 20):
                    at = made._places(keys[mine], nulls[mine], step)
                    if len(np.unique(at)) < size:
                        continue
                    fits = np.ones(n, bool)
                    for x in at.tolist():
                        fits &= twice[x:x + n]
                    shift = int(np.argmax(fits))
                    if fits[shift]:
                        steps[b], shifts[b] = step, shift
                        place = (at + shift) % n
                        break
                else:
                    raise ValueError("no place for a bucket of keys")
            free[place] = False
            twice[place] = False
            twice[place + n] = False
        return made

    def _buckets(self, keys, nulls):
        return (mixed(keys, nulls, 1) % np.uint64(len(self.steps))).astype(np.int64)

    def _places(self, keys, nulls, step):
        return (mixed(keys, nulls, np.asarray(step) + 16) % np.uint64(max(1, self.size))).astype(np.int64)

    def slots(self, keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        bucket = self._buckets(keys, nulls)
        return (self._places(keys, nulls, self.steps[bucket]) + self.shifts[bucket]) % max(1, self.size)


class ShardWriter:
    """Writes documents in key order to one shard."""

    def __init__(self, folder: str, name: str, width: int):
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.path, self.name, self.width = f"{self.root}/{name}", name, width
        self.out = self.files.open_output_stream(self.path)
        self.out.write(HEAD.pack(MAGIC, width))
        self.keys: list[int | None] = []
        self.bounds = [0]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= 1 << (8 * self.width):
            raise ValueError(f"an id does not fit {self.width} bytes")
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(key)
        self.bounds.append(self.bounds[-1] + len(ids))

    def close(self) -> None:
        nulls = np.array([k is None for k in self.keys], bool)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
        first = np.flatnonzero(new)
        own, own_null = keys[first], nulls[first]
        index = PerfectHash.build(own, own_null)
        slots = np.zeros(len(first), SLOT)
        at = index.slots(own, own_null)
        slots["print"][at] = mixed(own, own_null, 4)
        slots["first"][at] = first
        slots["docs"][at] = np.diff(np.append(first, len(keys)))
        for piece in (np.array(self.bounds, "<u8"), index.steps.astype("<u4"), index.shifts.astype("<u4"), slots):
            self.out.write(piece.tobytes())
        self.out.write(FOOT.pack(len(first), len(keys), self.bounds[-1], len(index.steps), MAGIC))
        self.out.close()


class ShardReader:
    """Keyed access to one shard; only the index is held in memory."""

    def __init__(self, folder: str, name: str):
        files, root = pafs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        magic, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        size = self.file.size()
        n_keys, self.docs, self.tokens, buckets, tail = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{name} is no token shard")
        at = HEAD.size + self.tokens * self.width
        raw = self.file.read_at(size - FOOT.size - at, at)
        a = 8 * (self.docs + 1)
        self.bounds = np.frombuffer(raw, "<u8", self.docs + 1).astype(np.int64)
        steps = np.frombuffer(raw, "<u4", buckets, a)
        shifts = np.frombuffer(raw, "<u4", buckets, a + 4 * buckets)
        self.slots = np.frombuffer(raw, SLOT, n_keys, a + 8 * buckets)
        self.index = PerfectHash(n_keys, steps, shifts)

    def find(self, keys: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(first document, documents)`` of each key; no documents where the fingerprint differs."""
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.slots[self.index.slots(keys, nulls)]
        known = slot["print"] == mixed(keys, nulls, 4)
        return slot["first"].astype(np.int64), np.where(known, slot["docs"], 0).astype(np.int64)

    def ids(self, document: int, end: int | None = None) -> np.ndarray:
        """Ids of documents ``document`` to ``end`` (one by default) as unsigned 32-bit integers."""
        a, b = self.bounds[document], self.bounds[document + 1 if end is None else end]
        raw = self.file.read_at(int(b - a) * self.width, int(HEAD.size + a * self.width))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _write(folder: str, tokenizer: str, end: int, width: int, docs: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, made = TaskContext.get().partitionId(), 0, []
        writer: ShardWriter | None = None

        def close():
            writer.close()
            known = [k for k in writer.keys if k is not None]
            made.append((part, shard, writer.name, known[0] if known else None, known[-1] if known else None,
                         writer.keys[0] is None, len(writer.keys), writer.bounds[-1]))

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), plain_strings(batch.column(1))
            for key, ids in zip(keys, encode_texts(tokenizer, texts, end)):
                if writer and (len(writer.keys) >= docs or writer.bounds[-1] + len(ids) > tokens):
                    close()
                    writer, shard = None, shard + 1
                writer = writer or ShardWriter(folder, f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}.tok", width)
                writer.add(key, ids)
        if writer:
            close()
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], kinds[i]) for i in range(len(names))], names)
    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end: int = 1, width: int = 2,
                      doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS,
                      shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write them to ``folder/shards`` in ascending key order.

    ``folder/manifest`` lists the shards. ``width`` is 2 for vocabularies up to 65,536 ids, else 4. A
    NULL text counts as empty; NULL keys come first; rows with equal keys stay neighbours, in an
    order fixed by their texts' hash; no rows give an empty manifest.
    """
    spark = docs.sparkSession
    inputs = typed(docs, {"doc_id": (doc_id, "long"), "text": (text, "string")})
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = inputs.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(
        freeing(_write(f"{folder}/shards", tokenizer, end, width, shard_docs, shard_tokens)), MANIFEST)
    rows.write.parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in key order with ``start``, the tokens of all shards before each.

    There is a row per shard, so the one ordered window is short.
    """
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def _route(shards: list[tuple]):
    """Shards that can hold each key: consecutive ranges that meet at most in an end."""
    names = np.array([s[0] for s in shards], object)
    starts = np.array([s[1] for s in shards], np.int64)
    has_null = np.flatnonzero([s[4] for s in shards]) if shards else np.array([], int)
    ranged = np.array([i for i, s in enumerate(shards) if s[2] is not None], int)
    low = np.array([shards[i][2] for i in ranged], np.int64)
    high = np.array([shards[i][3] for i in ranged], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            nulls = np.asarray(keys.is_null())
            values = keys.fill_null(0).to_numpy(zero_copy_only=False)
            a, b = np.searchsorted(high, values, "left"), np.searchsorted(low, values, "right")
            counts = np.where(nulls, len(has_null), np.maximum(b - a, 0))
            at = np.repeat(np.where(nulls, 0, a), counts)
            at += np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            row = np.repeat(np.arange(len(values)), counts)
            shard = np.zeros(len(at), int)
            null = nulls[row]
            shard[null], shard[~null] = has_null[at[null]], ranged[at[~null]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[row], mask=null), pa.array(names[shard], pa.string()), pa.array(starts[shard])],
                ["doc_id", "file", "shard_start"])
    return run


def _look_up(folder: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            files = batch.column(1).to_pylist()
            nulls = np.asarray(batch.column(0).is_null())
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            edges = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
            for a, b in zip(edges, edges[1:]):
                if files[a] != name:
                    name, reader = files[a], ShardReader(folder, files[a])
                first, docs = reader.find(keys[a:b], nulls[a:b])
                row = a + np.repeat(np.arange(b - a), docs)
                doc = np.repeat(first, docs) + np.arange(len(row)) - np.repeat(np.cumsum(docs) - docs, docs)
                begin = reader.bounds[doc]
                sizes = reader.bounds[doc + 1] - begin
                sums, at = np.zeros(len(row), np.int64), 0
                while at < len(row):  # neighbouring documents in one read
                    end = at + 1
                    while end < len(row) and doc[end] == doc[end - 1] + 1 and begin[end] - begin[at] < block:
                        end += 1
                    got = reader.ids(int(doc[at]), int(doc[end - 1]) + 1)
                    for i in range(at, end):
                        x = int(begin[i] - begin[at])
                        sums[i] = zlib.crc32(got[x:x + int(sizes[i])].tobytes())
                    at = end
                start = begin + batch.column(2).to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row], mask=nulls[row]), pa.array(start), pa.array(sizes), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_documents(keys: DataFrame, folder: str, *, doc_id: str = "doc_id", block: int = 1 << 20) -> DataFrame:
    """Look all ``keys`` up in the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32``.

    A key not in the files gives no row; one with several documents a row for each; repeated keys
    are asked once. The manifest (a row per shard) goes to every task to route keys to shards.
    """
    spark = keys.sparkSession
    shards = [tuple(r) for r in read_manifest(spark, folder).orderBy("part", "shard")
              .select("file", "start", "first_key", "last_key", "has_null").collect()]
    asked = typed(keys, {"doc_id": (doc_id, "long")}).distinct()
    routed = asked.mapInArrow(_route(shards), "doc_id long, file string, shard_start long")
    dealt = routed.repartition(tasks(spark), "file").sortWithinPartitions("file", "doc_id")
    return dealt.mapInArrow(_look_up(f"{folder}/shards", block),
                            "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and look every document up in them."""
    folder = new_folder(docs.sparkSession)
    write_token_files(docs, tokenizer, folder, **options)
    return read_documents(docs, folder)
