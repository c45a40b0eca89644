"""WARC archives with a globally ordered capture index.

Writing tasks sort their captures by (URL key, time), write one gzip member per record and give back
their part of the index: a run sorted like the archive. Runs are merged by range: ranges of the key
are dealt to tasks, and in each the k runs' slices go through a loser tree. Reading goes through the
merged index, archive by archive in the order of the records.

Archives are written under names of their own and only count once their index rows are committed by Spark,
so lost or repeated attempts leave no trace in the index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, freeing, new_folder, offsets_by_part, tasks, typed

LEAST_PAYLOAD = 100
#: Seconds around 2024 within which ids are times; they keep years at four digits.
EARLIEST, LATEST = -30_000_000_000, 250_000_000_000
ARCHIVE_BYTES = 512 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "run string, nth long, url_key string, captured timestamp, page_id long, file string, at long, size long"


class LoserTree:
    """Merges sorted runs; each step costs one comparison per level, against the losers on the way up."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = max(1, len(self.runs))
        self.losers = [-1] * k
        winners = [-1] * k + list(range(len(self.runs)))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a <= b)
        return (self.heads[a], a) <= (self.heads[b], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            won = self.winner
            yield self.heads[won]
            self.heads[won] = next(self.runs[won], None)
            node = (won + len(self.runs)) // 2
            while node:
                if self._first(self.losers[node], won):
                    won, self.losers[node] = self.losers[node], won
                node //= 2
            self.winner = won


def url_key(url: str | Column) -> Column:
    """Sort-friendly key: host labels reversed, without scheme, ``www.``, port and fragment, lower case."""
    whole = F.lower(F.trim(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))))
    start = r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/?#@]*@)?"
    host = F.regexp_replace(F.regexp_extract(whole, start + r"([^/?#:]*)", 1), r"^www\d*\.", "")
    path = F.regexp_extract(whole, start + r"[^/?#]*([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def captures(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html",
             captured: str | None = None, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Pages with payload, digest, kind of record and the response a revisit refers to.

    Of equal payloads of at least ``least`` bytes that with the smallest id is the response (all rows with
    that id, if it is repeated). Rows without id are responses only if no equal payload has an id. NULL
    html is an empty payload. Without a time column the time is the id in seconds from 2024 on, ids beyond
    EARLIEST and LATEST as these; rows without id have 2024 itself.
    """
    rows = typed(pages, {"page_id": (page_id, "long"), "url": (url, "string"), "html": (html, "string")} | (
        {"captured": (captured, "timestamp")} if captured else {}))
    if not captured:
        rows = rows.withColumn("captured", F.timestamp_seconds(F.lit(1_704_067_200) + F.greatest(
            F.lit(EARLIEST), F.least(F.lit(LATEST), F.coalesce("page_id", F.lit(0).cast("long"))))))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256)).drop("html")
    # Digests alone are grouped: payloads are not moved for it.
    same = (rows.filter(F.length("payload") >= least).groupBy("digest")
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > 1).drop("__n"))
    joined = rows.join(same, "digest", "left")
    again = F.col("first").isNotNull() & (F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", url_key("url").alias("url_key"), "url", "captured", "digest", "payload",
                         F.when(again, F.col("first")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _clean(value: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value or "")


def record(page_id, url, captured, digest: str, payload: bytes, refers_to) -> bytes:
    """One WARC 1.1 record; the block of a revisit is the HTTP head alone, which tells the payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)),
              ("WARC-Target-URI", _clean(url)), ("WARC-Date", captured.strftime("%Y-%m-%dT%H:%M:%SZ")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """``(WARC fields, HTTP fields, payload)`` of one uncompressed record."""
    def fields(text: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) for x in text.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    named = fields(head)
    block = rest[:int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, fields(http), payload


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, out, name, at, nth, done = TaskContext.get().partitionId(), None, None, 0, 0, []

        def index():
            kinds = [pa.string(), pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kinds[i]) for i in range(8)], names)

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                page_id, key, url, captured, digest, payload, refers_to = (c[i].as_py() for c in columns)
                if out is None or at >= most:
                    if out:
                        out.close()
                    name, at, nth = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                packed = gzip.compress(record(page_id, url, captured, digest, payload, refers_to), 1, mtime=0)
                out.write(packed)
                done.append((name, nth, key, captured, page_id, name, at, len(packed)))
                at, nth = at + len(packed), nth + 1
            yield index()
            done = []
        if out:
            out.close()
    return run


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``captures`` as archives under ``folder/archives``; the committed index of sorted runs."""
    ordered = (rows.select("page_id", "url_key", "url", "captured", "digest", "payload", "refers_to")
               .sortWithinPartitions("url_key", "captured", "page_id"))
    ordered.mapInArrow(freeing(_write(f"{folder}/archives", archive_bytes)), INDEX).write.parquet(f"{folder}/runs")
    return rows.sparkSession.read.schema(INDEX).parquet(f"{folder}/runs")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key range, sorted by (run, nth), to the range's rows in key order with their places."""
    part, place = TaskContext.get().partitionId(), 0
    low = 1 << 63
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, at = table["page_id"].to_pylist(), range(table.num_rows)
    rows = zip(table["run"].to_pylist(), table["url_key"].to_pylist(), table["captured"].cast(pa.int64()).to_pylist(),
               [-low if i is None else i for i in ids], at)
    slices = [[r[1:] for r in run] for _, run in groupby(rows, key=itemgetter(0))]
    order = [r[-1] for r in LoserTree(slices)]
    for a in range(0, len(order), 10_000):
        chosen = table.take(order[a:a + 10_000]).combine_chunks()
        n = chosen.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)),
             *[chosen[c].chunk(0) for c in ("url_key", "captured", "page_id", "file", "at", "size")]],
            ["part", "place", "url_key", "captured", "page_id", "file", "at", "size"])
        place += n


def merge_index(runs: DataFrame) -> DataFrame:
    """All runs in one order of (URL key, time, id): ``position`` counts from 0 over the whole index.

    Ranges are taken over key, time and id, so a URL with very many captures is dealt to several tasks. A
    task holds its range of narrow index rows.
    """
    keys = ["url_key", "captured", "page_id"]
    dealt = (runs.repartitionByRange(tasks(runs.sparkSession), *keys).sortWithinPartitions("run", "nth"))
    merged = cut_lineage(dealt.mapInArrow(
        _merge, "part int, place long, url_key string, captured timestamp, page_id long, file string, at long, size long"))
    bases = offsets_by_part(merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "n", "base")
    return (merged.join(F.broadcast(bases), "part")
            .select((F.col("base") + F.col("place")).alias("position"), *keys, "file", "at", "size"))


READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, position long")


def _read(folder: str):
    def number(name: str | None):
        text = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "none") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for file, at, size, position in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if file != name:
                    name, source = file, files.open_input_file(f"{root}/{file}")
                fields, http, payload = parse_record(gzip.decompress(source.read_at(size, at)))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file} at {at}: the payload does not have its digest")
                out.append((number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, fields["WARC-Type"],
                            number(fields.get("WARC-Refers-To")), position))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(6)],
                                             [f.split()[0] for f in READ.split(", ")])
    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, archive by archive; payloads are checked against their digests."""
    dealt = (index.select("file", "at", "size", "position").repartition(tasks(index.sparkSession), "file")
             .sortWithinPartitions("file", "at"))
    return dealt.mapInArrow(freeing(_read(f"{folder}/archives")), READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives of ``pages`` to a new shared folder, merge their index and read all records back."""
    folder = new_folder(pages.sparkSession)
    return read_archives(merge_index(write_archives(captures(pages, **options), folder)), folder)
