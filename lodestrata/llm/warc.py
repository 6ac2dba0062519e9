"""Deterministic sharded WARC archives.

Records are range-sorted by key. Shard bounds come from an exact histogram of payload
bytes over key ranges, so the same table gives the same shards however it is
partitioned. A shard is written as gzip members into files that roll at a compressed
size; headers, record ids and digests are made anew from content. Files are written
under temporary names, renamed when complete, and become part of the archive only by
the manifest, a table that Spark commits after all of them; a task that ran twice
leaves identical files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.scratch import dealt, near, new_path, numbered, table

SHARD_BYTES = 32 << 20
MAX_SHARDS = 16_384
ROLL_BYTES = 64 << 20
FANOUT = 256
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f0c3c1e-52a4-5b0e-9a5f-0c64a1d0b7aa")
MANIFEST = "shard int, seq int, file string, records bigint, bytes bigint, sha256 string"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


@dataclass
class Archive:
    """``folder`` holds the files; ``manifest`` names those that count."""

    folder: str
    manifest: DataFrame


def _digest32(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def _record_id(*key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(repr, key)))}>"


def _clean(url: str) -> str:
    """No white space or control characters, which would end a header."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, size: int, sha: str, payload: bytes | None, first: tuple[int | None, str | None] = (None, None), number: int = 0) -> bytes:
    """One WARC record; without a payload a revisit of the response with key and url ``first``, which keeps the HTTP header.

    ``number`` tells rows apart that are equal in key, url and payload.
    """
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url, sha, number)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{_digest32(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(*first, sha, 0)}", f"WARC-Refers-To-Date: {DATE}"]
        if first[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(first[1])}")
        head.append(f"WARC-Refers-To-Key: {'' if first[0] is None else first[0]}")
    head += [f"WARC-Record-Key: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(body: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as the gzip member of a response, so that shuffles carry compressed records."""
    for b in batches:  # page_id, url, payload, sha, number
        digests, members = [], []
        for page_id, url, payload, number in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            digests.append(_digest32(payload))
            members.append(_member(record(page_id, url, len(payload), digests[-1], payload, number=number)))
        size = pa.compute.cast(pa.compute.binary_length(b.column(2)), pa.int64())
        made = [size, b.column(3), b.column(4), pa.array(digests, pa.string()), pa.array(members, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["page_id", "url", "size", "sha", "number", "digest", "member"])


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Files:
    """The files of one shard; each becomes visible under its own name only when complete."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = _filesystem(folder)
        self.shard, self.roll, self.seq, self.stream = shard, roll, 0, None

    def add(self, member: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = posixpath.join(self.root, "_temporary", f"{self.name}.{uuid.uuid4().hex}")
            self.stream = self.fs.open_output_stream(self.temporary, compression=None)
            self.records = self.bytes = 0
            self.sha = hashlib.sha256()
        self.stream.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        if self.bytes >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.stream.close()
        self.fs.move(self.temporary, posixpath.join(self.root, self.name))
        out = (self.shard, self.seq, self.name, self.records, self.bytes, self.sha.hexdigest())
        self.stream, self.seq = None, self.seq + 1
        return out


def _write(folder: str, roll: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["shard", "seq", "file", "records", "bytes", "sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: _Files | None = None
        for b in batches:  # shard, page_id, url, size, digest, member (null for a revisit), first, first_url, number; sorted
            done: list[tuple] = []
            for shard, page_id, url, size, digest, member, first, first_url, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if files is None or files.shard != shard:
                    if files is not None and files.stream is not None:
                        done.append(files.close())
                    files = _Files(folder, shard, roll)
                done.extend(files.add(member or _member(record(page_id, url, size, digest, None, (first, first_url), number))))
            yield batch(done)
        if files is not None and files.stream is not None:
            yield batch([files.close()])

    return run


def shard_cuts(sizes: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """First keys of the shards after the first, from ``sizes(key, bytes)``, and into how many each is cut.

    Key ranges are counted, and heavy ranges counted again in FANOUT parts, until no range
    holds more than a shard or a range is a single key. Such a key is a shard of its own,
    which is cut into several.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("bytes").alias("all")).first()
    if total["lo"] is None:
        return np.empty(0, dtype=np.int64), np.ones(1, dtype=np.int64)
    lo, want = total["lo"], max(shard_bytes, -(-int(total["all"]) // max_shards), 1)
    width, span = 1, total["hi"] - lo + 1
    while width < span:  # widths are powers of FANOUT, so finer ranges nest in coarser ones
        width *= FANOUT
    light: list[tuple[int, int]] = []  # (first offset, bytes)
    heavy = [(0,)]
    at = F.col("key").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")
    start = lambda w: (F.floor(at / F.lit(w)) * w).cast("decimal(20,0)")
    while heavy:
        part = max(1, width // FANOUT)
        near_ = F.broadcast(spark.createDataFrame([(Decimal(h[0]),) for h in heavy], "base decimal(20,0)"))  # at most a row a shard
        inside = sizes.withColumn("base", start(width)).join(near_, "base")
        found = inside.groupBy(start(part).alias("first")).agg(F.sum("bytes").alias("n")).collect()
        heavy = [(int(r["first"]),) for r in found if r["n"] > want and part > 1]
        light += [(int(r["first"]), int(r["n"])) for r in found if not (r["n"] > want and part > 1)]
        width = part
    light.sort()
    bounds, cuts, held = [], [1], 0
    for offset, n in light:
        if held and held + n > want:
            bounds.append(lo + offset)
            cuts.append(1)
            held = 0
        held += n
        cuts[-1] = max(cuts[-1], -(-n // want))
    return np.asarray(bounds, dtype=np.int64), np.asarray(cuts, dtype=np.int64)


def shard_bounds(sizes: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> np.ndarray:
    """First keys of the shards after the first."""
    return shard_cuts(sizes, shard_bytes, max_shards)[0]


def _shard(bounds: np.ndarray, cuts: np.ndarray, bare: int):
    """The shard of a key and a number that deals the rows of a hot key; null keys have the first ``bare`` shards."""
    starts = bare + np.cumsum(cuts) - cuts

    @F.pandas_udf("int")
    def shard(key, deal):
        import pandas as pd

        base = np.searchsorted(bounds, key.fillna(0).to_numpy(dtype=np.int64), side="right")
        deal = deal.to_numpy(dtype=np.int64)
        return pd.Series(np.where(key.isna(), deal % max(1, bare), starts[base] + deal % cuts[base]).astype(np.int32))

    return shard


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> Archive:
    """Writes a record per row and returns the archive.

    A null payload is an empty one, a long one is written whole. Of rows with equal payloads
    of at least ``min_revisit_bytes`` bytes those with the smallest id are responses and the
    others revisit it; smaller payloads are responses. Null ids sort first and are responses
    only if their payload's ids are all null. Repeated rows give repeated records, each with
    an id of its own. The rows of a hot id, or without one, share several shards. Other
    columns aren't read. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.unhex(F.sha2(body, 256)).alias("sha"))
    size = F.octet_length("payload")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f")
    shared = rows.groupBy("sha").agg(first, F.count("*").alias("n")).where("n > 1").select("sha", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), F.lit(1).alias("n"))
    shared = near(table(shared, "shared"))
    weighed = rows.select(F.col("page_id").alias("key"), (size + 400).cast("bigint").alias("bytes"))
    bounds, cuts = shard_cuts(weighed.where("key IS NOT NULL"), shard_bytes)
    bare = int(weighed.where("key IS NULL").agg(F.sum("bytes")).first()[0] or 0)
    bare = min(MAX_SHARDS, -(-bare // shard_bytes))

    same = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("-")), F.hex("sha"))
    keyed = rows.withColumn("same", F.md5(same))
    again = keyed.drop("payload").join(shared, "sha", "left_semi").groupBy("same").agg(F.count("*").alias("n")).where("n > 1")
    keyed = rows.withColumn("number", F.lit(0).cast("bigint")) if again.isEmpty() else numbered(keyed, "same").drop("same")
    packed = keyed.mapInArrow(_responses, "page_id bigint, url string, size bigint, sha binary, number bigint, digest string, member binary")
    revisit = F.col("n").isNotNull() & (F.col("size") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    shards = bare + int(cuts.sum())
    deal = F.pmod(F.xxhash64("url", "sha", "number"), F.lit(1 << 31))
    ready = packed.join(shared, "sha", "left").withColumn("shard", _shard(bounds, cuts, bare)("page_id", deal))
    ready = ready.select("shard", "page_id", "url", "size", "digest", F.when(~revisit, F.col("member")).alias("member"), "first", "first_url", "number", "sha", dealt(spark, "shard", shards).alias("to"))
    ready = ready.repartition(shards, "to").sortWithinPartitions("shard", "page_id", "url", "sha", "number").drop("sha", "to")
    fs, root = _filesystem(folder)
    fs.create_dir(posixpath.join(root, "_temporary"), recursive=True)
    ready.mapInArrow(_write(folder, roll_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return open_archive(spark, folder)


def open_archive(spark: SparkSession, folder: str) -> Archive:
    return Archive(folder, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip stream of members."""
    lines = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while version := lines.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head: dict[str, str] = {}
        while (line := lines.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        yield head, lines.read(int(head["Content-Length"]))


def _parse(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if head["WARC-Block-Digest"] != f"sha1:{_digest32(block)}" or not revisit and (_digest32(payload) != sha or len(payload) != size):
        raise ValueError(f"digest mismatch in record {head['WARC-Record-ID']}")
    number = lambda name: int(head[name]) if head.get(name) else None
    return number("WARC-Record-Key"), head.get("WARC-Target-URI"), size, sha, head["WARC-Type"], number("WARC-Refers-To-Key") if revisit else None, None if revisit else payload


def read_archive(a: Archive, payloads: bool = True) -> DataFrame:
    """A row per record, read back from the files that the manifest names, digests verified."""
    folder = a.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                fs, root = _filesystem(folder)
                held, size = [], 0
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for head, block in records(stream):
                        row = _parse(head, block)
                        held.append(row if payloads else (*row[:-1], None))
                        size += len(block) if payloads else 200
                        if size > 8 << 20:
                            yield batch(held)
                            held, size = [], 0
                yield batch(held)

    files = a.manifest.select("file")
    n = max(1, a.manifest.count())
    return files.repartition(n, "file").mapInArrow(run, RECORDS)


def warc_round_trip(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives ``pages`` and reads the archive back, without the payloads."""
    return read_archive(archive(pages, roll_bytes=roll_bytes), payloads=False).drop("payload")
