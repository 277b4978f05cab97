"""WARC archives with a two-level capture index.

Tasks write gzip members, one per record, to archive files in a shared folder and return a capture row (key, file,
offset, length) per record. The index sorts captures by reversed-host URL key into compressed blocks of lines; a sparse
directory has one row per block. A lookup finds the index file by its key range, binary-searches that file's directory
rows, reads the block's byte range, and then the record's.

Equal payloads of at least ``least`` bytes are stored once: the record of the largest page_id is the response, the others
are revisits that name it. Files get a new name in every attempt, and the stored capture table names only those of
successful tasks, so a lost executor leaves at most files that nothing refers to.

Defined results: null html is an empty payload; a null url is an empty key without a target header; a row without page_id
is always a response and nothing refers to it; rows that repeat a response's page_id are responses too; an empty table
gives empty archives and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import raw, sized_batches, stored

LEAST_BYTES = 1000
BLOCK_LINES = 512
FILE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, page_id {id}, url string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, a closing bracket, then path and query; no scheme, no fragment."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return ")" + (url or "").partition("#")[0]
    host = ",".join(reversed(m[1].lower().strip(".").split(".")))
    return host + (m[2] or "") + ")" + (m[3] or "/")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record before compression; a revisit keeps the HTTP head, with the full length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    top, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:]), payload


def squeeze(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Append-only files of one task, each closed before a new one starts."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.suffix, self.out, self.name, self.at = suffix, None, "", 0

    def append(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(data) > FILE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        begin, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return self.name, begin, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Ranges:
    """Byte ranges of files in a folder; the last file stays open."""

    def __init__(self, folder: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest and refers_to of rows whose payload a larger page_id has too."""
    facts = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length("html").alias("bytes"))
    facts = facts.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).drop("bytes")
    winners = facts.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return facts.join(winners, "digest").where("page_id <> refers_to").distinct()


@dataclass(frozen=True)
class Archive:
    """A folder of archive and index files, with the stored block directory."""

    folder: str
    directory: DataFrame
    id_type: str

    def captures(self) -> DataFrame:
        """All captures, read from the index blocks."""
        folder, kind = self.folder, _arrow(self.id_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges = _Ranges(folder)
            for batch in batches:
                for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield _captures(list(_lines(ranges.read(name, offset, length))), kind)
            ranges.close()

        return self.directory.select("file", "offset", "length").mapInArrow(run, CAPTURE.format(id=self.id_type))

    def find(self, urls: DataFrame) -> DataFrame:
        """Captures of the given urls (a column url); each distinct key is looked up once."""
        # One row an index file, so as many as tasks that wrote the index, however many captures there are.
        bounds = sorted(
            tuple(r) for r in self.directory.groupBy("file").agg(F.min("first_key"), F.max("last_key")).select("min(first_key)", "max(last_key)", "file").collect()
        )
        folder, kind = self.folder, _arrow(self.id_type)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts = [b[0] for b in bounds]
            for batch in batches:
                out = [(b[2], key) for key in map(url_key, batch.column("url").to_pylist()) for b in bounds[: bisect_right(firsts, key)] if b[1] >= key]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["file", "urlkey"])

        def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values(["last_key", "offset"])
            lasts, firsts, ranges, hits = right["last_key"].tolist(), right["first_key"].tolist(), _Ranges(folder), []
            wanted: dict[int, set[str]] = {}
            for key in left["urlkey"]:
                block = bisect_left(lasts, key)
                while block < len(lasts) and firsts[block] <= key:
                    wanted.setdefault(block, set()).add(key)
                    block += 1
            for block, keys in wanted.items():
                row = right.iloc[block]
                hits += [c for c in _lines(ranges.read(row["file"], int(row["offset"]), int(row["length"]))) if c[0] in keys]
            ranges.close()
            return _captures(hits, kind).to_pandas()

        keys = urls.select("url").distinct().mapInArrow(place, "file string, urlkey string").distinct()
        return keys.groupBy("file").cogroup(self.directory.groupBy("file")).applyInPandas(search, CAPTURE.format(id=self.id_type))

    def read(self, captures: DataFrame | None = None, payloads: bool = False) -> DataFrame:
        """Records of captures (all by default), by byte range; payloads of responses are held against their digests."""
        folder, kind, number = self.folder, _arrow(self.id_type), self.id_type != "string"
        rows = (self.captures() if captures is None else captures).select("file", "offset", "length")
        rows = rows.repartition("file").sortWithinPartitions("file", "offset")

        def identity(value: str | None):
            text = (value or "")[len("<urn:page:") : -1]
            return None if not text else int(text) if number else text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges = _Ranges(folder)
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(3)]
                for start in range(0, batch.num_rows, 256):
                    out = []
                    for name, offset, length in zip(*(c[start : start + 256] for c in columns), strict=True):
                        warc, http, payload = parse(zlib.decompress(ranges.read(name, offset, length), 31))
                        digest = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if warc["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {name} at {offset} does not fit its digest")
                        out.append(
                            (identity(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), int(http["Content-Length"]), digest, warc["WARC-Type"],
                             identity(warc.get("WARC-Refers-To")), payload if payloads else None)
                        )
                    kinds = (kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                        ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                    )
            ranges.close()

        made = rows.mapInArrow(
            run, f"page_id {self.id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {self.id_type}, payload binary"
        )
        return made if payloads else made.drop("payload")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]


def _lines(block: bytes) -> Iterator[tuple]:
    for line in zlib.decompress(block, 31).decode().split("\n"):
        key, page, url, name, offset, length = line.split("\t")
        yield key, page, url, name, int(offset), int(length)


def _captures(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids = [None if r[1] == "" else r[1] if pa.types.is_string(kind) else int(r[1]) for r in rows]
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array(ids, kind), pa.array([r[2] for r in rows], pa.string()),
               pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["urlkey", "page_id", "url", "file", "offset", "length"])


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_BYTES) -> Archive:
    """Write archives and index of all rows (page_id, url, html) to a folder that all executors share."""
    kind = dict(pages.dtypes)["page_id"]
    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    rows = rows.join(revisits(pages, least).hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        for batch in sized_batches(batches, "html"):
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            out = []
            for page_id, url, payload, digest, refer in zip(ids, urls, raw(batch.column("html")), digests, refers, strict=True):
                name, offset, length = files.append(squeeze(record(page_id, url, payload, digest, refer, date)))
                out.append((url_key(url), "" if page_id is None else str(page_id), url or "", name, offset, length))
            yield _captures(out, _arrow(kind))
        files.close()

    captured = stored(rows.mapInArrow(records, CAPTURE.format(id=kind)))
    # page_id splits a key that very many captures share
    ordered = captured.repartitionByRange("urlkey", "page_id", "offset").sortWithinPartitions("urlkey", "page_id", "offset")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = _Files(folder, ".idx.gz"), []

        def flush() -> pa.RecordBatch:
            place = files.append(squeeze("\n".join(line for _, line in held).encode()))
            row = (held[0][0], held[-1][0], len(held), *place)
            held.clear()
            return pa.RecordBatch.from_pylist(
                [dict(zip(("first_key", "last_key", "lines", "file", "offset", "length"), row, strict=True))],
                pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]),
            )

        for batch in batches:
            for key, page_id, url, name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                fields = (_flat(key), "" if page_id is None else str(page_id), _flat(url), name, str(offset), str(length))
                held.append((fields[0], "\t".join(fields)))
                if len(held) == BLOCK_LINES:
                    yield flush()
        if held:
            yield flush()
        files.close()

    directory = stored(ordered.mapInArrow(blocks, "first_key string, last_key string, lines long, file string, offset long, length long"))
    return Archive(folder, directory, kind)


def _flat(text: str) -> str:
    """Tabs and line ends would break an index line."""
    return re.sub(r"[\t\r\n]", lambda c: f"%{ord(c[0]):02X}", text)
