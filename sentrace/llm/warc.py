"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Archives are rows of binary pieces to Spark: its text source, with the first bytes of a compressed
member (or of a version line) as line separator, reads any part of a file on any store, so one
large archive is read by many tasks. A piece need not be a member: its separator also occurs by
chance inside compressed data and payloads. The reader therefore feeds pieces to a member until
that ends; the member must decompress, carry a whole record and agree with its digests. If a check
fails, its first piece is quarantined and the search goes on from the next piece, that is from the
next place that looks like a member or version line. What a part of a file leaves open at its ends
is joined with its neighbours in a second step. Gaps are logged with their place and reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrace.storage import materialise, scratch_path

#: Fixed values of the formats: how a compressed member and a version line begin, and a profile name.
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this size are always stored.
MIN_REVISIT_BYTES = 1000
#: A record that claims to be longer is quarantined, so that one damaged length does not swallow an archive.
MAX_RECORD_BYTES = 1 << 30
_BREAK = b"\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
_FIELDS = [
    ("kind", pa.string()),
    ("file", pa.string()),
    ("block", pa.int64()),
    ("at", pa.int64()),
    ("length", pa.int64()),
    ("reason", pa.string()),
    ("record_type", pa.string()),
    ("record_id", pa.string()),
    ("refers_to", pa.string()),
    ("target_uri", pa.string()),
    ("date", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("bytes", pa.binary()),
]
_SCHEMA = "kind string, file string, block long, at long, length long, reason string, record_type string, record_id string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, bytes binary"


# Writing


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _BREAK + block + _BREAK


def member_bytes(record: bytes, level: int = 6) -> bytes:
    """One compressed member; its last byte, and that of an empty member added if need be, is 0."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += pack.compress(b"") + pack.flush()
    return out


def _encode(compressed: bool, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                payload = row["payload"]
                digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}".encode() + _BREAK
                headers = [("WARC-Type", "revisit" if row["refers_to"] else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
                if row["url"] is not None:
                    headers.append(("WARC-Target-URI", urllib.parse.quote(row["url"], safe="".join(map(chr, range(33, 127))))))
                headers.append(("WARC-Payload-Digest", digest))
                if row["refers_to"]:
                    headers += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE)]
                headers.append(("Content-Type", "application/http; msgtype=response"))
                block = head + (b"" if row["refers_to"] else payload)
                headers.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()))
                record = record_bytes(headers, block)
                out.append(member_bytes(record)[:-1] if compressed else record[:-4])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    prefix: str = "urn:page:",
    date: str = "2020-01-01T00:00:00Z",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    compressed: bool = True,
) -> None:
    """Write one record per row of ``pages`` below ``path``, as members of their own (or plain records).

    The payload is the text in UTF-8, a null text is empty, a null url has no target. The record id is
    ``prefix`` and the row's id (``none`` if null). Of rows with equal payloads of at least
    ``min_revisit_bytes`` those with the largest id are responses; the others, and rows
    without id, are revisits that refer to it and hold the response's head but no payload. Rows that
    repeat are written as often as they stand. Characters of a url that may not stand in a
    header are percent-encoded. Other columns are not written.

    Spark's text writer puts the bytes down: the last byte of each member, or the end of a
    plain record, serves as its line separator. So tasks commit like those of any other table.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # Only one number for each payload that stands more than once; equal ones are counted before they are shuffled.
    shared = rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    planned = rows.join(shared.where("n > 1").drop("n"), ["digest", "size"], "left")
    name = F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.concat(F.lit(prefix), F.col("last").cast("string")))
    planned = planned.select("url", "payload", "digest", "size", name.alias("record_id"), refers.alias("refers_to"))
    text = planned.mapInArrow(_encode(compressed, date), "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\x00" if compressed else _BREAK.decode()).text(path)


# Reading


def parse_record(raw: bytes) -> dict | str:
    """Fields of a whole record, or what is wrong with it."""
    end = raw.find(_BREAK)
    if not _VERSION_LINE.match(raw) or end < 0:
        return "no header"
    if _VERSION_LINE.search(raw, 1, end):  # the head of a cut record, then another one
        return "two heads"
    headers = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        return "no length"
    block = raw[end + 4 : -4]
    if len(block) != int(headers["content-length"]) or raw[-4:] != _BREAK:
        return "wrong length"
    if "warc-block-digest" in headers and not _agrees(headers["warc-block-digest"], block):
        return "wrong block digest"
    kind, payload, size = headers.get("warc-type"), block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(_BREAK)
        told = [line.partition(b":")[2].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(told[0]) if kind == "revisit" and told and told[0].isdigit() else len(payload)
        plain = b"transfer-encoding:" not in head.lower()
    else:
        plain = True
    declared = headers.get("warc-payload-digest")
    if kind == "revisit":
        digest = _hex(declared)
    elif declared and plain and not _agrees(declared, payload):
        return "wrong payload digest"
    else:
        digest = hashlib.sha1(payload).hexdigest()
    strip = lambda x: x.strip("<>") if x else None
    return {
        "record_type": kind,
        "record_id": strip(headers.get("warc-record-id")),
        "refers_to": strip(headers.get("warc-refers-to")),
        "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "payload_bytes": size,
        "payload_digest": digest,
        "bytes": payload,
    }


def _hex(declared: str | None) -> str | None:
    """A declared SHA-1 in hex; archives have it in base 32 or hex."""
    name, _, value = (declared or "").partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError:
        return None


def _agrees(declared: str, data: bytes) -> bool:
    told = _hex(declared)
    return told is None or told == hashlib.sha1(data).hexdigest()


class _Member:
    """A compressed member that is fed piece by piece; ``feed`` tells 'more', 'bad' or 'done'."""

    def __init__(self):
        self.stream, self.parts, self.size, self.unused = zlib.decompressobj(31), [], 0, 0

    def feed(self, piece: bytes) -> str:
        try:
            self.parts.append(self.stream.decompress(piece))
        except zlib.error:
            return "bad"
        self.size += len(self.parts[-1])
        self.unused = len(self.stream.unused_data)
        return "done" if self.stream.eof else "more"

    def record(self) -> dict | str | None:
        raw = b"".join(self.parts)
        return parse_record(raw) if raw else None


class _Plain:
    """A record that is not compressed: whole as soon as its declared length is there."""

    def __init__(self):
        self.raw, self.need, self.size, self.unused = bytearray(), None, 0, 0

    def feed(self, piece: bytes) -> str:
        self.raw += piece
        if self.need is None:
            end = self.raw.find(_BREAK)
            if end < 0:
                return "more" if len(self.raw) < 1 << 20 else "bad"
            length = [line.partition(b":")[2].strip() for line in bytes(self.raw[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:")]
            if not length or not length[0].isdigit():
                return "bad"
            self.need = end + 8 + int(length[0])
        self.size = self.need
        if len(self.raw) < self.need:
            return "more"
        if self.raw[self.need - 4 : self.need] != _BREAK:
            return "bad"
        self.unused = len(self.raw) - self.need
        return "done"

    def record(self) -> dict | str | None:
        return parse_record(bytes(self.raw[: self.need]))


@dataclass
class Salvage:
    """Records and gaps of pieces that follow each other."""

    kind: type
    most: int
    pending: list[tuple[int, bytes]] = field(default_factory=list)
    open_: object = None
    fed: int = 0

    def add(self, at: int, piece: bytes, headed: bool = True) -> Iterator[tuple]:
        """``headed``: the piece begins with the separator; without it, it can only be part of a gap."""
        if not headed:
            if piece:
                yield "gap", at, len(piece), "no member", None
            return
        self.pending.append((at, piece))
        yield from self._advance()

    def finish(self) -> Iterator[tuple]:
        """No piece follows: what is open is cut off."""
        while self.pending:
            yield from self._drop("cut off")
            yield from self._advance()

    def _drop(self, reason: str) -> Iterator[tuple]:
        at, piece = self.pending.pop(0)
        self.open_, self.fed = None, 0
        yield "gap", at, len(piece), reason, piece

    def _advance(self) -> Iterator[tuple]:
        while self.pending:
            if self.open_ is None:
                self.open_, self.fed = self.kind(), 0
            state = "more"
            while state == "more" and self.fed < len(self.pending):
                state = self.open_.feed(self.pending[self.fed][1])
                self.fed += 1
                if state == "more" and self.open_.size > self.most:
                    state = "long"
            if state == "more":
                return
            if state in ("bad", "long"):
                yield from self._drop("damaged" if state == "bad" else "too long")
                continue
            record, begin = self.open_.record(), self.pending[0][0]
            last_at, last = self.pending[self.fed - 1]
            if isinstance(record, str):  # whole, but not what it says: later pieces may hold a record of their own
                yield from self._drop(record)
                continue
            end = last_at + len(last) - self.open_.unused
            if record is not None:
                yield "record", begin, end - begin, None, record
            if self.open_.unused:
                yield "gap", end, self.open_.unused, "between members", None
            self.pending, self.open_, self.fed = self.pending[self.fed :], None, 0


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


def _read(mark: bytes, kind: type, most: int, payloads: bool):
    """Rows of kind record, gap, fragment (open at an end of its part of the file) and block (its size)."""

    def part(file: str, block: int, last: bool, pieces: Iterator[bytes]) -> Iterator[dict]:
        salvage, at, whole = Salvage(kind, most), 0, block == 0
        number = 0

        def told(found: Iterator[tuple]) -> Iterator[dict]:
            nonlocal whole
            for what, place, length, reason, more in found:
                row = {"file": file, "block": block, "at": place, "length": length}
                if what == "record":
                    whole = True
                    yield row | more | {"kind": "record"} | ({} if payloads else {"bytes": None})
                elif whole:
                    yield row | {"kind": "gap", "reason": reason}
                else:  # before the first record of a part: it may continue what the part before left open
                    yield row | {"kind": "fragment", "reason": reason, "bytes": more}

        for piece in pieces:
            headed = block > 0 or number > 0
            number += 1
            piece = mark + piece if headed else piece
            yield from told(salvage.add(at, piece, headed))
            at += len(piece)
        if last:
            yield from told(salvage.finish())
        for place, piece in salvage.pending:
            yield {"kind": "fragment", "file": file, "block": block, "at": place, "length": len(piece), "reason": "cut off", "bytes": piece}
        yield {"kind": "block", "file": file, "block": block, "at": 0, "length": at}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                files, blocks, lasts, values = (batch.column(i) for i in range(4))
                for i in range(batch.num_rows):
                    yield (files[i].as_py(), blocks[i].as_py(), lasts[i].as_py()), values[i].as_py()

        held, size = [], 0
        todo = rows()
        ahead = next(todo, None)
        while ahead is not None:
            key = ahead[0]

            def same() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:
                    value = ahead[1]
                    ahead = next(todo, None)
                    yield value

            for row in part(*key, same()):
                held.append(row)
                size += 200 + len(row.get("bytes") or b"")
                if size > 4 << 20:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return run


def _joined(kind: type, most: int, payloads: bool):
    """Salvage of the fragments of one file, where they follow each other without a break."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        file = table.column("file")[0].as_py()
        rows, salvage, end = [], Salvage(kind, most), None

        def told(found: Iterator[tuple]) -> None:
            for what, place, length, reason, more in found:
                row = {"kind": what, "file": file, "at": place, "length": length, "reason": reason}
                rows.append(row | (more | ({} if payloads else {"bytes": None}) if what == "record" else {}))

        for start, piece in zip(table.column("start").to_pylist(), table.column("bytes")):
            piece = piece.as_py()
            if end is not None and start != end:
                told(salvage.finish())
            told(salvage.add(start, piece))
            end = start + len(piece)
        told(salvage.finish())
        return pa.Table.from_batches([_batch(rows)])

    return run


def read_archives(
    spark: SparkSession, path: str, *, compressed: bool = True, payloads: bool = True, max_record_bytes: int = MAX_RECORD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives below ``path``.

    Records: file, record_type, record_id, refers_to, target_uri, date, payload_bytes,
    payload_digest (bare hex SHA-1 of the payload; of the full one it stands for in a revisit) and
    the payload as ``bytes`` (null without ``payloads``). A header that a record lacks is null.
    Gaps: file, at (byte), length and reason of every stretch that belongs to no record. An
    empty archive has neither. Record ids that repeat are returned as often as they stand.

    File names must not end like a compressed text file (``.gz``), or Spark unpacks them before
    this reader sees them; members are found in files of any other name. A record is held whole
    in one task, as is a damaged stretch between two records that spans parts of a file.
    """
    mark, kind = (MEMBER, _Member) if compressed else (VERSION, _Plain)
    lines = spark.read.option("lineSep", mark.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    place = F.col("_metadata")
    last = place["file_block_start"] + place["file_block_length"] >= place["file_size"]
    pieces = lines.select(place["file_path"].alias("file"), place["file_block_start"].alias("block"), last.alias("last"), F.col("value").cast("binary").alias("value"))
    told = materialise(pieces.mapInArrow(_read(mark, kind, max_record_bytes, payloads), _SCHEMA), "archive-rows")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of a file
    starts = told.where("kind = 'block'").select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    odd = told.where("kind IN ('gap', 'fragment')").join(starts, ["file", "block"]).withColumn("start", F.col("at") + F.col("base"))
    again = odd.where("kind = 'fragment' AND bytes IS NOT NULL").select("file", "start", "bytes")
    joined = again.groupBy("file").applyInArrow(_joined(kind, max_record_bytes, payloads), _SCHEMA)
    joined = materialise(joined, "joined-fragments")
    fields = ["file", "record_type", "record_id", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "bytes"]
    records = told.where("kind = 'record'").select(*fields).unionByName(joined.where("kind = 'record'").select(*fields))
    lost = odd.where("kind = 'gap' OR bytes IS NULL").select("file", F.col("start").alias("at"), "length", "reason")
    return records, lost.unionByName(joined.where("kind = 'gap'").select("file", "at", "length", "reason"))


def round_trip(pages: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` to archives in the shared folder and read them back: (records, gaps) without payloads."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, **options)
    return read_archives(spark, path, compressed=options.get("compressed", True), payloads=False)
