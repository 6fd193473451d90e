"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Writing: payload digests meet in one aggregate (smallest page id per digest), pages join it, and every task writes its
rows as one gzip member per record into one file. A file is written under a temporary name and renamed when complete;
its name depends only on the run and the partition, so a repeated task replaces its file and no record comes twice.

Reading: a member or record that fails a check (compression, version line, header, length, payload digest) is
quarantined: the reader searches the next gzip magic or version line that starts a valid record, logs the bytes it
skipped with the reason, and goes on from there. The same search runs over the inflated bytes of a member, and over
what inflated before its damage, so a bad record takes no other record of its member with it. Files are spread over tasks; one file is in memory at a time.

Defined cases: a null html is an empty payload; a null page id gives a record without an id (null when read); rows that
repeat the smallest page id of a payload are responses like it; an empty table writes and reads no records; line
breaks in an url are percent-encoded; a null url has no target header; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import cut

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Size at which the writer opens the next file, 1 GB by the format's custom.
MAX_BYTES = 1 << 30
MIN_REVISIT = 100


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes | None, length: int, refers_to: str | None) -> bytes:
    """One record; a revisit has the HTTP header only, whose content length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + END + block + END


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT,
          max_bytes: int = MAX_BYTES) -> DataFrame:
    """Writes the archives into ``folder`` (on a store all executors reach); returns file, records and bytes.

    A file that has reached ``max_bytes`` is closed and the next one opened: the reader takes a file as one value.
    """
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = F.octet_length("html") >= min_revisit
    first = rows.filter(large).groupBy("digest").agg(F.min("id").alias("first"))
    met = rows.join(first, "digest", "left").select("id", "url", "html", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    files, base = store(folder)
    files.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, base = store(folder)
        name = f"part-{context.partitionId():06d}-"
        temp = lambda k: f"{base}/_{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}"
        out, sizes, counts = None, [], []
        for batch in batches:
            for page, url, text, digest, refers in zip(*batch.columns, strict=True):
                if out is None:
                    out = files.open_output_stream(temp(len(sizes)), compression=None)
                    counts.append(0)
                page, refers = page.as_py(), refers.as_py()
                raw = text.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                kind = "response" if refers is None else "revisit"
                out.write(member(record(kind, "" if page is None else str(page), url.as_py(), digest.as_py(), raw if refers is None else None, len(raw), refers)))
                counts[-1] += 1
                if out.tell() >= max_bytes:
                    sizes.append(out.tell())
                    out.close()
                    out = None
        if out is not None:
            sizes.append(out.tell())
            out.close()
        final = [f"{base}/{name}{k:04d}.warc.gz" for k in range(len(sizes))]
        for k, path in enumerate(final):
            files.move(temp(k), path)
        # a lost attempt may have left more files than this one has
        for old in files.get_file_info(pafs.FileSelector(base)):
            if old.base_name.startswith(name) and old.base_name not in {p.rsplit("/", 1)[1] for p in final}:
                files.delete_file(old.path)
        yield pa.RecordBatch.from_arrays([pa.array(final, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return cut(met.mapInArrow(run, "file string, records long, bytes long"))


def _header(raw: bytes, at: int) -> tuple[dict[str, str], int] | str:
    """Fields of the header at a version line and where the block starts, or what is wrong."""
    if raw[at : at + 5] != b"WARC/":
        return "no version line"
    stop = raw.find(END, at)
    if stop < 0:
        return "header without end"
    fields = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header"
        key = name.strip().lower().decode("latin-1")
        if key in fields and key in ("content-length", "warc-type", "warc-record-id"):
            return "malformed header"  # a header cut short and the next one
        fields[key] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return "header lacks fields"
    return fields, stop + 4


def parse(raw: bytes, at: int) -> tuple[dict, int] | str:
    """The record at a place and where it ends, or what is wrong with it."""
    got = _header(raw, at)
    if isinstance(got, str):
        return got
    fields, begin = got
    end = begin + int(fields["content-length"])
    if raw[end : end + 4] != END:
        return "length does not meet the record's end"
    block = raw[begin:end]
    head, _, payload = block.partition(END) if block.startswith(b"HTTP/") else (b"", b"", block)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    length = len(payload)
    if kind == "revisit":
        told = [line.partition(b":")[2].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        length = int(told[0]) if told and told[0].isdigit() else None
        payload = None
    else:
        own = hashlib.sha256(payload).hexdigest()
        if digest and fields.get("warc-payload-digest", "").startswith("sha256:") and digest != own:
            return "payload digest differs"
        digest = own
    name = lambda k: fields.get(k, "").strip("<>").removeprefix("urn:page:") or None
    return {"type": kind, "record_id": name("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": name("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": length, "payload": payload}, end + 4


PIECE = 1 << 16


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str | None]:
    """What the gzip member at a place inflates to, where it ends (None if it doesn't), and what is wrong with it."""
    z, out, place = zlib.decompressobj(31), [], at
    while place < len(data):
        piece = data[place : place + PIECE]
        try:
            out.append(z.decompress(piece))
        except zlib.error:
            # what the failed call inflated is lost: once more up to it, then by single bytes
            z = zlib.decompressobj(31)
            out = [z.decompress(data[x : x + PIECE]) for x in range(at, place, PIECE)]
            try:
                for i in range(len(piece)):
                    out.append(z.decompress(piece[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, "damaged compression"
        place += len(piece)
        if z.eof:
            return b"".join(out), place - len(z.unused_data), None
    return b"".join(out), None, "truncated member"


def _inner(raw: bytes, doubtful: bool) -> tuple[list[dict], list[tuple[int, int, str]], int]:
    """The records of inflated bytes, the gaps between them (start, end, reason), and where the last record ends.

    Damaged compression can read on as copies of what came before: there a record of the very bytes of an earlier one is a gap.
    """
    records, gaps, place, last, why = [], [], 0, 0, ""
    seen: set[bytes] = set()
    while place < len(raw):
        got = parse(raw, place)
        if doubtful and not isinstance(got, str):
            mark = hashlib.sha256(raw[place : got[1]]).digest()
            if mark in seen:
                why = "repeats a record, in a damaged member" if place == last else why
                place = got[1]
                continue
            seen.add(mark)
        if isinstance(got, str):
            if place == last:
                why = got
            if got == "payload digest differs":  # its length holds: what its payload looks like is no record
                fields, begin = _header(raw, place)
                place = begin + int(fields["content-length"]) + 4
            else:
                place = raw.find(b"WARC/", place + 1)
                place = len(raw) if place < 0 else place
            continue
        if place > last:
            gaps.append((last, place, why))
        records.append(got[0])
        place = last = got[1]
    if last < len(raw):
        gaps.append((last, len(raw), why))
    return records, gaps, last


def _told(why: str, start: int, end: int) -> str:
    return f"{why}; bytes {start} to {end} of the inflated member"


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """offset, length, reason, record: records in file order, and the byte gaps that had to be skipped.

    Records of a member that is damaged further on have the offset and length of the gap that it leaves in the file; gaps
    inside an intact member have its offset and length, and their place in the inflated bytes in the reason.
    """
    at, n = 0, len(data)
    bad, why = None, None
    while at < n:
        got: list[dict] | str
        gaps: list[tuple[int, int, str]] = []
        held: list[dict] = []
        skip, end = 1, n
        if data.startswith(MAGIC, at):
            raw, stop, wrong = _inflate(data, at)
            records, gaps, last = _inner(raw, wrong == "damaged compression")
            if wrong is None and (records or not raw):
                got, end = records, stop
            else:
                got = wrong or gaps[0][2]
                if records:  # only in a damaged member; what follows its last record may be the next member
                    held, got = records, "; ".join([got, *[_told(w, a, b) for a, b, w in gaps]])
                    z = zlib.decompressobj(31)
                    done, last = at, last - 1  # not to the very end, where the check sum may be wrong
                    while last > 0:
                        piece = data[done : done + PIECE]
                        last -= len(z.decompress(piece, last))
                        done += len(piece) - len(z.unconsumed_tail)
                    skip = max(1, done - at)
        elif data.startswith(b"WARC/", at):
            one = parse(data, at)
            got, end = (one, n) if isinstance(one, str) else ([one[0]], one[1])
        else:
            got = "neither a member nor a version line"
        if isinstance(got, str):
            if held and bad is not None:
                yield bad, at - bad, why, None
                bad = None
            if bad is None:
                bad, why = at, got
            after = [x for x in (data.find(MAGIC, at + skip), data.find(b"WARC/", at + skip)) if x >= 0]
            following = min(after, default=n)
            if held:
                for r in held:
                    yield at, following - at, None, r
                yield at, following - at, why, None
                bad = None
            at = following
            continue
        if bad is not None:
            yield bad, at - bad, why, None
            bad = None
        for r in got:
            yield at, end - at, None, r
        for a, b, w in gaps:
            yield at, end - at, _told(w, a, b), None
        at = end
    if bad is not None:
        yield bad, n - bad, why, None


SCHEMA = ("file string, offset long, length long, reason string, type string, record_id string, uri string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record (reason null) and per quarantined gap (reason set) of all ``*.warc.gz`` and ``*.warc`` files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc.gz,warc}").load(folder).select("path", "content")
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for offset, length, reason, r in salvage(content.as_py()):
                    r = r or {}
                    rows.append((path.as_py(), offset, length, reason, *[r.get(k) for k in names[4:-1]], r.get("payload") if with_payload else None))
                    size += r.get("payload_bytes") or 0
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, SCHEMA)


def quarantine_log(read_rows: DataFrame) -> DataFrame:
    """file, offset, length and reason of every byte gap."""
    return read_rows.filter("reason is not null").select("file", "offset", "length", "reason")
