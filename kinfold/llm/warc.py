"""WARC archives with a two-level capture index.

Records are written as gzip members, one archive for each task. The index has one line per capture, keyed
by the reversed host, the path and the page, sorted across tasks and stored in compressed blocks. Each
index file has a sparse directory with the first key of every block, and a list of the files' first keys
stands on top. A lookup searches list and directory by bisection, reads one block by range, and then the
record by range.

A task that is run again writes files of its own; only the files named in rows that Spark committed count.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, shared_folder, shuffle_partitions, small_batches, stored

BLOCK_LINES = 1024
SALTS = 16
#: So many repeated digests, of about 100 bytes each, may be sent to every task.
BROADCAST_DIGESTS = 100_000
#: Pages carry no time of capture, so all records have this one.
CAPTURED = "2000-01-01T00:00:00Z"
GZIP_LEVEL = 3
_URN = "<urn:page:{}>"


def capture_key(url: Column, page_id: Column) -> Column:
    """Reversed host labels, path and query in lower case, then the page; a URL without host comes under ``-``."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    surt = F.when(host == "", F.lit("-")).otherwise(F.concat(labels, F.lit(")"), rest))
    page = page_id.cast("string")
    page = F.coalesce(F.lpad(page, F.greatest(F.length(page), F.lit(20)), F.lit("0")), F.lit("-"))
    # Line breaks and blanks would break index lines.
    return F.concat(F.regexp_replace(surt, r"\s", "%20"), F.lit(" "), page)


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``digest`` (hex SHA-1 of html), ``record_type`` and ``refers_to`` to (page_id, url, html).

    Digests are judged without their payloads; those that occur more than once, each with its response, are
    stored and counted. Up to ``BROADCAST_DIGESTS`` of them go to every task, and no payload is shuffled. More
    are joined on the digest and a salt, so that a payload that many pages share is dealt out.
    """
    page = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha1("html")).withColumn("_long", F.octet_length("html") >= least_bytes)
    again = page.where("_long").groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = stored(again, "repeated")
    if again.count() <= BROADCAST_DIGESTS:
        joined = page.join(F.broadcast(again), "digest", "left")
    else:
        salted = again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        page = page.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = page.join(salted, ["digest", "_salt"], "left")
    revisit = F.col("_long") & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's full length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_URN.format(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_URN.format(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record header, HTTP header and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _compress(data: bytes) -> bytes:
    member = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``with_record_types``; the capture rows (key, file, at, size)."""
    small_batches(pages.sparkSession)
    source = pages.select("page_id", "url", "html", "digest", "record_type", "refers_to", capture_key(F.col("url"), F.col("page_id")).alias("key"))

    def run(batches):
        fs, root = _open(folder)
        out, at = None, 0
        try:
            for batch in bounded_batches(batches, 4 << 20):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                starts, sizes = [], []
                for page_id, url, html, digest, kind, refers_to in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    url = "".join((url or "-").split()) or "-"
                    digest = base64.b32encode(bytes.fromhex(digest)).decode()
                    data = _compress(record(page_id, url, html.encode(), digest, kind, refers_to))
                    out.write(data)
                    starts.append(at)
                    sizes.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([batch.column(6), pa.array([name] * batch.num_rows), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return stored(source.mapInArrow(run, "key string, file string, at long, size long"), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted index; returns one row per index file (first, last, name): the top level."""
    ranged = captures.repartitionByRange(shuffle_partitions(captures.sparkSession), "key", "file", "at").sortWithinPartitions("key", "file", "at")

    def run(batches):
        fs, root = _open(folder)
        held, blocks, at, out, name, last = [], [], 0, None, uuid.uuid4().hex, ""

        def close_block():
            nonlocal at
            data = _compress("".join(held).encode())
            blocks.append(f"{held[0].rsplit(chr(9), 3)[0]}\t{at}\t{len(data)}\n")
            out.write(data)
            at += len(data)
            held.clear()

        for batch in batches:
            if batch.num_rows and out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.cdx", compression=None)
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append("{}\t{}\t{}\t{}\n".format(*row))
                last = row[0]
                if len(held) == BLOCK_LINES:
                    close_block()
        if out is None:
            return
        if held:
            close_block()
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as directory:
            directory.write("".join(blocks).encode())
        yield pa.RecordBatch.from_arrays([pa.array([blocks[0].split("\t")[0]]), pa.array([last]), pa.array([name])], names=["first", "last", "name"])

    return stored(ranged.mapInArrow(run, "first string, last string, name string"), "index")


class Reader:
    """Looks captures up in an index whose top level is ``files`` (first, last, name), in order of first."""

    def __init__(self, folder: str, index: str, files: list[tuple[str, str, str]]):
        self.fs, self.root = _open(folder)
        self.index = _open(index)[1]
        self.files = sorted(files)
        self.first = [f[0] for f in self.files]
        self.directory: tuple[str, list[str], list[tuple[int, int]]] = ("", [], [])
        self.block: tuple[tuple[str, int], list[list[str]]] = (("", -1), [])
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def _file(self, path: str) -> pa.NativeFile:
        if path not in self.open:
            if len(self.open) >= 64:
                self.open.popitem(last=False)[1].close()
            self.open[path] = self.fs.open_input_file(path)
        self.open.move_to_end(path)
        return self.open[path]

    def _load_directory(self, name: str) -> None:
        if self.directory[0] != name:
            with self.fs.open_input_file(f"{self.index}/{name}.idx") as file:
                rows = [line.rsplit("\t", 2) for line in file.read().decode().split("\n") if line]
            self.directory = (name, [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows])

    def _lines(self, name: str, k: int) -> list[list[str]]:
        if self.block[0] != (name, k):
            at, size = self.directory[2][k]
            text = gzip.decompress(self._file(f"{self.index}/{name}.cdx").read_at(size, at)).decode()
            self.block = ((name, k), [line.rsplit("\t", 3) for line in text.split("\n") if line])
        return self.block[1]

    def captures(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, start, size) of all captures with this key."""
        out = []
        for f in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
            _, last, name = self.files[f]
            if last < key:
                continue
            self._load_directory(name)
            firsts = self.directory[1]
            for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                lines = self._lines(name, k)
                for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
                    if line[0] != key:
                        break
                    out.append((line[1], int(line[2]), int(line[3])))
        return out

    def read(self, capture: tuple[str, int, int]) -> bytes:
        name, at, size = capture
        return gzip.decompress(self._file(f"{self.root}/{name}").read_at(size, at))


def look_up(requests: DataFrame, folder: str, index: str, files: DataFrame) -> DataFrame:
    """Read the captures for (page_id, url) rows: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Requests are range-partitioned by key, so each task reads neighbouring blocks once. ``files`` is the
    index's top level, one row for each index file: as many as there are shuffle partitions.
    The length and digest of a revisit are its own headers', those of a response are taken from its
    payload; ``payload`` is null for a revisit.
    """
    top = [(r["first"], r["last"], r["name"]) for r in files.collect()]
    kind = requests.schema["page_id"].dataType.simpleString()
    keyed = requests.select("page_id", capture_key(F.col("url"), F.col("page_id")).alias("key"))
    ranged = keyed.repartitionByRange(shuffle_partitions(requests.sparkSession), "key").sortWithinPartitions("key")
    schema = f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary"

    def run(batches):
        reader, last, found = Reader(folder, index, top), None, []
        for batch in bounded_batches(batches):
            if batch.num_rows > 256:
                slices = [batch.slice(k, 256) for k in range(0, batch.num_rows, 256)]
            else:
                slices = [batch]
            for part in slices:
                rows = []
                for page_id, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if key != last:  # rows that repeat a key take its captures in turn
                        last, found = key, iter(reader.captures(key))
                    fields, http, payload = parse(reader.read(next(found)))
                    target = fields.get("WARC-Refers-To")
                    if fields["WARC-Type"] == "response":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"record of page {page_id} is damaged")
                        rows.append((page_id, len(payload), digest, "response", None, payload))
                    else:
                        rows.append((page_id, int(http["Content-Length"]), fields["WARC-Payload-Digest"][5:], "revisit", target[len("<urn:page:") : -1], None))
                ids = part.column(0)
                columns = list(zip(*rows))
                refers = pa.array(columns[4], pa.string()).cast(ids.type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), refers, pa.array(columns[5], pa.binary())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return ranged.mapInArrow(run, schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) as WARC archives, index them and read every page back through the index.

    A null html is an empty payload, a null or blank URL is recorded as ``-``. Of records with equal
    payloads of at least ``least_bytes`` bytes the one with the smallest page_id is the response (all of
    them, if that very page repeats), the others are revisits of it; a null page_id comes after all ids,
    and where all are null all are responses. Repeated rows are records of their own. An empty table gives
    an empty result. Other columns are ignored.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    captures = write_archives(with_record_types(pages, least_bytes), folder)
    files = build_index(captures, f"{folder}/index")
    return look_up(pages, folder, f"{folder}/index", files)
