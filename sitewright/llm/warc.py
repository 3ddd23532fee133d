"""WARC archives: writing captures, and assembling transactions from records read back.

Writing: a page gives a request record, a response or revisit record and a metadata record. Of equal payloads
of at least LEAST_REVISIT bytes the one with the largest id is a response and the others revisit it; which
ones are equal is told by SHA-256 over small rows, and the payloads are not shuffled unless the repeated
digests are too many to broadcast. Spark's text writer makes the files, with the record separator as line
separator, so any file system that Spark reaches will do; a file holds at most PAGES_A_FILE pages.

Reading: files, of one gzip member or many, are streamed and parsed by content length, never by searching for a separator, which a payload may contain.
Request and metadata records name the response they belong to in WARC-Concurrent-To; joins on that identifier
give one nested row for each capture. Revisits find the payload's length through WARC-Refers-To.

Null payload counts as empty, a null url as an address made from the id; line ends in a url are percent-coded.
A null id has no page-id line and is read back as null; it is smaller than any other. Rows repeated with equal
id and payload have equal record ids and are of one type, each a capture. Responses without request or metadata records have null there; without responses the result is empty. Columns other
than the three named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlsplit
from urllib.request import url2pathname

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, joined_hot, new_path, save

LEAST_REVISIT, PAGES_A_FILE = 1000, 2000
CRLF, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(kind: str, page: Column, sha: Column) -> Column:
    """The same for the same page and payload, however often a task runs."""
    h = F.md5(F.concat_ws("|", F.lit(kind), filled(page.cast("string")), F.hex(sha)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, block: Column, ident: Column, uri: Column, media: str, *more: Column) -> Column:
    """One record without the separator after it; the fields in more carry their own line ends, or are null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), ident, F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}Content-Type: {media}{CRLF}"), *[filled(m) for m in more], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return F.concat(head, block)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), filled(F.col(payload_col).cast("string")).alias("payload"))
    body, page, sha = F.col("payload").cast("binary"), F.col("page"), F.col("sha")
    large = F.octet_length("payload") >= LEAST_REVISIT
    keyed = base.withColumn("sha", F.unhex(F.sha2(body, 256)))
    seen = keyed.where(large).groupBy("sha").agg(F.max("page").alias("top"), F.count("*").alias("n"))
    again = save(seen.where("n > 1"), "warc-repeated")
    # a payload may be that of a third of all pages
    known = joined_hot(keyed, again, ["sha"], "n")
    revisit = F.coalesce(large & F.col("top").isNotNull() & ~page.eqNullSafe(F.col("top")), F.lit(False))
    uri = F.coalesce(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.concat(F.lit("urn:page:"), filled(page.cast("string"))))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(body)))
    main = record_id("response", page, sha)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))), main, uri, "application/http; msgtype=response", digest,
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record_id("response", F.col("top"), sha)))),
    )
    belongs = _line("WARC-Concurrent-To", main)
    request = _record("request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}")), record_id("request", page, sha), uri, "application/http; msgtype=request", belongs)
    fields = F.concat(F.coalesce(_line("page-id", page.cast("string")), F.lit("")), _line("fetcher", F.lit("pages")))
    about = _record("metadata", fields, record_id("metadata", page, sha), uri, "application/warc-fields", belongs)
    text = known.select(F.concat_ws(END, request, answer, about).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", PAGES_A_FILE).text(path)


_SCHEMA = "kind string, record string, concurrent_to array<string>, refers_to string, uri string, declared string, payload_bytes long, payload_sha1 string, block binary"
#: Bytes read at once, and of blocks that one batch carries; bytes of a header, at most.
CHUNK, BATCH, HEAD = 1 << 20, 8 << 20, 16 << 20


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of an archive, whose gzip members may be any number, a bounded piece at a time."""
    chunks, begin = iter(chunks), b""
    while len(begin) < 2 and (data := next(chunks, b"")):
        begin += data
    unzip = zlib.decompressobj(31) if begin[:2] == b"\x1f\x8b" else None
    for data in chain([begin], chunks):
        if unzip is None:
            yield data
            continue
        while data:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            yield unzip.decompress(data, CHUNK)
            data = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
    while unzip is not None and not unzip.eof:
        rest = unzip.decompress(unzip.unconsumed_tail, CHUNK)
        if not rest:
            raise ValueError("the archive ends within a member")
        yield rest


class _Bytes:
    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, bytearray(), 0

    def more(self) -> bool:
        for data in self.chunks:
            if data:
                self.held += data
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before a mark; None at the end."""
        begin = 0
        while (end := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > HEAD:
                raise ValueError(f"the header at byte {self.at} has no end")
            if not self.more():
                if self.held:
                    raise ValueError(f"the record at byte {self.at} is cut off")
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        self.at += end + len(mark)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError(f"the record at byte {self.at} is cut off")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n, self.at = n - len(out), self.at + len(out)
            yield out


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], Iterator[bytes]]]:
    """Header fields (names in lower case, all values of each) and the pieces of the block of each record. No
    block is held; what a caller leaves of one is passed over."""
    source = _Bytes(iter(chunks))
    while (head := source.until(END.encode())) is not None:
        lines = head.decode("utf-8").lstrip(CRLF).split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record before byte {source.at}")
        fields: dict[str, list[str]] = {}
        for name, _, value in (x.partition(":") for x in lines[1:]):
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        block = source.take(int(fields["content-length"][0]))
        yield fields, block
        for _ in block:
            pass
        while source.held[:1] in (b"\r", b"\n") or (not source.held and source.more()):
            if source.held[:1] not in (b"\r", b"\n"):
                break
            del source.held[:1]
            source.at += 1


def _measured(block: Iterator[bytes], keep: bool) -> tuple[int, str, bytes | None]:
    """Length and SHA-1 of what follows the HTTP head in a block, and the block itself if it is to be kept."""
    sha, n, kept, head = hashlib.sha1(), 0, [], b""
    within = True
    for piece in block:
        if keep:
            kept.append(piece)
        if within:
            head += piece
            end = head.find(END.encode())
            if end < 0:
                continue
            within, piece = False, head[end + 4 :]
        sha.update(piece)
        n += len(piece)
    return n, sha.hexdigest(), b"".join(kept) if keep else None


def read_records(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """All records under a path. Of payloads the length and SHA-1 are measured; blocks of responses come along
    on request, those of metadata records always. Archives on a mounted file system are streamed, so their size
    does not matter; from other stores a file comes as one value, of 2 GB at most."""
    one = lambda head, name: (head.get(name) or [None])[0]

    def rows(chunks: Iterator[bytes]) -> Iterator[tuple]:
        for head, block in parse(inflated(chunks)):
            kind, n, sha, own = one(head, "warc-type"), None, None, None
            if kind == "response":
                n, sha, own = _measured(block, blocks)
            elif blocks or kind == "metadata":
                own = b"".join(block)
            yield kind, one(head, "warc-record-id"), head.get("warc-concurrent-to"), one(head, "warc-refers-to"), one(head, "warc-target-uri"), one(head, "warc-payload-digest"), n, sha, own

    def opened(value: str | bytes) -> Iterator[bytes]:
        if isinstance(value, bytes):
            yield from (value[i : i + CHUNK] for i in range(0, len(value), CHUNK))
            return
        with open(url2pathname(urlsplit(value).path), "rb") as fh:
            while data := fh.read(CHUNK):
                yield data

    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for row in rows(opened(content.as_py())):
                    out.append(row)
                    size += len(row[-1] or b"") + 300
                    if size > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,gz,warc}").load(path)
    first = files.select("path").first()
    mounted = first is None or urlsplit(first.path).scheme in ("", "file")
    return files.select("path" if mounted else "content").mapInArrow(records, _SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One row for each response or revisit record: record, kind, uri, response, request, metadata (structs)."""
    main = records.where("kind IN ('response', 'revisit')").select("record", "kind", "uri", F.struct("declared", "payload_bytes", "payload_sha1", "refers_to", "block").alias("response"))
    side = lambda kind: records.where(F.col("kind") == kind).withColumn("of", F.explode("concurrent_to")).groupBy(F.col("of").alias("record")).agg(F.min_by(F.struct(F.col("record").alias("id"), "uri", "block"), "record").alias(kind))
    return main.join(side("request"), "record", "left").join(side("metadata"), "record", "left")


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each capture; a revisit takes length
    and page of the response it refers to."""
    page = F.regexp_extract(F.col("metadata.block").cast("string"), r"(?m)^page-id: (-?\d+)", 1)
    rows = found.select("record", "kind", F.when(page != "", page).cast("long").alias("page_id"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_sha1").alias("sha"), F.col("response.declared").alias("declared"), F.col("response.refers_to").alias("refers_to"))
    rows = save(rows, "warc-captures")
    # a response may be what a third of all records revisit; responses themselves refer to nothing
    refers = F.col("refers_to").isNotNull()
    named = rows.where("kind = 'revisit'").where(refers).groupBy(F.col("refers_to").alias("record")).agg(F.count("*").alias("revisits"))
    origin = rows.where("kind = 'response'").dropDuplicates(["record"]).join(named, "record")
    origin = origin.select(F.col("record").alias("refers_to"), F.col("page_id").alias("of"), F.col("n").alias("full"), "revisits")
    both = joined_hot(rows.where(refers), save(origin, "warc-origins"), ["refers_to"], "revisits", "left").drop("revisits")
    both = both.unionByName(rows.where(~refers), allowMissingColumns=True)
    return both.select("page_id", F.coalesce("n", "full").alias("payload_bytes"), F.coalesce("sha", F.substring_index("declared", ":", -1)).alias("payload_digest"), F.col("kind").alias("record_type"), F.col("of").alias("refers_to"))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Write pages, read the archives back and assemble the captures."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archive(pages, path, id_col, url_col, payload_col)
    return resolved(captures(save(read_records(pages.sparkSession, path), "warc-records")))
