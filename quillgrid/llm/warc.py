"""Operator 3: WARC archives, with a salvage reader.

Archives are written record by record, each a gzip member of its own, so damage
to one record leaves the rest readable. The reader takes members of one or of
many records, and plain records. Where a check fails - the member, the version
line, the headers, the length or a digest - it notes where the bad bytes begin
and searches on for the next version line, within a member's decompressed bytes
too, or the next member, that holds a valid record, and logs the gap between as
quarantined. Blocks are read in pieces; no record is held whole unless its
payload is asked for, and none is too long.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import files, storage

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/(1\.0|1\.1)\r?\n")
#: Headers that a record has once; a second one is another record's, run into this one.
ONCE = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Bytes of an archive after which the next record begins a new one.
ROLL = 64 << 20
#: Bytes that the reader takes from the archive, or out of a member, at a time.
STEP = 1 << 18
#: Bytes that a decompressor is fed at a time.
FEED = 1 << 14
#: A payload is hot if more than one page in so many has it.
HOT = 10_000
#: A header's name ends within so many bytes.
LINE = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """A valid record. ``offset`` and ``length`` count stored bytes of the archive, or of the member at ``member`` once decompressed."""

    offset: int
    length: int
    headers: dict[str, str]
    size: int  # bytes of the block's payload: all after the first blank line
    sha1: str  # of the payload, in hexadecimal digits
    payload: bytes | None = None
    member: int | None = None

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


@dataclass
class Gap:
    """Quarantined bytes of an archive, and the check that failed.

    Stored bytes; but if ``member`` is set, decompressed bytes of the member that begins there.
    """

    offset: int
    length: int
    reason: str
    member: int | None = None


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive_key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive_key)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damage(Exception):
    pass


class Stored:
    """The archive's own bytes, from any place on, through a window of STEP bytes."""

    failure = None

    def __init__(self, source):
        self.source, self.base, self.window = source, 0, b""

    def pull(self, at: int, most: int = STEP) -> bytes:
        """Some bytes from ``at`` on, at most ``most``; none at the end."""
        if not self.base <= at < self.base + len(self.window):
            self.source.seek(at)
            self.base, self.window = at, self.source.read(STEP)
        return self.window[at - self.base : at - self.base + most]


class Member:
    """The decompressed bytes of the gzip member at ``start``, from any place on.

    Going back costs a fresh start from the last ``mark`` before that place.
    """

    def __init__(self, stored: Stored, start: int):
        self.stored, self.start, self.failure, self.end = stored, start, None, None
        self.z, self.at, self.out = zlib.decompressobj(31), start, 0  # the next stored byte to feed, bytes that came out
        self.base, self.window = 0, b""
        self.marks: list[tuple] = []

    def mark(self, place: int) -> None:
        """Promise not to go back before ``place``, which lies in the window."""
        if self.z is not None and not self.z.eof and (not self.marks or self.out - self.marks[-1][0] >= STEP):
            self.marks.append((self.out, self.z.copy(), self.at))
        while len(self.marks) > 1 and self.marks[1][0] <= place:
            self.marks.pop(0)

    def _back(self, place: int) -> None:
        while self.marks and self.marks[-1][0] > place:
            self.marks.pop()
        if self.marks:
            self.out, z, self.at = self.marks[-1]
            self.z = z.copy()
        else:
            self.z, self.at, self.out = zlib.decompressobj(31), self.start, 0
        self.base, self.window, self.failure = self.out, b"", None

    def _feed(self, most: int, piece: bytes) -> bytes:
        before = self.z.copy()
        try:
            out = self.z.decompress(piece, most)
        except zlib.error as e:
            if len(piece) > 1:  # find the last byte that can be read
                self.z = before
                return self._feed(most, piece[: max(1, len(piece) // 16)])
            self.failure, self.z = f"gzip: {str(e).split(':')[0]}", None
            return b""
        self.at += len(piece) - len(self.z.unconsumed_tail) - len(self.z.unused_data)
        if self.z.eof:
            self.end = self.at
        return out

    def _more(self, most: int) -> bool:
        while self.z is not None and not self.z.eof:
            piece = self.stored.pull(self.at, FEED)
            out = self._feed(most, piece)
            if out:
                self.base, self.window = self.out, out
                self.out += len(out)
                return True
            if not piece and self.z is not None and not self.z.eof:
                self.failure, self.z = "gzip member cut short", None
        return False

    def pull(self, at: int, most: int = STEP) -> bytes:
        if at < self.base:
            self._back(at)
        while at >= self.base + len(self.window):
            if not self._more(STEP):
                return b""
        return self.window[at - self.base : at - self.base + most]

    def fed_for(self, place: int) -> int:
        """The stored bytes, from the archive's begin, that had to be read for the first ``place`` decompressed ones."""
        self._back(place)
        while self.out < place and self._more(place - self.out):
            pass
        return self.at

    def sound(self) -> bool:
        """Whether the member can be read to its end and meets its own check; the place of reading is kept."""
        probe = Member(self.stored, self.start)
        while probe._more(STEP):
            pass
        return probe.failure is None


class Damage(Exception):
    """A check that failed. ``skip``: bytes that are framed as one record, though its content is bad; 0 if the frame itself is."""

    def __init__(self, reason: str, skip: int = 0):
        super().__init__(reason)
        self.skip = skip


class Cursor:
    """Reads forward from a place of a stream."""

    def __init__(self, stream, at: int):
        self.stream, self.at = stream, at

    def some(self, most: int) -> bytes:
        got = self.stream.pull(self.at, most)
        self.at += len(got)
        return got

    def exactly(self, n: int) -> bytes:
        parts = []
        while n and (got := self.some(n)):
            parts.append(got)
            n -= len(got)
        return b"".join(parts)

    def line(self) -> bytes:
        """The next line with its end; a line whose first LINE bytes have no colon and no end is damage."""
        parts, colon = [], False
        while True:
            got = self.stream.pull(self.at, 1 << 12)
            if not got:
                return b"".join(parts)
            k = got.find(b"\n")
            part = got[: k + 1] if k >= 0 else got
            parts.append(part)
            self.at += len(part)
            if k >= 0:
                return b"".join(parts)
            colon = colon or b":" in part
            if not colon and sum(map(len, parts)) > LINE:
                raise Damage("malformed header")


def _headers(c: Cursor) -> dict[str, str]:
    m = _VERSION_LINE.fullmatch(c.line())
    if not m:
        raise Damage("no version line")
    headers: dict[str, str] = {}
    while True:
        line = c.line()
        if line == b"\r\n":
            return headers
        if not line.endswith(b"\r\n"):
            raise Damage("headers have no end" if not line.endswith(b"\n") else "malformed header")
        name, colon, value = line[:-2].partition(b":")
        if line[:1] in (b" ", b"\t") and headers:
            last = next(reversed(headers))
            headers[last] += " " + line.strip().decode("utf-8", "replace")
        elif not colon or not name.strip() or b"\r" in line[:-2]:
            raise Damage("malformed header")
        elif (key := name.strip().lower().decode("utf-8", "replace")) in headers and key in ONCE:
            raise Damage("a header is there twice")
        else:
            headers[key] = value.strip().decode("utf-8", "replace")


def parse(stream, at: int, with_payload: bool = False) -> Record:
    """The record at a place of a stream, read in pieces; raises Damage if a check fails."""
    c = Cursor(stream, at)
    headers = _headers(c)
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 18:
        raise Damage("no content length")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damage("a mandatory header is missing")
    left, block, payload, size, held, edge, inside = int(length), hashlib.sha1(), hashlib.sha1(), 0, [], b"", False
    while left and (got := c.some(min(left, STEP))):
        left -= len(got)
        block.update(got)
        if not inside:
            edge += got
            k = edge.find(b"\r\n\r\n")
            if k < 0:
                edge = edge[-3:]
                continue
            inside, got = True, edge[k + 4 :]
        payload.update(got)
        size += len(got)
        if with_payload:
            held.append(got)
    if left:
        raise Damage("block cut short")
    if c.exactly(4) != b"\r\n\r\n":
        raise Damage("no record end")
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and want.removeprefix("sha1:") != base64.b32encode(block.digest()).decode():
        after = Cursor(stream, c.at).exactly(10)
        framed = not after or after.startswith(MAGIC) or after.startswith(b"WARC/1.")
        raise Damage("block digest", c.at - at if framed else 0)
    return Record(at, c.at - at, headers, size, payload.hexdigest(), b"".join(held) if with_payload else None)


def _find(stream, at: int, marks: tuple[bytes, ...]) -> int | None:
    """Where one of ``marks`` is next, at or after a place; None if nowhere."""
    carried, width = b"", max(map(len, marks)) - 1
    while got := stream.pull(at):
        data = carried + got
        found = [k for m in marks if (k := data.find(m)) >= 0]
        if found:
            return at - len(carried) + min(found)
        at, carried = at + len(got), data[-width:]
    return None


@dataclass
class Salvage:
    """Reads one archive from a binary stream that can seek; iterate for its valid records, then see ``gaps``.

    Bytes that are given up are searched again from the next candidate on,
    except for what a sound member or a whole frame held. Memory: a few windows
    of STEP bytes, and the payload of one record if ``with_payload``.
    A record without a digest of its own counts only if its member is sound.
    """

    source: object
    with_payload: bool = False
    gaps: list[Gap] = field(default_factory=list)

    def _member(self, stored: Stored, start: int) -> Iterator[Record]:
        """The records of one member; sets ``after`` (where to go on, None if the member gave nothing) and ``reason``."""
        stream, at, good, bad = Member(stored, start), 0, 0, None
        self.after, self.reason, sound, some, inner = None, "", None, False, []
        while stream.pull(at, 1):
            stream.mark(at)
            try:
                r = parse(stream, at, self.with_payload)
                if not r.headers.get("warc-block-digest", "").startswith("sha1:"):
                    sound = stream.sound() if sound is None else sound
                    if not sound:
                        raise Damage("no digest in a damaged member", r.length)
            except Damage as e:
                bad = bad or (at, stream.failure or str(e))
                at = at + e.skip if e.skip else _find(stream, at + 1, (b"WARC/1.",))
                if at is None:
                    break
                continue
            if bad:
                inner.append(Gap(bad[0], at - bad[0], bad[1], start))
                bad = None
            some, at = True, at + r.length
            good = at
            yield Record(r.offset, r.length, r.headers, r.size, r.sha1, r.payload, start)
        while stream._more(STEP):
            pass
        self.reason = stream.failure or (bad[1] if bad else "nothing in the member")
        if stream.failure is None:
            self.after = stream.end
            if bad and some:
                inner.append(Gap(bad[0], stream.out - bad[0], bad[1], start))
            if not some:
                self.gaps.append(Gap(start, stream.end - start, self.reason))
        elif some:
            self.after = max(start + 1, stream.fed_for(good) - 4)  # a decompressor may look a few bytes ahead
        self.gaps += inner

    def __iter__(self) -> Iterator[Record]:
        stored, at, bad = Stored(self.source), 0, None

        def close(end: int) -> None:
            nonlocal bad
            if bad and end > bad[0]:
                self.gaps.append(Gap(bad[0], end - bad[0], bad[1]))
            bad = None

        while head := Cursor(stored, at).exactly(10):
            if head.startswith(MAGIC):
                before = len(self.gaps)
                records = self._member(stored, at)
                first = next(records, None)
                if first is not None:
                    close(at)
                    yield first
                    yield from records
                if self.after is not None:
                    if first is None:  # sound, but without a valid record: its gap is there already
                        own = self.gaps.pop(before)
                        bad = bad or (own.offset, own.reason)
                    elif self.reason.startswith("gzip"):
                        bad = (self.after, self.reason)
                        self.after = _find(stored, self.after, (MAGIC, b"WARC/1."))
                    at = self.after
                    if at is None:
                        break
                    continue
                reason, skip = self.reason, 0
            else:
                try:
                    r = parse(stored, at, self.with_payload)
                    close(at)
                    yield r
                    at += r.length
                    continue
                except Damage as e:
                    reason, skip = str(e) if head.startswith(b"WARC/1.") else "neither a member nor a version line", e.skip
            bad = bad or (at, reason)
            at = at + skip if skip else _find(stored, at + 1, (MAGIC, b"WARC/1."))
            if at is None:
                break
        stored.source.seek(0, 2)
        close(stored.source.tell())


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000) -> DataFrame:
    """Write a record for each row to archives in ``folder``; returns the archives' names and record counts.

    The payload is the body in UTF-8 (null: empty). Of rows with equal payloads
    of at least ``least`` bytes, the one with the largest id is a response and
    the others are revisits of it; shorter ones are all responses. Rows aren't
    gathered by payload: only the digests of repeated payloads are, and joined
    back. Payloads that more than one row in ``HOT`` has are fewer than ``HOT``
    and are broadcast; short pages, null and empty ones too, have a key of their
    own each, so no key of the join has more than one row in ``HOT``. The list of archives is written with them;
    a file that isn't on the list is a dead task's and isn't read. Ids of any
    type that casts to a whole number; one that doesn't counts as null. An
    empty table gives no archives.
    """
    spark = pages.sparkSession
    src = pages.select(pages[id_col].try_cast("long").alias("id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(pages[body_col], F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumns({"size": F.octet_length("payload"), "sha": F.sha1("payload")})
    twice = src.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1")
    twice = storage.materialise(twice, "repeated")
    often = F.col("n") * HOT > F.lit(pages.count())
    hot = twice.where(often).select("sha", "size", F.col("refers").alias("hot"))
    rest = twice.where(~often).select(F.col("sha").alias("key"), F.col("size").alias("other"), F.col("refers").alias("cold"))
    known = src.join(F.broadcast(hot), ["sha", "size"], "left")  # fewer than HOT rows
    plain = (F.col("size") < least) | F.col("hot").isNotNull()  # these have no partner below, and a key of their own each
    both = known.withColumn("key", F.when(plain, F.xxhash64("id", "url").cast("string")).otherwise(F.col("sha"))).join(rest, "key", "left")
    refers = F.coalesce("hot", F.when(F.col("other") == F.col("size"), F.col("cold")))
    is_revisit = refers.isNotNull() & (F.col("id").isNull() | (refers != F.col("id")))
    rows = both.select("id", "url", "payload", "sha", F.when(is_revisit, refers).alias("refers"))

    def put(batches):
        own, k, out, n, size = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", 0, None, 0, 0  # every attempt has files of its own
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                if out is None:
                    name, n, size = f"pages-{own}-{k:05d}.warc.gz", 0, 0
                    out, k = files.Atomic(folder, name), k + 1
                raw = record_bytes(row["id"], row["url"], row["payload"], row["sha"], row["refers"])
                out.out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ROLL:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])

    rows.mapInArrow(put, "archive string, records long").write.parquet(f"{folder}/_archives")
    return spark.read.schema("archive string, records long").parquet(f"{folder}/_archives")


def record_bytes(page_id: int | None, url: str, payload: bytes, sha: str, refers: int | None) -> bytes:
    """One record as a gzip member. A revisit has no payload; it names the response, the digest and the length."""
    url = re.sub(r"[\r\n]", " ", url)
    headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(f"page:{page_id}:{url}")), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode())]
    headers.append(("X-Page-ID", "" if page_id is None else str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is None:
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page", str(refers)), ("X-Payload-Bytes", str(len(payload)))]
        block = http + b"\r\n"
    headers += [("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return member(record(headers, block))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
GAPS = "archive string, offset long, length long, reason string, member long"


def _page(r: Record) -> dict | None:
    """The row of a response or revisit; None if its payload fails its own digest."""
    h = r.headers
    want = h.get("warc-payload-digest", "").removeprefix("sha1:")
    sha = base64.b32decode(want).hex() if re.fullmatch("[A-Z2-7]{32}", want) else None
    if r.kind == "response":
        if sha is not None and sha != r.sha1:
            return None
        sha, size = r.sha1, r.size
    else:
        size = int(x) if (x := h.get("x-payload-bytes", "0")).isascii() and x.isdigit() else 0
    number = lambda x: int(x) if re.fullmatch(r"-?\d{1,19}", x or "") else None
    return {"page_id": number(h.get("x-page-id")), "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": sha, "record_type": r.kind, "refers_to": number(h.get("warc-refers-to-page")), "payload": (r.payload if r.kind == "response" else b"") if r.payload is not None else None}


def _rows(archives: DataFrame, folder: str, handle, schema: str, with_payload: bool = False) -> DataFrame:
    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, root = files.system(folder)
                with fs.open_input_file(f"{root}/{name}") as stream:
                    yield from handle(name, Salvage(stream, with_payload))

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(parts, "archive").mapInArrow(read, schema)


def read(archives: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """A row for each response and revisit that can be recovered from the archives (column archive).

    Damaged records are left out (see ``quarantine``); a record whose payload
    fails its digest counts as damaged. Other record types are passed over.
    """

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def handle(name, salvage):
        rows, size = [], 0
        for r in salvage:
            row = _page(r) if r.kind in ("response", "revisit") else None
            if row:
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return _rows(archives, folder, handle, READ, with_payload)


def quarantine(archives: DataFrame, folder: str) -> DataFrame:
    """The byte gaps of the archives: where they begin, how long they are, and the first check that failed.

    Offsets count stored bytes; where member is set, decompressed bytes of the
    gzip member that begins there.
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("member", pa.int64())])

    def handle(name, salvage):
        bad = []
        for r in salvage:
            if r.kind in ("response", "revisit") and _page(r) is None:
                bad.append(Gap(r.offset, r.length, "payload digest", r.member))
        rows = [{"archive": name, "offset": g.offset, "length": g.length, "reason": g.reason, "member": g.member} for g in sorted(salvage.gaps + bad, key=lambda g: (g.offset if g.member is None else g.member, g.offset))]
        yield pa.RecordBatch.from_pylist(rows, schema)

    return _rows(archives, folder, handle, GAPS)


def round_trip(pages: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Write all pages to archives and read them back, without payloads.

    Returns a row for each input row: page_id, payload_bytes and payload_digest
    (of the full payload, for revisits too), record_type and refers_to. A page
    without an id or url keeps a null id and an empty url; repeated ids with one
    payload: every row but those of the largest id is a revisit.
    """
    folder = folder or storage.new_dir(pages.sparkSession, "warc")
    archives = write(pages, folder)
    return read(archives, folder).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, CAST(coalesce(html, '') AS VARCHAR) AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM r"""
