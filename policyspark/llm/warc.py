"""WARC archives of pages and the merged index of their captures.

Archives are written by Spark's text writer: a record is a line whose separator is the two line
ends that close a WARC record, so the output committer makes every file whole and any store that
Spark writes will do. Records of equal payload are stored once: the largest page id keeps it,
the others are revisits. Reading parses records by their Content-Length.

Each archive gives a run of captures sorted by URL key, time and page, which is written to the
shared folder. Runs are dealt by ranges of that order, as many as keep a range's captures to a
bound, and each range's slices, in the order of their run, merge through a loser tree: the result
is ordered from one partition to the next.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm.common import checkpoint, hot_keys, lookup, remove, scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH, YEAR = 1_704_067_200, 31_536_000  # captures are dated from 2024, a second a page
END = "\r\n"


def base32(hexed: Column) -> Column:
    """40 hex digits as 32 base32 characters."""
    out = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def captured_at(page_id: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(YEAR))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _uuid(value: Column) -> Column:
    h = F.md5(value)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record per row of pages, as a string without its closing line ends, and the size of its payload.

    Null html is an empty payload, a null url a record without a target. Rows without a page id
    (or with one that is no number), and repeated rows of the largest id, are responses. Payloads
    under min_bytes are never revisited. An empty table gives no records, other columns are not read.
    """
    kept = pages.select(F.col("page_id").try_cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    kept = kept.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # ids and digests alone find the revisits; a payload that very many pages share is looked up where they are
    own = [F.col(c).alias(c) for c in ("page_id", "sha")]  # columns of their own: they meet those they come from again
    keys = checkpoint(kept.where(F.octet_length("html") >= min_bytes).select(own))
    sizes = keys.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = lookup(keys, sizes.drop("n"), ["sha"], hot_keys(sizes.select("sha", "n"), keys.count())).where("page_id <> refers_to").distinct()
    rows = kept.join(revisits.select("page_id", "sha", "refers_to"), ["page_id", "sha"], "left")
    digest = base32(F.col("sha"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("html").cast("string"), F.lit(END + END))
    body = F.when(F.col("refers_to").isNull(), F.concat(http, "html")).otherwise(http)
    key = lambda page: _uuid(F.concat_ws("|", page.cast("string"), F.col("sha")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(END))).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", key(F.col("page_id"))),
        line("WARC-Date", captured_at(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), key(F.col("refers_to")))),
        line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        line("WARC-Profile", F.when(F.col("refers_to").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response" + END),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(END),
    )
    return rows.select(F.concat(head, body).alias("value"), F.octet_length("html").alias("size"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, per_file: int = 4000, file_bytes: int = 1 << 28) -> None:
    """gzip archives under path, of at most per_file records and, unpacked, about file_bytes at most.

    Pages longer than per_file of them allow lie in archives of their own, by powers of four, as many
    in each as fit: one long page changes nothing for the others. Null pages are empty, repeated ones
    repeat, an empty table gives no archive with records.
    """
    limit = max(1, file_bytes // per_file)
    band = F.coalesce(*[F.when(F.col("size") <= limit << 2 * k, k) for k in range(16)], F.lit(16))
    made = records(pages, min_bytes)
    sizes = pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    for k in sorted(r.band for r in sizes.select(band.alias("band")).distinct().collect()) or [0]:  # seventeen at most
        made.where(band == k).select("value").write.mode("append").option("lineSep", END + END).option("maxRecordsPerFile", max(1, per_file >> 2 * k)).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive's unpacked bytes."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8").split(END)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        end = cut + 4 + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it says")
        yield at, end - at, headers, data[cut + 4 : end]
        at = end + 4


def unpack(content: bytes) -> bytes:
    out = []
    while content:
        d = zlib.decompressobj(47)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data
    return b"".join(out)


CAPTURE = ["url_key", "captured_at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "run", "place", "offset"]
RUNS = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, run string, place int, offset long"
KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]


def key_of(url: str | None) -> str:
    """url_key in Python; no url or no host: an empty key."""
    found = re.match(r"[A-Za-z]+://(?:www\.)?([^/:?#]*)", url or "")
    rest = re.match(r"[A-Za-z]+://[^/?#]*([^#]*)", url or "")
    return ",".join(reversed((found[1] if found else "").lower().split("."))) + ")" + (rest[1] if rest else "").lower() if url is not None else ""


def _order(row: tuple) -> tuple:
    """Sorting place of a capture: key, time, page (null first), offset."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[-1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archives under path as sorted runs: a row per record, `run` its archive, `place` its rank there, `offset` its place in the unpacked bytes.

    A response's digest and length are taken from its payload. Archives without records give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, where = [], name.as_py().rpartition("/")[2]
                for at, _, h, block in parse(unpack(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    if h["warc-type"] == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if f"sha1:{digest}" != h["warc-payload-digest"]:
                            raise ValueError(f"{where} at {at}: the payload is not the one its digest was made of")
                    else:
                        size, digest = int(http.rpartition(b"Content-Length: ")[2]), h["warc-payload-digest"].removeprefix("sha1:")
                    url = h.get("warc-target-uri")
                    rows.append((key_of(url), h["warc-date"], number("x-page-id"), size, digest, h["warc-type"], number("x-refers-to-page"), url, where, 0, at))
                rows.sort(key=_order)
                rows = [(*r[:9], i, r[10]) for i, r in enumerate(rows)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], CAPTURE)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RUNS)


class LoserTree:
    """k-way merge: the tree keeps the loser of each match, the winner plays on."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node:
            if self.tree[node] < 0:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.heads[winner := self.tree[0]]) is not None:
            yield row
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def history(runs: DataFrame, per_range: int = 50_000) -> DataFrame:
    """Captures of sorted runs in order of url_key, captured_at, page_id (nulls first), offset, over all partitions.

    A range is about per_range captures, which is what a task holds. Repeated captures stay, an
    empty table gives none.
    """
    order = ["url_key", "captured_at", F.col("page_id").asc_nulls_first(), "offset"]
    n = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // per_range))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[list[tuple]] = []
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[8] != last:
                    slices.append([])
                    last = row[8]
                slices[-1].append((_order(row), row))
        block = []
        for _, row in LoserTree(slices):
            block.append(row)
            if len(block) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), KINDS, strict=True)], CAPTURE)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), KINDS, strict=True)], CAPTURE)

    # a slice comes back in its run's order by the places the run gave, however its rows were shuffled
    return runs.select(CAPTURE).repartitionByRange(n, *order).sortWithinPartitions("run", "place").mapInArrow(merge, RUNS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of pages in the shared folder, read back and merged into capture histories; the archives are removed once read."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, min_bytes)
    runs = checkpoint(read(spark, path))
    remove(spark, path)
    return history(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")
