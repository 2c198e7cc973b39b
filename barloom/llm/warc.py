"""Pages as WARC files and a capture index over them in global order.

Every page is a record. Of pages with equal payloads one is a response, the others are revisits of it and hold no payload. Files are
written by Spark's text writer, a record a row, with the blank lines that end a record as its line separator, so a task that is lost
writes its files anew and nothing half-written is left. The index is made by an external merge: each reading task sorts the captures
of its files, which is a run; runs are cut into blocks and dealt by key ranges, and every range is merged by a loser tree that holds one block a
run. Which block is needed next is known beforehand: the one whose predecessor in its run ends first. Over ``FAN_IN`` runs are merged in passes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, uniform

#: Bytes of payload that a file holds on average.
ARCHIVE_BYTES = 32 << 20
#: Payloads of at least so many bytes are looked for among earlier ones.
LEAST_BYTES = 0
#: Runs that are merged at once, and captures of a block.
FAN_IN, BLOCK = 256, 128
#: Ranges of the index are cut so that each holds about so many captures, from so many sampled keys a range.
RANGE_ROWS, SAMPLED = 1 << 18, 64
#: Keys that are sampled at most to cut ranges.
MOST_SAMPLED = 1_000_000
#: Rows with one payload are dealt over so many tasks.
SALTS = 4096
#: Pages without a time of their own are a second apart from here on, by their key.
EPOCH = "2020-01-01 00:00:00"
#: Fixed values of the formats.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CAPTURE = ("run int, key binary, urlkey string, timestamp string, url string, page_id {}, payload_bytes long, payload_digest string, record_type string, "
            "refers_to {}, file string, offset long, length long")  # fmt: skip


def sha1_base32(text: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a text's UTF-8 bytes."""

    def letters(h: Column) -> Column:
        def letter(i: Column) -> Column:
            part = F.conv(F.substring(h, F.call_function("div", i, F.lit(4)).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
            place = F.call_function("div", part, F.element_at(F.array(*(F.lit(1 << n) for n in (15, 10, 5, 0))), i % 4 + 1)).cast("int") % 32
            return F.substring(F.lit(BASE32), place + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")

    # bound to a variable, or else it would be taken anew for every letter
    return F.transform(F.array(F.sha1(text.cast("binary"))), letters)[0]


def _record_id(page: Column, url: Column, digest: Column) -> Column:
    """A URI that names a page's record; rows equal in key, URL and payload share it."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.md5(F.concat_ws("\n", url, digest)), F.lit(">"))


def _earlier(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(_page, _digest, _first, _first_id, _first_url, _first_date): the revisits, and what they revisit.

    A payload's first page is found from one value a task and salt, and handed back to the salts: a payload that a third of all pages
    share is never in one task whole.
    """
    known = pages.filter((F.col("_bytes") >= least_bytes) & F.col("_page").isNotNull())
    about = F.min(F.struct("_page", "_url", "_date"))
    salt = F.pmod(F.xxhash64("_page"), F.lit(SALTS))
    by_salt = known.groupBy("_digest", salt.alias("_salt")).agg(about.alias("_f"), F.count("*").alias("_n"))
    firsts = by_salt.groupBy("_digest").agg(F.min("_f").alias("_first_of"), F.sum("_n").alias("_all"))
    of_salt = by_salt.select("_digest", "_salt").join(firsts.filter("_all > 1"), "_digest").select("_digest", "_salt", "_first_of")
    keyed = pages.filter(F.col("_bytes") >= least_bytes).select("_page", "_digest", F.pmod(F.xxhash64("_page"), F.lit(SALTS)).alias("_salt")).distinct()
    # rows without a key revisit too; their salt is that of null, which the table of salts lacks
    lone = keyed.filter("_page is null").join(firsts, "_digest").select("_page", "_digest", "_first_of")
    met = keyed.join(of_salt, ["_digest", "_salt"]).select("_page", "_digest", "_first_of").filter(F.col("_page") > F.col("_first_of._page")).unionByName(lone)
    first_id = _record_id(F.col("_first_of._page"), F.col("_first_of._url"), F.col("_digest"))
    return met.select(
        "_page", "_digest", F.lit(True).alias("_first"), first_id.alias("_first_id"), F.col("_first_of._url").alias("_first_url"), F.col("_first_of._date").alias("_first_date")
    )


def write_archives(pages: DataFrame, payload: str = "html", url: str = "url", key: str = "page_id", date: Column | None = None,
                   least_bytes: int = LEAST_BYTES, target: str | None = None) -> str:
    """Write a record for every page; the folder with the WARC files, ``target`` or one in the shared folder.

    Of pages with equal payloads of at least ``least_bytes`` the one with the smallest key is a response, the others, those without a key too, are
    revisits. Rows that repeat the smallest key are responses each, and where no page has a key all are. A null payload is an
    empty one. A null URL leaves out its header line; control characters and spaces of a URL are percent-encoded in headers. ``date`` is a timestamp without
    time zone. Other columns are not kept. An empty table gives files without records.
    """
    spark = pages.sparkSession
    number = F.col(f"`{key}`") if pages.schema[key].dataType.typeName() in ("integer", "long") else F.xxhash64(f"`{key}`")
    at = F.expr(f"timestamp_ntz'{EPOCH}'") + F.make_dt_interval(secs=F.pmod(F.coalesce(number, F.lit(0)), F.lit(1_000_000_000)))
    clean = F.regexp_replace(F.col(f"`{url}`"), "[\\x00-\\x20\\x7F]", "%20")
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").alias("_page"), clean.alias("_url"), F.date_format(at if date is None else date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_date"), body.alias("_body")
    ).withColumns({"_digest": sha1_base32(F.col("_body")), "_bytes": F.octet_length("_body").cast("long")})
    light = materialize(rows.drop("_body"), "pages")
    mean = light.agg(F.avg("_bytes")).first()[0] or 0
    found = materialize(_earlier(light, least_bytes).withColumnsRenamed({"_page": "_of_page", "_digest": "_of_digest"}), "revisits")
    joined = rows.join(found, F.col("_page").eqNullSafe(F.col("_of_page")) & (F.col("_digest") == F.col("_of_digest")), "left")
    again = F.col("_first").isNotNull()

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("_body")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(F.col("_page"), F.col("_url"), F.col("_digest"))),
        line("WARC-Date", F.col("_date")), line("WARC-Target-URI", F.col("_url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Profile", F.when(again, PROFILE)), line("WARC-Refers-To", F.col("_first_id")), line("WARC-Refers-To-Target-URI", F.col("_first_url")),
        line("WARC-Refers-To-Date", F.col("_first_date")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    path = target or f"{shared_dir(spark).rstrip('/')}/barloom/warc-{uuid.uuid4().hex}"
    records = joined.select(F.concat(head, F.lit("\r\n"), block).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", int(max(1, ARCHIVE_BYTES // max(1, mean)))).text(path)
    return path


def surt(url: str | None) -> str:
    """The key that sorts a URL by its host's parts from the last on; no scheme, user, ``www``, default port or fragment. Null: ``-``."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:  # not a URL
        return url
    if not host:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    default = {"http": 80, "https": 443}.get(parts.scheme)
    end = "" if port in (None, default) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + f"{end}){parts.path or '/'}{query}".lower()


def sort_key(urlkey: str, timestamp: str, page) -> bytes:
    """Bytes that order captures by URL key, time and page; a page without a key comes first."""
    last = b"" if page is None else (page + (1 << 63)).to_bytes(9, "big") if isinstance(page, int) else str(page).encode()
    return b"\0".join((urlkey.encode(), timestamp.encode(), last))


def walk(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a file; a ValueError where it is damaged."""
    at, mark = 0, END.encode()
    while at < len(content):
        head = content.find(mark, at)
        if head < 0 or not content.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in content[at:head].decode().split("\r\n")[1:])
        start = head + len(mark)
        end = start + int(headers["Content-Length"])
        if content[end : end + len(mark)] != mark:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, end + len(mark) - at, headers, content[start:end]
        at = end + len(mark)


def _page_of(record_id: str, number: bool):
    page = record_id.removeprefix("<urn:page:").rsplit(":", 1)[0]
    return None if not page else int(page) if number else page


def capture(headers: dict[str, str], block: bytes, number: bool) -> dict:
    """What the index holds of a record; a response's payload is measured, and must be what the headers say."""
    http, _, payload = block.partition(END.encode())
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not the one written")
    url, page = headers.get("WARC-Target-URI"), _page_of(headers["WARC-Record-ID"], number)
    stamp, urlkey = re.sub(r"\D", "", headers["WARC-Date"]), surt(url)
    first = headers.get("WARC-Refers-To")
    return {
        "key": sort_key(urlkey, stamp, page), "urlkey": urlkey, "timestamp": stamp, "url": url, "page_id": page, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": first and _page_of(first, number),
    }


def read_archives(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The captures of all records, stored: each reading task's are one sorted run. ``kind`` is the type of the pages' keys."""
    number = kind in ("int", "long", "bigint")

    def run(batches):
        part, out = TaskContext.get().partitionId(), []
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for offset, length, headers, block in walk(content.as_py()):
                    out.append(capture(headers, block, number) | {"run": part, "file": file, "offset": offset, "length": length})
        out.sort(key=lambda c: c["key"])
        yield from _batches(out, batch_schema)

    schema = _CAPTURE.format(kind, kind)
    batch_schema = _arrow(schema)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return materialize(files.mapInArrow(run, schema), "runs")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _batches(rows: list[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[a : a + size], schema)


class LoserTree:
    """The least of the heads of several sorted runs: inner nodes keep the losers of their matches, so a new head plays one path."""

    def __init__(self, heads: list):
        self.heads, n = list(heads), max(1, len(heads))
        self.lost = [-1] * n
        for i in range(len(heads)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Runs without a head lose; equal heads go by run."""
        x, y = self.heads[a], self.heads[b]
        return (x is None, x or b"", a) < (y is None, y or b"", b)

    def _play(self, i: int) -> None:
        at = (i + len(self.lost)) // 2
        while at:
            if self.lost[at] < 0:  # the first one here waits for its opponent
                self.lost[at] = i
                return
            if self._less(self.lost[at], i):
                self.lost[at], i = i, self.lost[at]
            at //= 2
        self.lost[0] = i

    def least(self) -> int:
        return self.lost[0]

    def replace(self, head) -> None:
        """The least run goes on with another head, None at its end."""
        i = self.lost[0]
        self.heads[i] = head
        at = (i + len(self.lost)) // 2
        while at:
            if self._less(self.lost[at], i):
                self.lost[at], i = i, self.lost[at]
            at //= 2
        self.lost[0] = i


def merge(blocks: Iterator[tuple[int, list[bytes], list]]) -> Iterator:
    """The rows of all runs in order of their keys. ``blocks``: (run, keys, rows), first the first block of every run, then the others in the
    order in which they are needed; no more than one block a run is held."""
    runs: dict[int, list] = {}
    later = None
    for run, keys, rows in blocks:
        if run in runs:
            later = (run, keys, rows)
            break
        runs[run] = [keys, rows, 0]
    names = list(runs)
    tree = LoserTree([runs[r][0][0] for r in names])
    while names and tree.heads[tree.least()] is not None:
        run = names[tree.least()]
        held = runs[run]
        yield held[1][held[2]]
        held[2] += 1
        if held[2] == len(held[0]):
            if later is not None and later[0] == run:
                held[:] = [later[1], later[2], 0]
                later = next(blocks, None)
            else:
                held[:] = [[None], [], 0]
        tree.replace(held[0][held[2]])
    if later is not None:
        raise ValueError("blocks came out of order")


def _cut(runs: DataFrame, bounds: list[bytes], group: int) -> DataFrame:
    """(range, need, run, keys, rows): blocks of the runs' rows; ``need`` is the key after which a block is due, null for a run's first in a range.

    Rows come from the scan in sorted stretches; each is a run of its own, numbered within the task.
    """
    schema = _arrow_of(runs)

    def run(batches):
        part, stretch, last, of = TaskContext.get().partitionId(), -1, None, None
        held, where, need = [], None, None

        def block():
            return {"group": of // group, "range": where, "need": need, "run": (part << 32) + stretch, "keys": [h["key"] for h in held],
                    "rows": _packed(held, schema)}

        out = []
        for batch in batches:
            for row in batch.to_pylist():
                key = row["key"]
                new = of is None or row["run"] != of or key < last
                at = bisect.bisect_right(bounds, key)
                if held and (new or at != where or len(held) == BLOCK):
                    out.append(block())
                    need = None if new or at != where else last
                    held = []
                    if len(out) == 64:
                        yield pa.RecordBatch.from_pylist(out, block_schema)
                        out = []
                stretch += new
                of, where, last = row["run"], at, key
                held.append(row)
        if held:
            out.append(block())
        if out:
            yield pa.RecordBatch.from_pylist(out, block_schema)

    ddl = "group int, range int, need binary, run long, keys array<binary>, rows binary"
    block_schema = pa.schema([("group", pa.int32()), ("range", pa.int32()), ("need", pa.binary()), ("run", pa.int64()), ("keys", pa.list_(pa.binary())), ("rows", pa.binary())])
    return runs.mapInArrow(run, ddl)


def _arrow_of(df: DataFrame) -> pa.Schema:
    return _arrow(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))


def _packed(rows: list[dict], schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as w:
        w.write_batch(pa.RecordBatch.from_pylist(rows, schema))
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[dict]:
    return pa.ipc.open_stream(data).read_all().to_pylist()


def _pass(runs: DataFrame, bounds: list[bytes], group: int) -> DataFrame:
    """The runs of each group of ``group`` merged to one, range by range; stored."""
    schema, ddl = _arrow_of(runs), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields)
    dealt = _cut(runs, bounds, group).repartitionByRange(len(bounds) + 1, "group", "range")
    # blocks that are due at the same key are needed in the order of their runs, as the tree plays them
    ordered = dealt.sortWithinPartitions("group", "range", F.asc_nulls_first("need"), "run")

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        ahead = next(rows, None)
        while ahead is not None:
            part = (ahead["group"], ahead["range"])

            def here():
                nonlocal ahead
                while ahead is not None and (ahead["group"], ahead["range"]) == part:
                    now, ahead = ahead, next(rows, None)
                    yield now["run"], now["keys"], _unpacked(now["rows"])

            out = []
            for row in merge(here()):
                out.append(row | {"run": part[0]})
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return materialize(ordered.mapInArrow(run, ddl), "merged")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index: every capture, in the order of URL key, time and page over its files, which are numbered in that order.

    Ranges come from a sample of keys, as those of a sort do; one URL with any number of captures is cut by time and page. Captures that
    agree in all of these stand in any order. Over ``FAN_IN`` runs take several passes.
    """
    spark = runs.sparkSession
    total, n = runs.agg(F.count("*"), F.count_distinct("run")).first()
    ranges = max(1, min(total // 1024, max(-(-total // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    share = min(1.0, min(SAMPLED * ranges, MOST_SAMPLED) / max(1, total))
    keys = sorted(r["key"] for r in runs.filter(uniform(17, F.col("key")) < share).select("key").collect()) if ranges > 1 else []
    bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    while n > FAN_IN:
        # runs are numbered by reading task; groups of numbers become runs
        runs, n = _pass(runs, bounds, FAN_IN), -(-(runs.agg(F.max("run")).first()[0] + 1) // FAN_IN)
    return _pass(runs, bounds, 1 << 31)


def index(pages: DataFrame, payload: str = "html", url: str = "url", key: str = "page_id", **options) -> DataFrame:
    """(urlkey, timestamp, url, page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset, length): pages written as
    records, and the index of all records read back from the files, in order."""
    path = write_archives(pages, payload, url, key, **options)
    runs = read_archives(pages.sparkSession, path, pages.schema[key].dataType.simpleString())
    return merge_runs(runs).drop("run", "key")
