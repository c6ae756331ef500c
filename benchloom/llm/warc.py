"""WARC archives of pages, and the merge of their capture index.

Each record is written as it stands in a WARC file: Spark's text writer puts the two line
ends that close a record after each row, so a part file is a WARC file, to any store that Spark
writes. Reading takes the files back as bytes and follows the record lengths. Each task sorts the
captures of its files into runs; runs are cut at key ranges, and a range is merged from its runs by a
loser tree, so that ranges in order make the whole index in order.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import pickle
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from benchloom.llm.frames import parts_for
from benchloom.operators import skew
from benchloom.storage import cut, new_path

# Bytes of records in one archive file, which is read as one value, and captures in one range of the index.
FILE_BYTES = 16 << 20
RANGE_CAPTURES = 20_000
SAMPLED_KEYS = 20_000
LEAST_REVISIT = 100

# Fixed values of the WARC 1.0 format.
VERSION = "WARC/1.0"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

CAPTURE = (
    "url_key string, capture_ts timestamp, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, file string, offset long, length long"
)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", at: str | None = None) -> DataFrame:
    """Pages as WARC records: page_id, payload_bytes, payload_digest, record_type, refers_to, url, ts, html.

    Of pages with one payload of at least 100 bytes the smallest page_id (NULL last) is the response,
    the rest revisit it. Payloads that occur twice are looked up by digest: broadcast if they are few, else by a shuffle of the
    pages that cuts frequent digests into slices. Pages that repeat the response's id are responses too.
    NULL html is an empty payload. Without a time column, page n was captured n seconds into 2024.
    """
    time = F.col(at) if at else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col(page_id), F.lit(0)))
    base = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), time.alias("ts"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest"))
    long = F.col("payload_bytes") >= LEAST_REVISIT
    seen = cut(base.where(long).groupBy("payload_digest").agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    if skew.is_small(seen):
        found = base.join(F.broadcast(seen.drop("n")), "payload_digest", "left")
    else:
        hot = skew.hot_keys(seen, "payload_digest")
        # Short payloads have nothing to look up; a frequent one, such as the empty one, is dealt out by page.
        sliced = skew.with_salt(base, "payload_digest", hot, ["page_id"], "slice").withColumn(
            "slice", F.when(long, F.col("slice")).otherwise(-1 - F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)).cast("int")))
        found = sliced.join(skew.per_salt(seen.drop("n"), "payload_digest", hot, "slice"), ["payload_digest", "slice"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return found.select(
        "page_id", "url", "ts", "html", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(END))


def record_text() -> Column:
    """A record without the two line ends that close it. Control characters of a url are percent-encoded."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"),
        _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    address = F.col("url")
    for char in "%\r\n":
        address = F.when(address.rlike("[\r\n]") | (F.lit(char) != "%"), F.replace(address, F.lit(char), F.lit(f"%{ord(char):02X}"))).otherwise(address)
    return F.concat(
        F.lit(VERSION + END), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Target-URI", address),
        _line("WARC-Date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", REVISIT_PROFILE), _line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block,
    )


def write_archives(found: DataFrame, path: str, record_bytes: float) -> str:
    """Write the output of `records` as gzipped WARC files below `path`.

    Pages stay in the tasks they are in; a task starts a new file after as many records as fill FILE_BYTES
    at `record_bytes` each, so that a file can be read as one value.
    """
    records_each = max(1, int(FILE_BYTES / max(record_bytes, 1)))
    text = found.select(record_text().alias("value"))
    text.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_each).text(path)
    return path


def url_key(url: str) -> str:
    """Sort key of a url: host labels in reverse, then path and query, in lower case, without scheme, `www.` and fragment.

    What cannot be parsed is its own key.
    """
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")[::-1]
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(labels)}{f':{port}' if port else ''}){parts.path or '/'}{query}".lower()


_ID = re.compile(r"<urn:page:(.*)>")


def _page(value: str | None) -> int | None:
    match = _ID.fullmatch(value or "")
    return int(match[1]) if match and match[1] != "none" else None


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive: headers in lower case, `offset`, `length` and `block`."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 4
        first, *lines = data[at:head_end - 4].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        end = head_end + int(headers["content-length"])
        yield headers | {"offset": at, "length": end - at, "block": data[head_end:end]}
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives below `path`. A response whose payload is not what its digest says is an error."""
    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for record in parse(gzip.decompress(content)):
                    head, _, payload = record["block"].partition(b"\r\n\r\n")
                    digest = record["warc-payload-digest"].removeprefix("sha256:")
                    size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
                    if record["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{file}: the payload of {record['warc-record-id']} is damaged")
                    url = record["warc-target-uri"]
                    rows.append((
                        url_key(url), pd.Timestamp(record["warc-date"]).tz_localize(None), _page(record["warc-record-id"]), url, record["warc-type"], size,
                        digest, _page(record.get("warc-refers-to")), file.rsplit("/", 1)[-1], record["offset"], record["length"],
                    ))
                columns = [c.split()[0] for c in CAPTURE.split(", ")]
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(captures, CAPTURE)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner goes on up."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = [iter(run) for run in runs]
        self.width = len(runs)
        self.heads = [next(run, None) for run in self.runs]
        self.losers = [-1] * self.width
        for leaf in range(self.width):
            self._play(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, leaf: int, filling: bool = False) -> None:
        winner, node = leaf, (leaf + self.width) // 2
        while node:
            if filling and self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.width and (head := self.heads[self.losers[0]]) is not None:
            yield head
            self.heads[self.losers[0]] = next(self.runs[self.losers[0]], None)
            self._play(self.losers[0])


def merged_index(captures: DataFrame) -> DataFrame:
    """Captures in the order of (url_key, capture_ts, page_id), with `history_seq` over all and `capture_no` per key, from 1.

    Each task sorts its captures into runs and cuts them at range bounds, taken from a sample of
    whole keys, time and id included, so a url with any share of the captures spreads over
    ranges. A run is one row of the shuffle. Bounds only shape the tasks, not the result. NULL ids come last;
    captures that agree in the whole key stand in any order.
    """
    spark = captures.sparkSession
    columns = captures.columns
    total = captures.count()
    ranges = parts_for(total, RANGE_CAPTURES)
    key = F.struct("url_key", "capture_ts", F.coalesce("page_id", F.lit(2**63 - 1)).alias("page_id"))
    share = min(1.0, SAMPLED_KEYS / max(total, 1))
    picked = captures.where(F.rand(7) <= share).select(key.alias("key")).orderBy("key").select("key.*").toPandas() if ranges > 1 else pd.DataFrame()
    keys = list(picked.itertuples(index=False, name=None))
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = sorted(
                ((r.url_key, r.capture_ts, 2**63 - 1 if pd.isna(r.page_id) else int(r.page_id)), tuple(r))
                for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name="R"))
            at = [bisect.bisect_right(bounds, r[0]) for r in rows]
            for which in sorted(set(at)):
                lo, hi = bisect.bisect_left(at, which), bisect.bisect_right(at, which)
                yield pd.DataFrame({"range": [which], "run": [pickle.dumps(rows[lo:hi])], "n": [hi - lo]})

    def merge(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [r[1] for r in LoserTree([pickle.loads(run) for run in frame["run"]])]
        out = pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        out["range"], out["place"] = keys[0], range(len(rows))
        return out

    sorted_runs = cut(captures.mapInPandas(runs, "range int, run binary, n long"), "capture-runs")
    merged = sorted_runs.groupBy("range").applyInPandas(merge, f"{CAPTURE}, range int, place long")
    sizes = sorted_runs.groupBy("range").agg(F.sum("n").alias("n"))
    offsets = sizes.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    placed = merged.join(offsets, F.col("range") == F.col("r")).withColumn("history_seq", F.col("before") + F.col("place") + 1)
    placed = cut(placed.drop("r", "before", "place", "range"), "capture-index")
    starts = cut(placed.groupBy("url_key").agg(F.min("history_seq").alias("start"), F.count(F.lit(1)).alias("n")), "url-starts")
    numbered = skew.lookup_join(placed, starts, "url_key", ["history_seq"])
    return numbered.select(*columns, "history_seq", (F.col("history_seq") - F.col("start") + 1).alias("capture_no"))


def archive_history(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives, read them back, and give their merged capture index."""
    spark = pages.sparkSession
    html = options.get("html", "html")
    sizes = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(html), F.lit(0)).cast("long") + 600).alias("b")).first()
    path = write_archives(records(pages, **options), new_path(spark, "archive"), (sizes["b"] or 0) / max(sizes["n"], 1))
    return merged_index(cut(read_archives(spark, path), "captures"))
