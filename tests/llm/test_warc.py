import struct
from collections import Counter

import pytest
import zstandard

from clipledger.llm import warc
from clipledger.llm.common import written

from . import odd


def brute(rows, at_least):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        first[data] = min(page_id, first.get(data, page_id))
    out = Counter()
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= at_least and first[data] != page_id
        out[page_id, len(data), warc.digest(data), "revisit" if again else "response", first[data] if again else None] += 1
    return out


def got(pages, at_least):
    archives = written(warc.write_archives(pages, at_least), "t")
    return Counter(tuple(r) for r in warc.read_archives(archives).collect()), archives


@pytest.mark.parametrize("at_least", [0, 600])
def test_tables(spark, small, at_least):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows, archives = got(pages, at_least)
    assert rows == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()], at_least)
    data = open(archives.first().path.removeprefix("file:"), "rb").read()
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE
    # a reader that knows only zstd, its skippable frames and the dictionary reads the records one after another
    size = struct.unpack_from("<I", data, 4)[0]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True)
    assert reader.read() == b"".join(warc.records_of(data))


def test_odd_rows(spark):
    df = odd.frame(spark).selectExpr("*", "doc_id AS page_id", "lang AS url", "text AS html")
    rows, _ = got(df, 0)
    assert rows == brute([(r[0], r[2], r[1]) for r in odd.rows() if r[0] is not None], 0)
    assert not got(odd.empty(spark).selectExpr("doc_id AS page_id", "lang AS url", "text AS html"), 0)[0]


def test_record_and_tiny_archive():
    raw = warc.record(5, "http://x/a b\r\nq", b"<p>\r\n\r\nx</p>", 12, warc.digest(b"<p>\r\n\r\nx</p>"), None, "2020-01-01T00:00:00Z")
    fields, _, payload = warc.parsed(raw)
    assert payload == b"<p>\r\n\r\nx</p>" and fields["WARC-Target-URI"] == "http://x/a%20b%0D%0Aq"
    assert list(warc.records_of(warc.archive([raw]))) == [raw]
    many = [warc.record(i, None, bytes([i]) * 300_000, 300_000, "X", None, "2020-01-01T00:00:00Z") for i in range(9)]
    assert list(warc.records_of(warc.archive(many))) == many
