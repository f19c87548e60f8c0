import gzip
import hashlib
import io
import json
from collections import Counter

import pytest

from tessera.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>é" + "x" * 1200, "<p>" + "y" * 1200
    rows = [(1, "http://a/1", big), (2, None, big), (9, "http://a/9", big), (3, "", other), (4, "u r\nl", "short"), (5, "http://a/5", "short"),
            (6, "http://a/6", None), (7, "http://a/7", ""), (None, "http://n", big), (8, "http://a/8", other), (8, "http://a/8", other),
            (20, "http://z", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (21, "http://z", "z" * 3_000_000)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, salt int")


def test_every_page_comes_back(pages):
    rows, df = pages
    got = Counter(tuple(r)[:5] for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        to = max(same) if len(data) >= 1000 and same and sum((g or "") == (h or "") for _, _, g in rows) > 1 and max(same) != i else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to] += 1
    assert got == want
    assert warc.round_trip(df.where("1 = 0")).count() == 0


def test_archives_have_a_member_per_record_and_an_index(pages, monkeypatch):
    rows, df = pages
    manifest, base = warc.archive(df.coalesce(1))
    fs, folder = warc.file_system(base)
    names = [r["path"] for r in manifest.collect()]
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    for name in names:
        data = fs.open_input_stream(f"{folder}/{name}", compression=None).read()
        index = [json.loads(x) for x in fs.open_input_stream(f"{folder}/{name}.idx", compression=None).read().splitlines()]
        for at in index:
            record = gzip.decompress(data[at["offset"]:at["offset"] + at["length"]])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + at["type"].encode())
        assert gzip.decompress(data).count(b"WARC-Record-ID") == len(index)
        assert index[-1]["offset"] + index[-1]["length"] == len(data)


def test_streams_of_one_or_many_members(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    recs = [warc.record_bytes(i, f"http://{i}", b"data" * i, "d", 4 * i, None) for i in range(1, 30)]
    for data in (gzip.compress(b"".join(recs)), b"".join(map(gzip.compress, recs))):
        assert [r for _, r in warc.records(warc.inflated(io.BytesIO(data)))] == recs
        with pytest.raises((EOFError, ValueError)):
            list(warc.records(warc.inflated(io.BytesIO(data[:-20]))))
    assert list(warc.inflated(io.BytesIO(b""))) == []
