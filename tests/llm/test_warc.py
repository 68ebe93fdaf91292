import hashlib

import zstandard

from graphloom.llm import warc


def want(rows):
    last = {}
    for i, _, h in rows:
        if len(b := (h or "").encode()) >= 1000:
            last[b] = max(last.get(b, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and last[b] not in (-1, i)
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[b] if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/ x", "<p>é" * 400),
    (2, None, "<p>é" * 400),
    (9, "u", "<p>é" * 400),
    (9, "u", "<p>é" * 400),
    (None, "u", "<p>é" * 400),
    (3, "u", None),
    (4, "u", ""),
    (5, "u", "small"),
    (6, "u", "small"),
    (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 200),
    (None, "v", "n" * 1000),
    (8, "u", "y" * 999),
    (10, "u", "y" * 999),
    (11, "u", "long" * 900000),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, payload int").repartition(3)
    got = warc.archive_round_trip(df).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df).count() == 0


def test_single_record_by_manifest(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    m = warc.write(pages).collect()
    assert len(m) == len(html)
    for r in m[::7]:
        head, block = warc.read_record(r.bundle, r.frame, r.offset)
        assert block.decode() == html[r.page_id] and head["warc-record-id"] == f"<{r.record_id}>"
    # the bundle is a plain Zstandard stream as well
    source, path = warc._open(m[0].bundle)
    with source.open_input_file(path) as f:
        raw = f.read()
    text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert text.startswith(b"WARC/1.1")
