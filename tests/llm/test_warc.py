import hashlib
import io

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesmith.llm import warc
from seriesmith.session import scratch_path

SCHEMA = "page_id long, url string, html string, payload string, digest string"
ROWS = [(i, f"http://h{i % 7}.org/a b\r\nx{i}", f"<p>page {i % 40} é</p>" * (1 + i % 9)) for i in range(300)] + [
    (400, None, None), (401, "u", ""), (402, "u", "x" * 99), (403, "u", "x" * 99), (404, "u", "x" * 100),
    (405, "u", "x" * 100), (3, "again", "x" * 100), (406, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (None, "u", "x" * 100),
    (None, "u", "only null " * 20), (407, "u", "long " * 300_000), (408, "u", "x" * 100), (500, "u", "é" * 50), (501, "u", "é" * 50)]


def brute(rows):
    least = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None:
            least[data] = min(page, least.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = least.get(data)
        revisit = len(data) >= 100 and first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "d") for r in rows], SCHEMA).repartition(3)


def test_round_trip_equals_brute_force(spark):
    out = warc.round_trip(spark, frame(spark, ROWS))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(ROWS)


def test_archives_hold_the_payloads(spark):
    manifest = warc.write_archives(frame(spark, ROWS), scratch_path(spark, "warc"), max_bytes=4000, sample_bytes=4000)
    assert manifest.count() > 3
    records = warc.read_archives(manifest).collect()
    texts = {r.record_id: bytes(r.payload).decode() for r in records if r.record_type == "response"}
    html = {warc.record_id(p): h or "" for p, _, h in ROWS if p not in (None, 3)}
    assert all(texts[i] == html[i] for i in texts if i in html)
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS) == len(records)


def test_empty_table(spark):
    assert warc.round_trip(spark, frame(spark, [])).collect() == []


def record(**change):
    digest = hashlib.sha256(b"body").hexdigest()
    return warc.encode_record(1, "http://a/ü", b"body", digest, None, "2024-01-01T00:00:00Z")


def archive(frames, dictionary=b"", compressed=True):
    content = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    head = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content
    return (head if dictionary else b"") + b"".join(zstandard.ZstdCompressor(dict_data=data).compress(f) for f in frames)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=8), st.binary(min_size=8, max_size=400), st.booleans())
def test_frames_round_trip(frames, dictionary, compressed):
    dictionary = b"d" + dictionary
    assert list(warc.read_frames(io.BytesIO(archive(frames, dictionary, compressed)))) == frames
    assert list(warc.read_frames(io.BytesIO(archive(frames)))) == frames


def test_good_record():
    r = warc.decode_record(record())
    assert r.payload == b"body" and r.headers["Warc-Record-Id"] == "<urn:x-page:1>"


@pytest.mark.parametrize("change", [
    lambda d: d.replace(b"WARC/1.1", b"WARC/9", 1), lambda d: d.replace(b"WARC-Date", b"X-Date", 1),
    lambda d: d.replace(b"body", b"bodi"), lambda d: d + b"x", lambda d: d[:-1], lambda d: d.replace(b"\r\n", b"\n"),
    lambda d: d.replace(b"WARC-Type: ", b"WARC Type: ", 1), lambda d: d.replace(b"Content-Length: 8", b"Content-Length: x8", 1),
    lambda d: d[: d.rindex(b"Content-Length")] + b"\r\n\r\n",
])
def test_broken_records_are_refused(change):
    data = record()
    broken = change(data)
    if broken == data:
        pytest.skip("nothing to change")
    with pytest.raises(warc.WarcError):
        warc.decode_record(broken)


@pytest.mark.parametrize("cut", [lambda d: d[:-3], lambda d: d[:10], lambda d: b"junk" + d, lambda d: d + b"\x01",
                                 lambda d: d[:-30] + bytes([d[-30] ^ 255]) + d[-29:]])
def test_broken_archives_are_refused(cut):
    good = archive([record(), record()], b"a dictionary with WARC-Type and Content-Length in it")
    with pytest.raises(warc.WarcError):
        for data in warc.read_frames(io.BytesIO(cut(good))):
            warc.decode_record(data)


def test_errors_become_rows(spark, tmp_path):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(archive([record(), b"nonsense", record()])[:-2])
    manifest = spark.createDataFrame([(f"file://{path}",)], "path string")
    rows = warc.read_archives(manifest, strict=False).orderBy("position").collect()
    assert [bool(r.error) for r in rows] == [False, True, True]
    with pytest.raises(Exception, match="record 1"):
        warc.read_archives(manifest).collect()
