"""WARC archives: writer and splittable reader."""

import collections
import hashlib
import random

import pytest

from callgauge.llm import warc


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    same, short = "<p>" + "equal " * 40, "<p>short"
    rows = [(i, f"http://x/{i}", "".join(rng.choice("abc <é>") for _ in range(rng.choice([0, 50, 3000, 90_000])))) for i in range(60)]
    rows += [(70 + i, "http://y/ \r\né", same) for i in range(30)] + [(7, "u", "again " * 50), (7, "u", "again " * 50), (8, None, "again " * 50)]
    return rows + [(101, None, None), (102, "u", short), (103, "u", short), (None, "u", same), (104, "u", "x" * 3_000_000)]


def expected(pages):
    first = {}
    for page, _, html in pages:
        b = (html or "").encode()
        if len(b) >= 100 and page is not None:
            first[b] = min(page, first.get(b, page))
    out = collections.Counter()
    for page, _, html in pages:
        b = (html or "").encode()
        again = b in first and page != first[b]
        out[page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None] += 1
    return out


@pytest.mark.parametrize("file_bytes, split_bytes", [(1 << 26, 1 << 23), (20_000, 3_000), (100_000, 701)])
def test_round_trip(spark, pages, tmp_path, file_bytes, split_bytes):
    df = spark.createDataFrame([(*r, 1) for r in pages], "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path / "w"), file_bytes)
    assert sum(r.n_records for r in manifest.collect()) == len(pages)
    records = warc.read_archives(manifest, split_bytes, with_payload=True)
    rows = records.select(warc._page("record_id").alias("page"), "payload_bytes", "payload_digest", "record_type", warc._page("refers_to_id").alias("to")).collect()
    assert collections.Counter(tuple(r) for r in rows) == expected(pages)
    for r in records.collect():
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest


def test_foreign_bytes_are_skipped(tmp_path, monkeypatch):
    """Bytes that only look like a member, cut members and other gzip files are no records."""
    import zlib
    monkeypatch.setattr(warc, "PIECE", 500)

    def member(data):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    payload = b"hello " * 300
    whole = member(warc.record(1, "u", payload, hashlib.sha256(payload).hexdigest(), "response", None, "2020-01-01T00:00:00Z"))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.MAGIC + b"junk" + whole + member(b"no record") + whole[:-20] + whole + warc.MAGIC)
    size = path.stat().st_size
    for split in (size, 97):
        found = [r for a in range(0, size, split) for r in warc.read_range(str(path), a, min(a + split, size))]
        assert [r["payload_bytes"] for r in found] == [1800, 1800]


def test_pieces_of_any_size(tmp_path, monkeypatch):
    """A piece may end anywhere, also right behind the first bytes of a record's head."""
    import zlib
    rng, data = random.Random(9), b""
    for i in range(12):
        payload = bytes(rng.choice(b"abcdefgh <>") for _ in range(rng.choice([0, 40, 700])))
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        data += packer.compress(warc.record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), "response", None, "2020-01-01T00:00:00Z")) + packer.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for piece in range(1, 400):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert [r["record_id"] for r in warc.read_range(str(path), 0, len(data))] == [warc._record_id(i) for i in range(12)], piece


def test_a_very_long_target_uri(tmp_path):
    import zlib
    url = "http://x/" + "é" * 400_000  # a head of 2.4 MB
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    data = packer.compress(warc.record(1, url, b"hello", hashlib.sha256(b"hello").hexdigest(), "response", None, "2020-01-01T00:00:00Z")) + packer.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    found = list(warc.read_range(str(path), 0, len(data)))
    assert [(r["payload_bytes"], len(r["target_uri"])) for r in found] == [(5, 9 + 6 * 400_000)]


def test_a_lost_record_raises(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_archives(df, str(tmp_path / "w"))
    assert warc.checked(warc.read_archives(manifest), manifest).count() == len(pages)
    with pytest.raises(RuntimeError, match="read in part"):
        warc.checked(warc.read_archives(manifest).where("offset > 0"), manifest)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df, str(tmp_path / "w"))).count() == 0
