import base64
import gzip
import hashlib
import io

import pytest

from lexframe.llm import warc as W


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (5, "http://a/ b", "same"), (3, None, "same"), (9, "http://c", None), (1, "http://d", ""), (2, "http://e", "é\r\n\r\nWARC/1.1\nHTTP/1.1 200\r\n"), (7, "http://f", "x" * 200000), (None, "http://g", "same"), (4, "http://h", "same"), (4, "http://h", "other"),
    (8, "http://i", "filedesc://x 0 0 0 5\n1 0 x\n"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, version, monkeypatch):
    monkeypatch.setattr(W, "SEGMENT", 300)
    monkeypatch.setattr(W, "FILE_ROWS", 2)
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    W.write_arc(spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, payload string").repartition(3), arc, version=version)
    read = W.read_arc(spark, arc).collect()
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in read), key=str) == sorted(((i, h or "") for i, _, h in PAGES), key=str)
    assert len({r.record_id for r in read}) == len(PAGES) and {r.date for r in read} == {"2000-01-01T00:00:00Z"}
    W.convert(spark, arc, out)
    got = W.resolve(W.read_warc(spark, out)).collect()
    assert all(r.intact for r in got)
    want = []
    for i, _, h in PAGES:
        first = min(j for j, _, g in PAGES if (g or "") == (h or "") and j is not None)
        again = i is not None and i != first
        want.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_large_payloads_only(spark, tmp_path):
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    W.write_arc(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"), arc)
    W.convert(spark, arc, out, least_bytes=100)
    assert W.read_warc(spark, out).where("record_type = 'revisit'").count() == 0


def test_empty(spark, tmp_path):
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    W.write_arc(spark.createDataFrame([], "page_id bigint, url string, html string"), arc)
    W.convert(spark, arc, out)
    assert W.resolve(W.read_warc(spark, out)).count() == 0


def test_parsers():
    old = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n" % 76
    body = b"1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n\n"
    old = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(body) + body + b"\nhttp://a b 1.2.3.4 20010203040506 text/html 3\nabc\n"
    (fields, payload, error), = W.parse_arc(io.BytesIO(old))
    assert fields["URL"] == "http://a b" and fields["IP-address"] == "1.2.3.4" and payload == b"abc" and error is None
    (none, _, error), = W.parse_arc(io.BytesIO(old[:-3]))
    assert none is None and "declares" in error
    with pytest.raises(ValueError, match="WARC version"):
        list(W.parse_warc(io.BytesIO(gzip.decompress(gzip.compress(b"nonsense\n")))))


def test_malformed_headers_give_error_rows(spark, tmp_path):
    body = b"1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n"
    block = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(body) + body + b"\n"
    good = b"http://a 1.2.3.4 20010203040506 text/html 3\nabc\n"
    cases = {
        "few.arc": block + b"http://b 20010203040506 4\nlost\n" + good, "length.arc": block + b"http://b 1.2.3.4 20010203040506 text/html x9\nlost\n\n" + good,
        "date.arc": block + b"http://b 1.2.3.4 yesterday text/html 4\nlost\n" + good, "none.arc": good, "version.arc": block.replace(b"1 0 someone", b"7 0 someone") + good, "empty.arc": b"", "desc.arc": b"filedesc://x\n" + block + good,
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    found = {}
    for r in W.read_arc(spark, str(tmp_path)).collect():
        found.setdefault(r.file.rpartition("/")[2], []).append(r.error and r.error.split(":")[0])
    found = {k: sorted(v, key=str) for k, v in found.items()}
    assert found == {
        "few.arc": [None, "not a header"], "length.arc": [None, "not a header"], "date.arc": [None, "not a header"], "none.arc": ["no version block before"],
        "version.arc": ["no version block before", "unknown version block"], "desc.arc": [None, "not a header"],
    }
    W.convert(spark, str(tmp_path), str(tmp_path / "out"))
    assert W.read_warc(spark, str(tmp_path / "out")).where("intact").count() == 4


def test_files_are_taken_in_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "LISTED", 3)
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    W.write_arc(spark.createDataFrame([(i, "http://a", "same") for i in range(12)], "page_id bigint, url string, html string").repartition(5), arc)
    W.convert(spark, arc, out)
    got = W.resolve(W.read_warc(spark, out)).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(i, 0 if i else None) for i in range(12)}


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    """Copies of an archive are records of their own: ids differ, one is the response, and each revisit has one row."""
    W.write_arc(spark.createDataFrame(PAGES[:4], "page_id bigint, url string, html string").coalesce(1), str(tmp_path / "arc"))
    data = next(f for f in (tmp_path / "arc").rglob("part-*")).read_bytes()
    for folder in ("d1", "d2", "d2#x"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "a.arc").write_bytes(data)
    W.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = W.resolve(W.read_warc(spark, str(tmp_path / "out"))).collect()
    assert len(got) == 12 and len({r.record_id for r in got}) == 12 and all(r.intact for r in got)
    responses = [r for r in got if r.record_type == "response"]
    assert sorted(r.page_id for r in responses) == [1, 3]  # the empty payload, and "same"
    ids = {r.record_id: r.page_id for r in responses}
    assert all(r.refers_to == ids[r.refers_to_record] for r in got if r.record_type == "revisit")
    again = {r.record_id for r in W.read_arc(spark, f"file:{tmp_path}/in").collect()}
    assert again == {r.record_id for r in got}


def test_wrong_warc_files_give_error_rows(spark, tmp_path):
    """Records before the fault are read, the fault is a row, and other files are not touched by it."""
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = record % 1 + record % 2
    cases = {
        "good.warc": two, "good.warc.gz": gzip.compress(record % 1) + gzip.compress(record % 2), "cut.warc": two[:-6], "foreign.warc": record % 1 + b"<html>\n", "empty.warc": b"", "gone.warc.gz": gzip.compress(two)[:-9],
        "length.warc": (record % 1).replace(b": 3", b": x"), "none.warc": record % 1 + (record % 2).replace(b"Content-Length: 3\r\n", b""), "noise.warc.gz": gzip.compress(record % 1) + b"\x1f\x8bnoise", "id.warc": (record % 1).replace(b"WARC-Record-ID", b"X"),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    found = {}
    for r in sorted(W.read_warc(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.place)):
        found.setdefault(r.file.rpartition("/")[2], []).append(r.error is None)
        assert (r.record_id is None) == (r.error is not None)
    assert {k: v for k, v in found.items() if k not in ("gone.warc.gz", "noise.warc.gz")} == {
        "good.warc": [True, True], "good.warc.gz": [True, True], "cut.warc": [True, False], "foreign.warc": [True, False], "length.warc": [False], "none.warc": [True, False], "id.warc": [False],
    }
    assert found["gone.warc.gz"][-1] is False and found["noise.warc.gz"][-1] is False
    errors = {r.file.rpartition("/")[2]: r.error for r in W.read_warc(spark, str(tmp_path)).where("error IS NOT NULL").collect()}
    assert "declares 3 bytes, 1 are left" in errors["cut.warc"] and errors["none.warc"] == "no header content-length" and "no WARC version line" in errors["foreign.warc"]
    assert W.resolve(W.read_warc(spark, str(tmp_path))).where("error IS NULL").count() == sum(x.count(True) for x in found.values())
