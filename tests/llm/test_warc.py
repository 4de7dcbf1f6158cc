from __future__ import annotations

import hashlib
import gzip
import os
import random
import re

from siloforge.llm import warc


def archive(n=20, size=500, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        payload = bytes(r.randrange(32, 127) for _ in range(size))
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % size + payload
        import hashlib

        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(head.encode() + block + b"\r\n\r\n")
    return out


def read(data, members=False):
    rows = list(warc.salvage(data))
    assert members or sum(r[1] for r in rows) == len(data) and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))
    return [r[3]["page_id"] for r in rows if r[2] is None and r[3]], [r for r in rows if r[2]]


def test_plain_and_gzip_records_mixed():
    recs = archive()
    data = b"".join(gzip.compress(x) if i % 3 else x for i, x in enumerate(recs))
    assert read(data) == (list(range(20)), [])


def test_damage_costs_only_the_damaged_records():
    for zipped in (False, True):
        recs = [gzip.compress(x) if zipped else x for x in archive()]
        r = random.Random(2)
        for hurt in range(20):
            bad = list(recs)
            at = r.randrange(len(bad[hurt]))
            bad[hurt] = bad[hurt][:at] + bytes([bad[hurt][at] ^ 0x55]) + bad[hurt][at + 1 :]
            ids, gaps = read(b"".join(bad))
            assert set(range(20)) - set(ids) <= {hurt}
        ids, gaps = read(b"".join(recs[:5]) + recs[5][:100] + b"junk WARC/1. \x1f\x8b\x08 junk" + b"".join(recs[6:]))
        assert ids == [i for i in range(20) if i != 5] and len(gaps) == 1
        ids, gaps = read(b"".join(recs)[:-30])
        assert ids == list(range(19)) and len(gaps) == 1
        ids, gaps = read(b"noise" + b"".join(recs))
        assert ids == list(range(20)) and gaps[0][:2] == (0, 5)


def test_records_inside_damaged_payloads_are_checked():
    inner = archive(1)[0]
    outer = archive(2)
    data = outer[0][:60] + inner[:200] + outer[1]
    ids, _ = read(data)
    assert ids == [1]


def test_archives_on_disk(spark, wide, tmp_path):
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 400)) for i in range(100)]
    warc.write(wide(rows, "page_id long, url string, html string"), str(tmp_path / "w"), archive_bytes=2000)
    files = [f for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    assert len(files) >= 5
    hurt = sorted(files)[0]
    path = tmp_path / "w" / hurt
    raw = path.read_bytes()
    path.write_bytes(raw[:30] + b"?" + raw[31:])
    (tmp_path / "w" / f".{hurt}.crc").unlink(missing_ok=True)
    got = warc.read(spark, str(tmp_path / "w"))
    assert got.filter("status = 'ok'").count() == 99 and got.filter("status = 'gap'").count() == 1
    assert got.filter("status = 'gap'").first()["reason"]


def test_empty(spark, wide, tmp_path):
    warc.write(wide([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_nothing_and_noise():
    assert list(warc.salvage(b"")) == []
    assert [r[1] for r in warc.salvage(b"\x1f\x8b" * 50)] == [100]
    assert [(r[2], r[3]) for r in warc.salvage(warc.zipped(b""))] == [(None, {})]


def test_very_long_headers_are_read():
    url = "http://example.org/" + "a" * (2 << 20) + " %" * 1000
    plain = warc.record(7, url, b"<p>", 3, hashlib.sha256(b"<p>").hexdigest())
    for data in (warc.zipped(plain), plain):
        (at, n, why, got), *rest = warc.salvage(data)
        assert (at, n, why, rest) == (0, len(data), None, []) and (got["page_id"], got["url"]) == (7, url)
        gap, found = warc.salvage(b"junk" + data)
        assert gap[:2] == (0, 4) and found[3]["url"] == url


def test_members_of_many_records():
    recs = archive()
    ids, gaps = read(gzip.compress(b"".join(recs[:12])) + b"".join(map(gzip.compress, recs[12:])), members=True)
    assert (ids, gaps) == (list(range(20)), [])
    ids, gaps = read(gzip.compress(b"".join(recs[:3]) + recs[3][:90] + b"".join(recs[4:])), members=True)
    assert ids == [i for i in range(20) if i != 3] and len(gaps) == 1 and gaps[0][2].startswith("in a gzip member")
    ids, gaps = read(gzip.compress(recs[0][:-9]) + gzip.compress(recs[1]))
    assert ids == [1] and gaps[0][2] == "the record doesn't end where its length says"


def test_every_file_is_read(spark, tmp_path):
    recs = archive()
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "CC-MAIN-0.warc.gz").write_bytes(gzip.compress(b"".join(recs[:9])))
    (tmp_path / "w" / "crawl.warc").write_bytes(b"".join(recs[9:]))
    assert sorted(r["page_id"] for r in warc.read(spark, str(tmp_path / "w")).collect()) == list(range(20))


def test_marks_by_the_thousand():
    rec = archive(1)[0]
    (gap, found) = warc.salvage(b"WARC/1.0\r\nA: b\r\n" * 20000 + b"\x1f\x8b\x08" * 20000 + rec)
    assert gap[2] and found[3]["page_id"] == 0


def test_a_page_with_a_very_long_url(spark, wide, tmp_path):
    rows = [(1, "http://a/" + "b" * (2 << 20), "x"), (2, "http://a/", "x")]
    wide(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r["page_id"] for r in warc.op10(spark, str(tmp_path)).collect()) == [1, 2]


def test_revisits_with_and_without_broadcast(spark, wide):
    pages = wide([(i, f"http://h/{i}", "x" * (200 + i % 5)) for i in range(40)], "page_id long, url string, html string")
    both = [sorted(bytes(r[0]) for r in warc.members(pages, broadcast_digests=most).collect()) for most in (0, 100)]
    assert both[0] == both[1] and sum(b"revisit" in gzip.decompress(m) for m in both[0]) == 35


def test_a_task_has_one_python_worker(spark, wide, tmp_path, monkeypatch):
    pages = wide([(i, f"http://h/{i}", "x" * (200 + i % 5)) for i in range(40)], "page_id long, url string, html string")
    plans, real = [], type(pages).mapInArrow

    def noted(*args, **options):
        out = real(*args, **options)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(pages), "mapInArrow", noted)
    for n, how in enumerate(({}, {"broadcast_digests": 0})):
        warc.write(pages, str(tmp_path / f"{n}"), **how)
        assert all(stage.count("MapInArrow") <= 1 for stage in re.split(r"\bExchange\b", plans[-1]))
        got = warc.read(spark, str(tmp_path / f"{n}")).select("page_id", "url", "payload_bytes", "record_type", "refers_to", "status").collect()
        assert sorted(map(tuple, got)) == [(i, f"http://h/{i}", 200 + i % 5, "revisit" if i > 4 else "response", i % 5 if i > 4 else None, "ok") for i in range(40)]


def test_payloads_are_kept_byte_for_byte(spark, tmp_path):
    html = b"\xff<p>" + b"x" * 200
    pages = spark.sql(f"SELECT id page_id, 'http://h/' url, CAST(X'{html.hex()}' AS STRING) html FROM range(3)")
    warc.write(pages, str(tmp_path / "w"))
    assert {(r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read(spark, str(tmp_path / "w")).collect()} == {(204, hashlib.sha256(html).hexdigest(), f) for f in (None, 0)}
