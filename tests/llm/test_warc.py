"""WARC records, framing and the round trip against a plain model."""

from __future__ import annotations

import hashlib
import io

import pytest

from demandlens.llm import warc

PAGES = "page_id long, url string, html string, digest string, salt int"


def expected(rows, least):
    best = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= least and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        group = sum(1 for r in rows if (r[2] or "").encode() == h)
        revisit = len(h) >= least and group > 1 and h in best and best[h] != i
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_the_model(spark):
    big, other = "é" * 600, "z" * 1200
    rows = ([(i, f"http://a/{i}\r\nX: y", big) for i in range(1, 40)] + [(50, None, None), (51, "", ""), (52, "u", "s" * 999),
            (53, "u", "s" * 999), (None, "n", big), (60, "o", other), (60, "o", other), (61, "one", "q" * 5000)])
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(4)
    got = warc.round_trip(df).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got),
                  key=str) == expected(rows, 1000)
    bodies = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert bytes(bodies[39]) == big.encode() and bytes(bodies[61]) == b"q" * 5000
    assert {r["url"] for r in got if r["page_id"] == 1} == {"http://a/1 X: y"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_members_are_read_one_by_one_whatever_the_read_size(monkeypatch):
    records = [warc.record(i, "u", b"x" * (i * 700), None) for i in range(20)]
    data = b"".join(map(warc.member, records))
    for size in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "READ", size)
        assert list(warc.members(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5])))


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse(good)[1] == b"payload"
    for bad in (good.replace(b"payload\r\n\r\n", b"paylaad\r\n\r\n"), good.replace(b"Content-Length: 7", b"Content-Length: 6"),
                b"HTTP/1.1" + good[8:]):
        with pytest.raises(ValueError):
            warc.parse(bad)
