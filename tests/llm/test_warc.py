import hashlib
import random

import pytest

from spanloom.llm.common import shared_path
from spanloom.llm.warc import archive, parse, read_archives, record, unarchive, write_archives


def test_archive_round_trip():
    rng = random.Random(1)
    for n in (1, 5, 300):
        raw = [record(i, "http://a/", bytes(rng.choice(b"abc <>") for _ in range(rng.choice([0, 10, 900, 70000]))), "00" * 20, rng.choice([None, 3])) for i in range(n)]
        data = archive(raw)
        assert list(unarchive(data)) == raw and data[:4] == b"\x5d\x2a\x4d\x18"
    assert parse(record(7, "u", b"x\r\n\r\ny", hashlib.sha1(b"x\r\n\r\ny").hexdigest(), None))["payload_bytes"] == 6
    with pytest.raises(ValueError):
        list(unarchive(data[:-5]))


def brute(pages):
    out = []
    for i, html in pages:
        b = (html or "").encode()
        first = max((j for j, h in pages if (h or "").encode() == b and j is not None), default=None) if len(b) >= 1000 else None
        refers = first if first is not None and first != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_pages_against_brute_force(spark):
    big = "é" * 700
    pages = [(i, random.Random(i % 40).choice(["", "tiny", big, "z" * 999, "z" * 1000]) + str(i % 5) * (i % 3)) for i in range(200)] + [(300, None), (301, big * 3000), (302, big * 3000), (5, "again"), (None, big), (302, big * 3000)]
    df = spark.createDataFrame([(i, "http://x/\n", h, 1) for i, h in pages], "page_id long, url string, html string, digest int").repartition(4)
    got = read_archives(write_archives(df, shared_path(spark, "warc"), archive_bytes=1 << 18))
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages)
    assert read_archives(write_archives(df.limit(0), shared_path(spark, "warc"))).collect() == []
