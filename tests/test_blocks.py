import hashlib
import os
import resource

from spanloom.sources.blocks import digests
from spanloom.sources.records import manifest


def test_files_by_blocks(spark, tmp_path):
    data = {"a.jsonl": b"x\n\ny", "b.txt": b"", "c d.bin": os.urandom(3_000_000)}
    for n, x in data.items():
        (tmp_path / n).write_bytes(x)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    want = {n: (len(x), hashlib.sha256(x).hexdigest(), x.count(b"\n"), None) for n, x in data.items()}
    for df in (digests(spark, [str(tmp_path / n) for n in data], 1000), manifest(spark, str(tmp_path)), manifest(spark, f"file://{tmp_path}/*")):
        assert {r.path.rsplit("/", 1)[1].replace("%20", " "): tuple(r)[1:] for r in df.collect()} == want
    gone = manifest(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "gone")]).collect()
    assert sorted((r.path[-4:], r.error) for r in gone) == [("gone", "missing"), ("sonl", None)] and digests(spark, []).collect() == []


def test_a_file_larger_than_memory_allows_at_once(spark, tmp_path):
    """2.2 GB, more than a row or an array holds."""
    n = (1 << 31) + (1 << 27)
    with open(tmp_path / "big", "wb") as f:
        f.truncate(n)
        f.seek(n - 1)
        f.write(b"\n")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    r = manifest(spark, str(tmp_path / "big")).first()
    own = hashlib.sha256()
    zero = bytes(1 << 20)
    for _ in range((n >> 20) - 1):
        own.update(zero)
    own.update(zero[:-1] + b"\n")
    assert (r.size_bytes, r.line_count, r.sha256) == (n, 1, own.hexdigest()) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
