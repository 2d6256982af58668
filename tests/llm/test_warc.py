"""Operator 5: round trip, determinism, commit and damage."""

import gzip
import hashlib
import os

import pytest

from blotter.llm import warc

BIG = "<p>" + "same payload " * 20 + "</p>"


def table():
    out = [(i, f"http://h/{i}", f"<p>page {i % 7} " + "é" * (i % 5) * 40 + "</p>") for i in range(60)]
    out += [(100, "u", BIG), (99, "u\r\nX: y", BIG), (101, None, BIG), (102, "u", None), (103, "u", ""),
            (104, "u", "x" * 99), (105, "u", "x" * 99), (106, "u", "y" * 100), (107, "u", "y" * 100),
            (None, "n", BIG), (None, None, None), (99, "u", BIG), (101, None, BIG), (1 << 40, "far", "z" * 5000)]
    return out


def want(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in payload:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payload:
        refers = first.get(p) if i is not None and i > first.get(p, i) else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("'x' AS shard", "'y' AS digest", "'z' AS kind", "*")


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("shard,roll", [(1 << 20, 1 << 20), (2000, 600)])
def test_round_trip(spark, tmp_path, shard, roll):
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archive(pages(spark, table()), folder, shard_bytes=shard, roll_bytes=roll).collect()
    got = warc.read_archive(spark, folder)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == want(table())
    names = sorted(n for n in os.listdir(tmp_path / "a") if n.endswith(".gz"))
    assert names == sorted(r.file for r in manifest) and not os.path.exists(tmp_path / "a/_temporary")
    assert (len(names) > 5) == (roll == 600)
    for r in manifest:
        data = (tmp_path / "a" / r.file).read_bytes()
        assert len(data) == r.n_bytes and hashlib.sha256(data).hexdigest() == r.sha256
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r.n_records + 1


def test_equal_input_gives_equal_files(spark, tmp_path):
    for name, rows in (("a", table()), ("b", table()[::-1])):
        warc.write_archive(pages(spark, rows).repartition(3 if name == "a" else 5), f"file://{tmp_path}/{name}",
                           shard_bytes=3000, roll_bytes=800)
    files = [{n: (tmp_path / d / n).read_bytes() for n in os.listdir(tmp_path / d) if n.endswith(".gz")} for d in "ab"]
    assert files[0] == files[1]


def test_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    name = warc.write_archive(pages(spark, table()[:9]), folder).collect()[0].file
    data = gzip.decompress((tmp_path / "a" / name).read_bytes())
    (tmp_path / "a" / name).write_bytes(gzip.compress(data.replace(b"page 3", b"page 8", 1)))
    with pytest.raises(Exception, match="digest or length|does not end|records"):
        warc.read_archive(spark, folder).collect()


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages(spark, table()).where("false"), folder)
    assert warc.read_archive(spark, folder).count() == 0


def test_shards_follow_the_bytes(spark, tmp_path):
    """A far outlier, and one id with a third of the rows, make no shard of more than twice its bytes."""
    rows = [(i, None, f"<p>{i} " + "x" * 900) for i in range(400)]
    rows += [(7, None, f"<p>of seven {i} " + "y" * 900) for i in range(200)] + [(10 ** 15, None, "z" * 950)]
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages(spark, rows), folder, shard_bytes=30_000, roll_bytes=1 << 20)
    got = warc.read_archive(spark, folder)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == want(rows)
    sizes = [r.n for r in got.groupBy("file").agg({"payload_bytes": "sum"}).toDF("file", "n").collect()]
    assert len(sizes) >= 20 and max(sizes) <= 60_000
