import hashlib

import duckdb
import numpy as np
import pytest

from cloakframe.llm import exact_dedup, warc


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)
    every = np.concatenate([fp, fp[:700], np.repeat(fp[:1], 70000)])
    parts = [exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.build(p).to_bytes()) for p in np.array_split(every, 7)]
    keys, counts = exact_dedup.CountingQuotientFilter.merge(parts).items()
    want, n = np.unique(every, return_counts=True)
    assert (keys == want).all() and (counts == n).all()
    assert len(exact_dedup.CountingQuotientFilter.build(fp[:0]).items()[0]) == 0


def test_dedup_query_and_edges(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, exact_dedup.op5_exact_dedup(spark, sf_dir).collect())) == sorted(con.sql(exact_dedup.OP5_SQL).fetchall())
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x", "c"), (3, "x", "c"), (None, "x", "d"), (4, "y" * 200000, "e")], "doc_id long, text string, keep_id string")
    assert sorted(r.doc_id for r in exact_dedup.dedup(df).collect()) == [2, 3, 4]
    assert exact_dedup.dedup(df.limit(0)).count() == 0


def test_warc_query_and_edges(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(map(tuple, warc.op1_warc(spark, sf_dir).collect())) == sorted(con.sql(warc.OP1_SQL).fetchall())
    long = "é" * 600
    rows = [(1, "http://a.b/x", long, 1), (5, "http://a.b/x", long, 1), (5, "http://a.b/x", long, 1), (2, None, None, 1), (None, "http://q\n.r/ ü#f", long, 1), (7, "https://www.A.b:443/?q", "short", 1), (8, "https://a.b/?q", "short", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    folder = "file://" + str(tmp_path / "w")
    shards = warc.build_index(warc.write(df, folder), folder)
    got = sorted(((r.page_id, bytes(r.payload).decode(), r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.lookup(df, folder, shards), folder).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, "", sha(long), "revisit", 5), (5, long, sha(long), "response", None), (5, long, sha(long), "response", None), (2, "", sha(""), "response", None), (None, "", sha(long), "revisit", 5), (7, "short", sha("short"), "response", None), (8, "short", sha("short"), "response", None)]
    assert got == sorted(want, key=str)
    assert warc.surt("http://www.x.example.com:80/p?q#f") == "com,example,x)/p?q"
    empty = df.limit(0)
    assert warc.build_index(warc.write(empty, folder + "2"), folder + "2") == []


@pytest.mark.parametrize("stored", [b"short body", b"the body was Stored"])
def test_warc_read_fails_on_another_payload(spark, tmp_path, stored):
    body = b"the body was stored"
    sound = warc.record("http://a.b/x", 1, body, hashlib.sha1(body).hexdigest(), None, "2024-01-01T00:00:00Z")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 19\r\n\r\n"
    fake = warc.record("http://a.b/x", 1, stored, hashlib.sha1(body).hexdigest(), None, "2024-01-01T00:00:00Z")
    raw = warc.zlib.decompress(fake, 31).replace(b"Content-Length: %d\r\n\r\n%s" % (len(stored), stored), b"Content-Length: 19\r\n\r\n" + stored)
    assert head in raw
    packer = warc.zlib.compressobj(3, warc.zlib.DEFLATED, 31)
    fake = packer.compress(raw) + packer.flush()
    for name, member in (("sound", sound), ("fake", fake)):
        (tmp_path / name).write_bytes(member)
    places = spark.createDataFrame([("sound", 0, len(sound)), ("fake", 0, len(fake))], "file string, offset long, length long")
    folder = "file://" + str(tmp_path)
    assert [r.payload_bytes for r in warc.read(places.where("file = 'sound'"), folder, with_payload=False).collect()] == [19]
    with pytest.raises(Exception, match="not what its headers say"):
        warc.read(places.where("file = 'fake'"), folder, with_payload=False).collect()


def test_index_over_many_blocks_shards_and_archives(spark, tmp_path, monkeypatch):
    """A third of all rows repeat one url and page id; blocks and archives are small; one payload is long."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "ROLL_BYTES", 5000)
    monkeypatch.setattr(warc, "_FOUND", 10)
    rows = [(k, f"http://h{k % 20}.org/{k}", f"body {k}") for k in range(200)] + [(5000, "http://hot.org/x", "same")] * 100 + [(None, None, "nothing")] * 30 + [(9000, "http://long.org/", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = "file://" + str(tmp_path / "w")
    shards = warc.build_index(warc.write(df, folder), folder)
    index = warc.CaptureIndex(folder, shards)
    key = warc._key("http://hot.org/x", 5000)
    own = list(warc.shards_of(key, shards, [s[1] for s in shards]))
    places = [p for s in own for part in index.lookup(key, s) for p in part]
    assert len(places) == len(set(places)) == 100 and len(own) > 1
    assert max(len(index.directory(s[3])[0]) for s in shards) > 3 and len({p[0] for p in places}) >= 1
    assert not [x for k in range(len(shards)) for x in index.lookup(warc._key("http://hot.org/y", 1), k)]
    got = sorted((str(r.page_id), r.url or "", bytes(r.payload).decode()) for r in warc.read(warc.lookup(df, folder, shards), folder).collect())
    assert got == sorted((str(p), u or "", h) for p, u, h in rows)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 3
