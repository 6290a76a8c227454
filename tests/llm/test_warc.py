import hashlib

import pytest

from attesta.llm import warc

PAGES = "page_id long, url string, html string"


def test_round_trip(spark, odd, tmp_path):
    big, hot = "é" * 700, "<p>hot</p>" * 200
    rows = [(1, "http://a/%0A", big), (2, "u\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big)]
    rows += [(i, f"http://h/{i}", hot) for i in range(100, 160)] + [(9, "v", "x" * 5_000_000), (159, "again", hot)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'clash' digest", "'clash' n", "'clash' top")
    out = warc.archive(spark, df, f"file://{tmp_path}/arc", payloads=True).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    text = {(r[0], r[1]): (r[2] or "").encode() for r in rows}
    for r in out:
        raw = text[r["page_id"], r["url"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        top = max(p for p, _, h in rows if p is not None and (h or "").encode() == raw)
        if len(raw) >= 1000 and r["page_id"] != top:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", top, b"")
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("response", None, raw)


def test_files_follow_the_format(spark, tmp_path):
    import struct

    import zstandard as z

    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i} " + "common words " * 80) for i in range(300)], PAGES).repartition(2)
    files = warc.write_archives(warc.revisits(df), f"file://{tmp_path}/f").collect()
    assert sum(f["n_records"] for f in files) == 300
    raw = open(files[0]["path"], "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    one = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj()
    assert b"warcinfo" in one.decompress(raw[8 + size :]) and one.unused_data  # one frame holds one record
    assert len(raw) < sum(f["n_bytes"] for f in files) / 3


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "payload " * 200)], PAGES)
    rows = warc.revisits(df).withColumn("digest", warc.F.sha1(warc.F.lit(b"other")))
    files = warc.write_archives(rows, f"file://{tmp_path}/d")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark.createDataFrame(files.collect(), files.schema), f"file://{tmp_path}/d").collect()


def test_empty(spark):
    assert warc.archive(spark, spark.createDataFrame([], PAGES)).count() == 0
