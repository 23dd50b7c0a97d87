import base64

import pytest

from occugrid.llm import separators


def test_folders_lie_where_spark_looks_for_them(spark):
    assert separators.qualified(spark, "/a/b") == "file:///a/b"
    assert separators.qualified(spark, "file:/a/b") == "file:///a/b"
    assert separators.qualified(spark, "s3a://bucket/b") == "s3a://bucket/b"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://names:9000")
    try:
        assert separators.qualified(spark, "/a/b") == "hdfs://names:9000/a/b"
    finally:
        conf.set("fs.defaultFS", before)


def test_ids_beyond_16_bits_are_refused(make_docs, tmp_path):
    docs = make_docs([(1, "some text", "s")])
    with pytest.raises(ValueError, match="16 bits"):
        separators.write_token_files(docs, separator=70_000)
    # A vocabulary whose single bytes have ids from 100,000 on.
    ranks = tmp_path / "large.tiktoken"
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + f" {100_000 + b}".encode() for b in range(256)))
    with pytest.raises(Exception, match="does not fit in 16 bits"):
        separators.write_token_files(docs, vocabulary=str(ranks))
