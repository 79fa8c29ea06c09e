from __future__ import annotations

import pytest

from glossa.llm import tokencounts as tc
from glossa.llm.common import scratch
from glossa.llm.common import table as read
from tests.llm.helpers import SCHEMA, odd_rows, row, rows_of, table


@pytest.fixture(scope="module")
def enc():
    from pathlib import Path

    p = tc.TokenCountParams()
    return tc.encoder(Path(p.vocabulary).read_bytes(), p)


def test_counts_are_the_tokenizers(spark, data, enc):
    docs = read(spark, data, "documents")
    cache = scratch(spark, "cache")
    got = {r.doc_id: r.tokens for r in tc.token_counts(docs, cache).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {r.doc_id: len(enc.encode_ordinary(tc.normalised(r.text))) for r in rows}
    stored = spark.read.parquet(f"{cache}/{tc.version(tc.TokenCountParams())}")
    assert stored.count() == stored.select("digest").distinct().count() == len({tc.normalised(r.text) for r in rows if r.text})


def test_known_digests_are_not_encoded_again(spark, enc, monkeypatch):
    docs = table(spark, [row(1, "some words"), row(2, "some words"), row(3, "others")])
    cache = scratch(spark, "cache")
    p = tc.TokenCountParams()
    first = rows_of(tc.token_counts(docs, cache, p))
    path = f"{cache}/{tc.version(p)}"
    # A stored count is believed, which shows that nothing is encoded again; a new text adds one row.
    spark.createDataFrame([(tc.content_digest("planted"), 777)], "digest binary, tokens long").write.mode("append").parquet(path)
    more = docs.unionByName(table(spark, [row(4, "planted"), row(5, "new text")]))
    got = dict(rows_of(tc.token_counts(more, cache, p)))
    assert got[4] == 777 and {k: got[k] for k in (1, 2, 3)} == dict(first)
    assert spark.read.parquet(path).count() == 4


def test_few_and_many_misses_agree(spark):
    rows = odd_rows() + [row(None, "null id"), row(None, "another null id"), row(40, "a text"), row(40, "another text")]
    docs = table(spark, rows)
    few, many = (rows_of(tc.token_counts(docs, scratch(spark, "cache"), tc.TokenCountParams(broadcast_misses=n))) for n in (10**6, 0))
    assert few == many and len(few) == len(rows)


def test_another_version_has_its_own_cache(spark, enc):
    docs = table(spark, [row(1, "a-b c")])
    cache = scratch(spark, "cache")
    a = tc.token_counts(docs, cache).collect()[0].tokens
    b = tc.token_counts(docs, cache, tc.TokenCountParams(pattern=r"(?s:.)")).collect()[0].tokens
    assert (a, b) == (len(enc.encode_ordinary("a-b c")), 5)


def test_equal_content_in_other_forms():
    assert tc.content_digest("é\r\nx\ry") == tc.content_digest("é\nx\ny")
    assert tc.content_digest("a") != tc.content_digest("b")


def test_odd_rows(spark, enc):
    docs = table(spark, odd_rows(), clash=True)
    got = sorted((str(r.doc_id), r.tokens) for r in tc.token_counts(docs, scratch(spark, "cache")).collect())
    assert got == sorted((str(r[0]), len(enc.encode_ordinary(r[1])) if r[1] else 0) for r in odd_rows())
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(tc.token_counts(none, scratch(spark, "cache"))) == []
    assert rows_of(tc.token_counts(table(spark, [row(1, None)]), scratch(spark, "cache"))) == [(1, 0)]
