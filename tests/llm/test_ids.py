"""Ids beyond doubles, null ids and clashing columns through every operator on documents and pages."""

import pytest

from graphlens.llm import decontam, html_text, line_dedup, media_chunks, packing, quality, sharding, simhash, url_filter

BIG = (2**53 + 1, None, 2**53 + 3, 2**63 - 1)
CLASH = "id long, t string, fp long, piece string, place int, row int, part int, shard int, items string, host string"


def operators(spark, docs):
    labels = spark.createDataFrame([(BIG[0], 1), (BIG[2], 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "an item that nobody has ever written in any text")], "item_id long, text string")
    return {
        "media": lambda: media_chunks.media_features(docs),
        "quality": lambda: quality.score_documents(docs, labels),
        "lines": lambda: line_dedup.dedup_lines(docs),
        "sharding": lambda: sharding.shards(docs, 3),
        "packing": lambda: packing.pack_documents(docs),
        "decontam": lambda: decontam.find_leaks(docs, bench),
        "simhash": lambda: simhash.near_duplicates(docs),
        "urls": lambda: url_filter.judge(docs, id_col="doc_id", url_col="text"),
        "pages": lambda: html_text.extract(docs, html_col="text", keep=("doc_id",)),
    }


@pytest.mark.parametrize("name", ["media", "quality", "lines", "sharding", "packing", "decontam", "simhash", "urls", "pages"])
def test_ids_stay_as_they_are(spark, name):
    rows = [(i, f"http://some.text/of {n}", 1, "t", 2, "p", 3, 4, 5, 6, "i", "h") for n, i in enumerate(BIG)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(2)
    out = [r.doc_id for r in operators(spark, docs)[name]().collect()]
    assert sorted(out, key=lambda i: (i is None, i or 0)) == sorted(BIG, key=lambda i: (i is None, i or 0))
    assert operators(spark, docs.limit(0))[name]().count() == 0
