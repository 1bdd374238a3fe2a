"""Every stage on a small corpus, and the whole run against the same stages by hand."""

import re

import corpus_pipeline as P

from tessera.llm import packing

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = P.keep(stage(spark, docs, SF), re.sub(" ", "-", name))
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] > kept[3] == kept[4]
    assert docs.filter("n_chars != length(text)").count() == 0
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == kept[4]
    encode = packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], len(encode(r["text"])) + 1) for r in docs.select("doc_id", "text").collect())
    total = {}
    for r in P.run(spark, SF).select("doc_id", "length").collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert sorted(total.items()) == want


def test_repeats_and_copies_go(spark):
    a, b = ("".join(f"{w} " for w in (f"{s}{i}" for i in range(80))) for s in ("alpha", "beta"))
    rows = [(2, a + "tail", "en", "s", 0), (1, a + "tail", "en", "s", 0), (3, b + a, "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = P.near_duplicates(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "3", "None"]
    cut = {r["doc_id"]: r for r in P.passages(spark, one, SF).collect()}
    assert cut[3]["text"] == b and cut[3]["n_chars"] == len(b) and cut[1]["text"] == a + "tail" and cut[None]["text"] is None


def test_empty_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as kept", "text as node", "2 as language", "3 as probability")
    for rows in (docs.limit(0), docs.filter("doc_id < 60")):
        for _, stage in P.STAGES[:-1]:
            rows = P.keep(stage(spark, rows, SF), "stage")
            assert rows.columns == docs.columns
        assert (P.STAGES[-1][1](spark, rows, SF).count() > 0) == (rows.count() > 0)
