"""Base counts against plain Python, the classifier on held-out labels."""

import random
import re
from collections import Counter

import numpy as np

from tessera.llm import quality as Q


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    eights = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, cover = Counter(eights), set()
    for i, x in enumerate(eights):
        if count[x] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_counts_of_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = Q.op8_quality_rules(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r[c] for c in (*Q.COUNTS, "base_failed")) == base(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_held_out_labels(spark):
    """Fit on half of the labels, judge the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    Q.prepare(spark)
    model = Q.train(docs, labels.filter("doc_id % 2 = 0"), rows=1000)
    judged = Q.score(docs.select("doc_id", "text"), model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in judged if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_edges(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a" * 9, "é ü x #*", "x y\nx y\n x y\n\nx y", "a b c d e f g h " * 5, "\n".join("same line" for _ in range(30)), "w " * 5000]
    texts += ["".join(rng.choice("ab \n\t#é") for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(None if i == 3 else i, t, 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    found = Q.score(df, None)
    assert found.columns[:4] == df.columns and found.columns[4] == "n_words_" and found.columns[-1] == "kept_"
    for r in found.collect():
        assert (r["n_words_"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(r["text"])
        assert r["probability"] is None and r["kept_"] == (not r["base_failed"])
    assert Q.score(df.limit(0), None).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert Q.train(docs, labels) is None and Q.train(docs, labels.limit(0)) is None


def test_few_labels_teach(spark):
    good, bad = " ".join(f"word{i} of calm prose" for i in range(20)), " ".join(f"click{i} $$$ now ###" for i in range(20))
    # the second case has its only good text among those held for calibration
    for kinds in ([1, 0], [0, 0, 0, 0, 1], [1, 0, 1, 0, 1, 0, 1]):
        docs = spark.createDataFrame([(i, good if k else bad) for i, k in enumerate(kinds)], "doc_id long, text string")
        Q.prepare(spark)
        model = Q.train(docs, spark.createDataFrame(list(enumerate(kinds)), "doc_id long, quality int"))
        found = Q.score(docs, model).orderBy("doc_id").collect()
        assert [r["kept"] for r in found] == [bool(k) for k in kinds]
