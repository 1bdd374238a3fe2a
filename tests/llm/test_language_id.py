"""Languages of labelled rows, evidence that tips short texts, smoothing and edges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as L


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = L.op1_language_id(spark, folder).collect()
    docs = [r for r in found if r["doc_id"] is not None]
    assert len(docs) == len(lang) and len(found) == len(lang) + spark.read.parquet(f"{folder}/pages.parquet").count()
    assert np.mean([r["text_language"] == lang[r["doc_id"]] for r in docs]) > 0.98
    assert np.mean([r["kept"] for r in docs]) > 0.99


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    L.prepare(spark)
    return L.train(docs.filter("doc_id % 2 = 0").select("text", F.col("lang").alias("declared")))


def test_held_out_text_alone(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 1 and n_chars > 100")
    found = L.identify(docs, "text", model=model).select("lang", "text_language").collect()
    assert np.mean([r["lang"] == r["text_language"] for r in found]) > 0.98


def test_declared_host_and_address_tip_short_texts(spark, model):
    long = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'fr' and n_chars > 500").limit(40).collect()]
    rows = [(t, "fr", "http://a.example.fr/x", "a.example.fr") for t in long] + [("an", "fr", "http://a.example.fr/fr/", "a.example.fr"), ("an", None, None, None)]
    found = L.identify(spark.createDataFrame(rows, "text string, said string, url string, host string"), "text", "said", "url", "host", model=model).collect()
    assert found[-2]["language"] == "fr" and found[-1]["confidence"] < found[-2]["confidence"]


def test_edges(spark, model):
    rows = [(1, None, "en"), (2, "", None), (3, "12 345 !!", "en"), (4, "the the of and in that " * 3, "xx"), (4, "the the of and in that " * 3, "xx"), (None, "the of and " * 40_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    found = L.identify(df, "text", "language", model=model)
    assert found.columns == ["doc_id", "text", "language", "language_", "confidence", "text_language", "kept"]
    kept = [(r["doc_id"], r["kept"], r["language_"]) for r in found.collect()]
    assert kept == [(1, False, "und"), (2, False, "und"), (3, False, "und"), (4, True, "en"), (4, True, "en"), (None, True, "en")]
    assert L.identify(df.limit(0), "text", "language").count() == 0


def test_salted_join_is_the_broadcast_one(spark, model, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    one = sorted(map(str, L.identify(docs, "text", "lang", None, "source", model=model).collect()))
    monkeypatch.setattr(L, "BROADCAST", 0)
    assert one == sorted(map(str, L.identify(docs, "text", "lang", None, "source", model=model).collect()))


def test_host_priors_back_off(spark):
    counts = spark.createDataFrame([("a.x.org", None, None, "en", 100), ("b.x.org", None, None, "de", 1), ("c.y.net", None, None, "fr", 50)], "host string, declared string, hint string, language string, n long")
    prior = {r["host"]: r["prior"] for r in L.host_priors(counts, ["de", "en", "fr"], 20.0).collect()}
    assert all(abs(sum(p) - 1) < 1e-9 for p in prior.values())
    assert prior["a.x.org"][1] > 0.9 and prior["b.x.org"][1] > prior["b.x.org"][0] and prior["c.y.net"][2] > 0.8


def test_page_parts(spark):
    df = spark.createDataFrame([('<html lang="FR-ca"><head><title>t</title></head><body><script>x</script><p>Bon&eacute; jour</p></body></html>', "https://de.Example.co.uk/fr/1?x")], "html string, url string")
    row = df.select(L.declared(F.col("html")), F.trim(L.visible(F.col("html"))), L.host_of(F.col("url")), L.hint_of(F.col("url"), ["fr", "de"])).first()
    assert tuple(row) == ("fr", "Bon  jour", "de.example.co.uk", "fr")


def test_every_declared_language_is_kept(spark):
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [a + b for a in "abc" for b in letters][:70]
    words = {c: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(40)] for c in codes}
    size = {codes[0]: 10, codes[1]: 5000}  # all texts short, all texts over FIT_BYTES; the others in between
    text = lambda c: " ".join(rng.choice(words[c], size.get(c, 60)))
    rows = [(text(c), c) for i, c in enumerate(codes) for _ in range(3 if i < 2 else 3 + i % 3)]
    found = L.identify(spark.createDataFrame(rows, "text string, said string"), "text", "said").collect()
    assert {r["said"] for r in found} == set(codes)
    assert all(r["language"] == r["text_language"] == r["said"] and r["kept"] for r in found)


def test_few_words_of_a_language_do_not_replace_und(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", F.col("lang").alias("said"))
    rare = spark.createDataFrame([("blip", "zz")], "text string, said string")
    model = L.train(docs.union(rare).select("text", F.col("said").alias("declared")))
    junk = spark.createDataFrame([("qxzj wvkq zzxq jqkx vvqz xkjq " * 5,)], "text string")
    assert "zz" in model.languages and L.identify(junk, "text", model=model).first()["text_language"] != "zz"


def test_layout_makes_no_difference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    found = lambda df: sorted(map(str, L.identify(df, "text", "lang", None, "source").drop("text").collect()))
    assert found(docs) == found(docs.repartition(7))


def test_regional_tags_are_their_language(spark, model):
    rows = [("fr-CA",), ("FR_ca",), (" fr ",), ("fr",), ("francais",), ("f",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "said string").select(L.subtag(F.col("said"))).collect()] == ["fr"] * 4 + [None] * 3
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    plain = sorted(map(str, L.identify(docs, "text", "lang", model=model).drop("lang", "text").collect()))
    assert sorted(map(str, L.identify(docs.withColumn("lang", F.concat(F.upper("lang"), F.lit("-XY"))), "text", "lang", model=model).drop("lang", "text").collect())) == plain


def test_posterior_against_plain_python(spark, model):
    rows = [(r["text"], r["lang"], f"https://{r['source']}.example.{('fr', 'de', 'org')[r['doc_id'] % 3]}/{('fr/x', 'y', 'de')[r['doc_id'] % 3]}") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(80).collect()]
    rows += [("the of and", None, None), ("!!", "fr", "http://x.fr/"), ("Ångström el que", "es-MX", "http://es.site.com/")]
    names = model.languages
    m32 = (1 << 32) - 1

    def text_logs(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
        out = np.zeros(len(names))
        for i, c in enumerate(b):
            if c != 32:
                h = ((b[i - 1] if i else 32) * 0x9E3779B1 + c * 0x85EBCA77 + (b[i + 1] if i + 1 < len(b) else 32) * 0xC2B2AE3D) & m32
                h = ((h ^ h >> 15) * 0x2C1B3C6D) & m32
                out += model.table[h >> (32 - L.BITS)].astype(float)
        return out, any(c != 32 for c in b)

    def hint(url):
        if url is None:
            return None
        path = re.search(r"://(?:[^/?#]*/(?:[^?#]*/)?)([a-zA-Z]{2})(?:[/?#]|$)", url)
        sub, last = re.search(r"://([a-zA-Z]{2})\.", url), re.search(r"://[^/?#:]*\.([a-zA-Z]{2})(?:[/?#:]|$)", url)
        for found in (path, sub):
            if found and found[1].lower() in names:
                return found[1].lower()
        return L.COUNTRY.get(last[1].lower()) if last else None

    facts = []
    for text, said, url in rows:
        logs, letters = text_logs(text)
        host = re.match(r"https?://([^/]+)", url)[1] if url else None
        facts.append((logs, letters, names[int(np.argmax(logs))] if letters else "und", said.split("-")[0] if said else None, hint(url), host))
    count = lambda test: np.array([sum(1.0 for f in facts if f[2] == x and test(f)) for x in names])
    known = [x for x in names if x != "und"]

    def evidence(value, column):
        if value not in known:
            return 0.0
        total = sum(count(lambda f, h=h: f[column] == h) for h in known)
        agree = np.array([5.0 if x == value else 0.0 for x in names])
        less = np.array([5.0 if x == "und" else 0.0 for x in names])
        return np.log((count(lambda f: f[column] == value) + agree + 5.0 / len(known)) / (total + 10.0 - less))

    def prior(host):
        p = (count(lambda f: True) + 1) / (len(facts) + len(names))
        for level in (1, 2, 99):
            own = count(lambda f, level=level: f[5] is not None and f[5].split(".")[-level:] == host.split(".")[-level:])
            p = (own + L.STRENGTH * p) / (own.sum() + L.STRENGTH)
        return np.log(p)

    got = L.identify(spark.createDataFrame(rows, "text string, said string, url string"), "text", "said", "url", model=model).collect()
    for (logs, letters, *_, said, hinted, host), r in zip(facts, got, strict=True):
        post = L.TEMPER * logs + evidence(said, 3) + evidence(hinted, 4) + (prior(host) if host else 0.0)
        post = np.exp(post - post.max())
        post /= post.sum()
        if letters:
            best = int(np.argmax(post))
            assert r["language"] == names[best] and abs(r["confidence"] - post[best]) < 1e-6
            assert r["kept"] == (names[best] != "und" and post[best] >= L.LEAST)
        else:
            assert r["language"] == "und" and not r["kept"]


def _with_junk(spark, codes):
    """Documents, and two short rows for each of many codes that stand for no language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", F.col("lang").alias("said"), F.col("source").alias("host"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b + c for a in "qxz" for b in letters for c in letters][:codes]
    rng = np.random.default_rng(3)
    junk = [(" ".join("".join(rng.choice(list(letters), 6)) for _ in range(12)), x, f"h{i % 90}.example.{x}") for i, x in enumerate(names) for _ in range(2)]
    return docs, docs.union(spark.createDataFrame(junk, docs.schema))


def test_a_thousand_junk_codes_take_little(spark):
    L.prepare(spark)
    docs, full = _with_junk(spark, 1000)
    model = L.train(full.select("text", F.col("said").alias("declared")))
    assert len(model.languages) == 1005
    assert sum(x.nbytes for x in (model.dense, model.sparse.heads, model.sparse.column, model.sparse.delta)) < 8 << 20
    found = L.identify(full, "text", "said", host="host", model=model)
    # no expression for each code (but for the literal lists of codes)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 50
    real = found.filter("length(said) = 2 and text rlike '[a-z]'").select("said", "language", "kept").collect()
    assert np.mean([r["said"] == r["language"] and r["kept"] for r in real]) > 0.98


def test_sparse_tables_hold_what_dense_ones_do(spark, monkeypatch):
    import pyarrow as pa

    from tessera.llm.kernels import text_bytes

    L.prepare(spark)
    _, full = _with_junk(spark, 40)
    rows = full.select("text", F.col("said").alias("declared"))
    texts = [r[0] for r in full.filter("length(text) < 4000").select("text").limit(200).collect()] + ["", "!! 1", "é" * 70]
    data, offsets = text_bytes(pa.array(texts))
    found = []
    for dense, piece in ((0, 1 << 20), (0, 50), (8, 1 << 20), (1000, 1 << 20)):
        monkeypatch.setattr(L, "DENSE", dense)
        monkeypatch.setattr(L, "PIECE", piece)
        model = L.train(rows)
        logs, letters = model.likelihoods(data, offsets)
        places, row = L.trigrams(L._FOLD[data], offsets)
        plain = np.zeros_like(logs)
        np.add.at(plain, row, model.table[places])
        assert np.allclose(logs, plain, rtol=1e-6, atol=1e-6)
        found.append((model.languages, logs, letters))
    for names, logs, letters in found[1:]:
        assert names == found[0][0] and np.allclose(logs, found[0][1], rtol=1e-5, atol=1e-3) and (letters == found[0][2]).all()


def test_parts_bound_the_scores(spark, model, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    found = lambda: sorted(map(str, L.identify(docs, "text", "lang", None, "source", model=model).drop("text").collect()))
    one = found()
    monkeypatch.setattr(L, "CELLS", 1)
    assert found() == one
