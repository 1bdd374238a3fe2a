"""Language ID: Bayesian evidence fusion of text, declared markup language, address suffix and host.

The posterior over languages, and over "und" for text that fits none, is the product of

- a host prior: counts of first-pass languages by host, smoothed towards the host's parent domain, that towards its
  last label, that towards the whole corpus (one grouped aggregation per level, each a Dirichlet prior of STRENGTH
  rows for the next);
- the text's likelihood under a naive Bayes model of byte trigrams, tempered by TEMPER as they overlap;
- the likelihood of the declared language, and that of the address hint (a two-letter path segment or subdomain, else
  the country suffix), each from counts of the hint by first-pass language over the whole corpus.

A declared language counts by its first subtag: pt-BR is pt, whatever the case. The text model has every declared
language. It is fitted on about FIT_ROWS distinct labelled texts per language, short and long, of which the first
FIT_BYTES bytes count (parameters); they are chosen by hash, so results do not depend on how rows are dealt to tasks. It
takes 256 KiB a language in each worker, and in the driver the sample besides. Counts for priors and hints cover every row. Host priors
reach the rows by a join on the host; it is broadcast only if it has BROADCAST rows at most, else both sides are
shuffled with the rows of a host spread over SALTS sub-keys.

A row is rejected if its text has no letter, if "und" wins, or if the best language has less than LEAST.

Edge cases: null text counts as empty and is rejected; a null or unknown declared language, url or host is no
evidence; with no declared language at all every text with letters is "und" and rejected; repeated rows are judged
each; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, keep, prepare
from tessera.llm.kernels import sums_at, text_bytes
from tessera.llm.quality import slices

FIT_ROWS, FIT_BYTES = 600, 16384
BITS, TEMPER, STRENGTH, LEAST = 16, 0.2, 20.0, 0.5
BROADCAST, SALTS = 1 << 20, 32
#: Languages with a dense column, those of most trigrams; entries and scores worked on at once.
DENSE, PIECE, CELLS = 8, 1 << 20, 1 << 20
#: Country suffixes that hint at a language. Fixed values.
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: Small letters stay, capitals become small, bytes of other scripts stay, all else is a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Entries:
    """A sparse table: a start value for each column and, by row, the columns that differ from it and by how much."""

    start: np.ndarray
    heads: np.ndarray
    column: np.ndarray
    delta: np.ndarray

    def add(self, out: np.ndarray, row: np.ndarray, key: np.ndarray) -> None:
        """Add to out[row[i]] the differences in table row key[i], for all i, row not falling; the start values are left to the caller."""
        size = self.heads[key + 1] - self.heads[key]
        some = np.flatnonzero(size)
        row, key, size = row[some], key[some], size[some]
        total, low = np.cumsum(size), 0
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(total, total[low] - size[low] + PIECE, "right")))
            part = slice(low, high)
            first = total[part] - size[part]
            at = np.repeat(self.heads[key[part]] - first, size[part]) + np.arange(first[0], total[high - 1])
            top, width = row[low], out.shape[1]
            cells = (row[high - 1] + 1 - top) * width
            if cells <= 4 * PIECE:
                out[top : row[high - 1] + 1] += np.bincount((np.repeat(row[part], size[part]) - top) * width + self.column[at], self.delta[at], cells).reshape(-1, width)
            else:
                np.add.at(out, (np.repeat(row[part], size[part]), self.column[at]), self.delta[at])
            low = high


def entries(start: np.ndarray, rows: int, row: np.ndarray, column: np.ndarray, delta: np.ndarray, kind: type) -> Entries:
    """The table of the given cells, in any order, one for each place at most."""
    order = np.lexsort((column, row))
    heads = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)
    return Entries(start, heads, column[order].astype(np.int32), delta[order].astype(kind))


@dataclass
class TextModel:
    """Log-probabilities of hashed trigrams by language, and a flat one for "und".

    The languages of most trigrams (front) have dense columns, of whole values; all others are in sparse.
    """

    languages: list[str]
    front: np.ndarray
    dense: np.ndarray
    sparse: Entries

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood by row and language, and whether a row has a letter."""
        folded = _FOLD[data]
        places, row = trigrams(folded, offsets)
        out = np.bincount(row, minlength=len(offsets) - 1)[:, None] * self.sparse.start
        if len(row):
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[heads][:, None], self.front] = np.add.reduceat(self.dense[places], heads, axis=0, dtype=np.float64)
            if len(self.sparse.column):
                self.sparse.add(out, row, places)
        return out, sums_at(folded != 32, offsets) > 0

    @cached_property
    def table(self) -> np.ndarray:
        """All values as one array, to look at: a row for each trigram, a column for each language."""
        out = np.repeat(self.sparse.start[None], 1 << BITS, axis=0)
        self.sparse.add(out, np.arange(1 << BITS), np.arange(1 << BITS))
        out[:, self.front] = self.dense
        return out


def trigrams(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed three bytes around each letter (a blank beyond a row's ends), and its row."""
    x = folded.astype(np.uint32)
    before, after = np.full_like(x, 32), np.full_like(x, 32)
    before[1:], after[:-1] = x[:-1], x[1:]
    size = np.diff(offsets)
    before[offsets[:-1][size > 0]] = 32
    after[offsets[1:][size > 0] - 1] = 32
    hashed = before * np.uint32(0x9E3779B1) + x * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    letters = np.flatnonzero(folded != 32)
    return (hashed[letters] >> np.uint32(32 - BITS)), np.repeat(np.arange(len(size)), size)[letters]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """declared, place and n of each trigram; a row with place -1 for each language, which may have none."""
    for whole in batches:
        for batch in slices(whole, 1):
            said = batch.column(0).dictionary_encode()
            places, row = trigrams(_FOLD[text_bytes(batch.column(1))[0]], text_bytes(batch.column(1))[1])
            code = said.indices.to_numpy().astype(np.int64)
            keys, n = np.unique(np.concatenate([np.arange(len(said.dictionary)) << BITS + 1, (code[row] << BITS + 1) + places + 1]), return_counts=True)
            place = (keys & (2 << BITS) - 1) - 1
            yield pa.RecordBatch.from_arrays([said.dictionary.take(pa.array(keys >> BITS + 1)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64))], names=["declared", "place", "n"])


def fit(sample: DataFrame) -> TextModel:
    """Naive Bayes on rows of declared and text, a small constant added to every count; "und" has all trigrams seen alike.

    The driver gets a row for each trigram of each language, never texts.
    """
    counts = sample.mapInArrow(_count_trigrams, "declared string, place int, n long").groupBy("declared", "place").agg(F.sum("n").alias("n")).toArrow()
    said = counts.column("declared").combine_chunks().dictionary_encode()
    said = said.chunk(0) if isinstance(said, pa.ChunkedArray) else said
    names = sorted(said.dictionary.to_pylist())
    rank = {x: i for i, x in enumerate(names)}
    place = counts.column("place").to_numpy()
    code = np.array([rank[x] for x in said.dictionary.to_pylist()], np.int64)[said.indices.to_numpy()]
    n, real = counts.column("n").to_numpy().astype(np.float64), place >= 0
    place, code, n = place[real], code[real], n[real]
    total = np.bincount(code, n, len(names))
    # with little text the constant is smaller, so that a language of a few words is not likelier than "und" for any text
    small = np.minimum(0.05, np.maximum(0.1 * total, 1e-6) / (1 << BITS))
    whole = total + small * (1 << BITS)
    flat = np.float32(np.log(1 / (8 * max(1, len(np.unique(place)))))) if names else 0.0
    start = np.concatenate([np.log(small / whole).astype(np.float32), [flat]]).astype(np.float64)
    value = np.log((n + small[code]) / whole[code])
    front = np.sort(np.argsort(-np.bincount(code, minlength=len(names)), kind="stable")[:DENSE])
    column = np.full(len(names), -1)
    column[front] = np.arange(len(front))
    dense = np.repeat(start[front][None].astype(np.float32), 1 << BITS, axis=0)
    inside = column[code] >= 0
    dense[place[inside], column[code[inside]]] = value[inside]
    rest = ~inside
    return TextModel([*names, "und"], front, dense, entries(start, 1 << BITS, place[rest], code[rest], value[rest] - start[code[rest]], np.float32))


def parts(batch: pa.RecordBatch, at_text: int, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch by bytes of text, and of so few rows that their scores for width languages are few."""
    for piece in slices(batch, at_text):
        step = max(1, CELLS // width)
        for low in range(0, piece.num_rows, step):
            yield piece.slice(low, step)


def declared(html: Column) -> Column:
    """The language that a page's html element declares."""
    return subtag(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-zA-Z][a-zA-Z0-9_-]*)""", 1))


def subtag(said: Column) -> Column:
    """The first subtag of a declared language, in small letters; null if it is not two or three letters."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(said)), r"^([a-z]{2,3})(?:[_-][a-z0-9_-]*)?$", 1), F.lit(""))


def visible(html: Column) -> Column:
    """A page's text: scripts, styles, comments, navigation and tags gone."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def hint_of(url: Column, languages: list[str]) -> Column:
    """The language that an address hints at: a segment or subdomain that names one, else its country suffix."""
    named = F.lower(F.regexp_extract(url, r"://(?:[^/?#]*/(?:[^?#]*/)?)([a-zA-Z]{2})(?:[/?#]|$)", 1))
    sub = F.lower(F.regexp_extract(url, r"://([a-zA-Z]{2})\.", 1))
    last = F.lower(F.regexp_extract(url, r"://[^/?#:]*\.([a-zA-Z]{2})(?:[/?#:]|$)", 1))
    country = F.coalesce(*[F.when(last == c, F.lit(lang)) for c, lang in COUNTRY.items()])
    known = [x for x in languages if len(x) == 2] or [""]
    return F.coalesce(F.when(named.isin(known), named), F.when(sub.isin(known), sub), country)


def _evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """First-pass language of each row by text alone, counted by host and hints within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 0, len(model.languages)):
                data, offsets = text_bytes(batch.column(0))
                logs, letters = model.likelihoods(data, offsets)
                best = np.where(letters, np.argmax(logs, 1), len(model.languages) - 1)
                names = pa.array(model.languages).take(pa.array(best))
                counted = pa.table([*batch.columns[1:], names], names=["host", "declared", "hint", "language"]).group_by(["host", "declared", "hint", "language"]).aggregate([([], "count_all")])
                yield from counted.select(["host", "declared", "hint", "language", "count_all"]).rename_columns(["host", "declared", "hint", "language", "n"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, "host string, declared string, hint string, language string, n long")


def host_priors(counts: DataFrame, languages: list[str], strength: float) -> DataFrame:
    """host and prior (array of double): each level's counts with its parent's shares as strength more rows.

    Languages are rows until a level's counts are gathered, of which there are as many as languages at most.
    """
    label = F.split("host", r"\.")
    at = F.array_position(F.array(*map(F.lit, languages)), F.col("language")) - 1
    total = {r[0]: float(r[1]) for r in counts.groupBy("language").agg(F.sum("n")).collect()}
    root = [total.get(x, 0.0) for x in languages]
    whole = [(x + 1.0) / (sum(root) + len(root)) for x in root]
    named = counts.filter("host is not null").groupBy("host", at.cast("int").alias("at")).agg(F.sum("n").alias("n"))
    named = named.withColumn("domain", F.array_join(F.slice(label, F.greatest(F.lit(1), F.size(label) - 1), 2), ".")).withColumn("suffix", F.element_at(label, -1))

    def level(name: str, *parent: str) -> DataFrame:
        own = named.groupBy(name, *parent, "at").agg(F.sum("n").cast("double").alias("n"))
        return own.groupBy(name, *parent).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("own"), F.sum("n").alias("rows"))

    def smooth(frame: DataFrame, name: str, prior: Column) -> DataFrame:
        value = lambda p, i: (F.coalesce(F.try_element_at("own", i), F.lit(0.0)) + strength * p) / (F.col("rows") + strength)
        return frame.select(name, F.transform(prior, value).alias(f"p_{name}"))

    suffix = smooth(level("suffix"), "suffix", F.array(*map(F.lit, whole)))
    domain = smooth(level("domain", "suffix").join(suffix, "suffix"), "domain", F.col("p_suffix"))
    return smooth(level("host", "domain").join(domain, "domain"), "host", F.col("p_domain")).withColumnRenamed("p_host", "prior")


def hint_table(counts: DataFrame, column: str, languages: list[str]) -> tuple[list[str], Entries]:
    """log P(hint | language) for each hint that names a language, against no hint at all: the hints, and a row for each and one of zeros.

    Collected are the pairs of hint and language that occur, of languages of the model both.
    """
    known = [x for x in languages if x != "und"]
    at = {x: i for i, x in enumerate(languages)}
    rows = counts.filter(F.col(column).isin(known or [""])).groupBy(column, "language").agg(F.sum("n").alias("n")).collect()
    n = {(h, h): 5.0 for h in known}
    total = np.array([10.0 - 5.0 * (x == "und") for x in languages])
    for hint, language, seen in rows:
        n[hint, language] = n.get((hint, language), 0.0) + seen
        total[at[language]] += seen
    fair = 5.0 / max(1, len(known))
    start = np.log(fair / total)
    hint, language = (np.array([at[pair[k]] for pair in n], np.int64) for k in (0, 1))
    place = np.searchsorted([at[x] for x in known], hint) if known else hint
    return known, entries(start, len(known) + 1, place, language, np.log((np.array([*n.values()]) + fair) / fair), np.float64)


def train(rows: DataFrame, languages: list[str] | None = None, fit_rows: int = FIT_ROWS) -> TextModel:
    """Fit the text model on rows with text and declared columns."""
    counts = rows.filter("declared rlike '^[a-z]{2,3}$' and declared != 'und'").groupBy("declared").count()
    if languages is not None:
        counts = counts.filter(F.col("declared").isin(languages or [""]))
    # at most as many rows as there are codes of two or three letters
    chance = F.broadcast(counts.select("declared", F.least(F.lit(1.0), 1.5 * fit_rows / F.col("count")).alias("chance")))
    part = F.substring(F.col("text").cast("binary"), 1, FIT_BYTES).cast("string")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    prepare(rows.sparkSession)
    return fit(rows.filter("text is not null").join(chance, "declared").filter(place < F.col("chance")).select("declared", part.alias("text")).distinct())


def identify(docs: DataFrame, text: str | Column = "text", declared: str | Column | None = None, url: str | Column | None = None, host: str | Column | None = None, model: TextModel | None = None, temper: float = TEMPER, strength: float = STRENGTH, least: float = LEAST) -> DataFrame:
    """All columns of docs, then language, confidence, text_language (by text alone) and kept."""
    spark = docs.sparkSession
    prepare(spark)
    as_column = lambda c, kind="string": F.lit(None).cast(kind) if c is None else (F.col(c) if isinstance(c, str) else c)
    text, said, url = as_column(text), subtag(as_column(declared)), as_column(url)
    host = as_column(host) if host is not None else host_of(url)
    model = model or train(docs.select(text.alias("text"), said.alias("declared")))
    names = model.languages
    hint = hint_of(url, names)
    at_text, at_said, at_hint, at_host, at_prior, at_salt = fresh(docs, "text_", "declared_", "hint_", "host_", "prior_", "salt_")
    counts = _evidence(docs.select(text.alias("text"), host.alias("host"), said.alias("declared"), hint.alias("hint")), model)
    counts = keep(counts.groupBy("host", "declared", "hint", "language").agg(F.sum("n").alias("n")), "evidence")
    tables = hint_table(counts, "declared", names), hint_table(counts, "hint", names)
    priors = host_priors(counts, names, strength).select(F.col("host").alias(at_host), F.col("prior").alias(at_prior))
    hosts = counts.select("host").distinct().count()
    full = docs.withColumns({at_text: text, at_said: said, at_hint: hint, at_host: host})
    if hosts * len(names) <= BROADCAST:
        full = full.join(F.broadcast(priors), at_host, "left")
    else:
        salted = priors.withColumn(at_salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        full = full.withColumn(at_salt, F.pmod(F.xxhash64(at_text), F.lit(SALTS)).cast("int")).join(salted, [at_host, at_salt], "left")
    full = full.select(*docs.columns, at_text, at_said, at_hint, at_prior)
    evidence = [(pa.array(hints, pa.string()), table) for hints, table in tables]
    n, found = len(docs.columns), fresh(docs, "language", "confidence", "text_language", "kept")
    kinds = [T.StringType(), T.DoubleType(), T.StringType(), T.BooleanType()]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], *[T.StructField(f"d{i}", k) for i, k in enumerate(kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, n, len(names)):
                data, offsets = text_bytes(batch.column(n))
                logs, letters = model.likelihoods(data, offsets)
                first = np.argmax(logs, 1)
                post = temper * logs
                every = np.arange(batch.num_rows)
                for (values, table), j in zip(evidence, (1, 2), strict=True):
                    key = pc.fill_null(pc.index_in(batch.column(n + j), value_set=values), len(values)).to_numpy(zero_copy_only=False)
                    post[key < len(values)] += table.start
                    table.add(post, every, key)
                prior = batch.column(n + 3)
                post[prior.is_valid().to_numpy(zero_copy_only=False)] += np.log(prior.flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(names))
                post = np.exp(post - post.max(1, keepdims=True))
                post /= post.sum(1, keepdims=True)
                best = np.argmax(post, 1)
                best[~letters] = len(names) - 1
                sure = post[np.arange(len(best)), best]
                known = pa.array(names)
                extra = [known.take(pa.array(best)), pa.array(sure), known.take(pa.array(np.where(letters, first, len(names) - 1))), pa.array(letters & (best != len(names) - 1) & (sure >= least))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *extra], names=[f"c{i}" for i in range(n)] + [f"d{i}" for i in range(4)])

    inner = [f"c{i}" for i in range(n)] + [f"e{i}" for i in range(4)]
    return full.toDF(*inner).mapInArrow(run, schema).toDF(*docs.columns, *found)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Documents (declared language: their lang; host: their source) and pages (markup, address, host), each row judged.

    doc_id is null in rows of pages, url in rows of documents.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(None).cast("string").alias("url"), F.col("text"), F.col("lang").alias("said"), F.col("source").alias("host"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit(None).cast("long").alias("doc_id"), "url", visible(F.col("html")).alias("text"), declared(F.col("html")).alias("said"), host_of(F.col("url")).alias("host"))
    found = identify(docs.unionByName(pages), "text", "said", "url", "host")
    return found.select("doc_id", "url", "language", "confidence", "text_language", "kept")
