"""Scalar functions: strings, patterns, dates, numbers, arrays, maps, JSON, variants and vectors."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


@R.query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, trim('  ' || c_name || ' ') AS bare, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, rpad(c_mktsegment, 12, '.') AS filled, concat_ws('/', c_name, c_mktsegment) AS both, initcap_ AS cap FROM (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS initcap_ FROM customer)")
def string_shape(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"), F.trim(F.concat(F.lit("  "), c("c_name"), F.lit(" "))).alias("bare"), F.lpad(c("c_custkey").cast("string"), 8, "0").alias("padded"), F.rpad("c_mktsegment", 12, ".").alias("filled"), F.concat_ws("/", "c_name", "c_mktsegment").alias("both"), F.initcap("c_mktsegment").alias("cap"))


@R.query("SELECT p_partkey, substring(p_name, 2, 3) AS part, CAST(strpos(p_name, 'a') AS BIGINT) AS place, replace(p_name, 'a', '__') AS swapped, translate(p_name, 'aeiou', '12345') AS coded, split_part(p_type, ' ', 1) AS first, reverse(p_brand) AS back, CAST(length(p_name) AS BIGINT) AS size, left(p_name, 2) AS head, right(p_name, 2) AS tail FROM part")
def string_parts(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(n, 2, 3).alias("part"), F.instr(n, "a").cast("long").alias("place"), F.replace(n, F.lit("a"), F.lit("__")).alias("swapped"), F.translate(n, "aeiou", "12345").alias("coded"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first"), F.reverse("p_brand").alias("back"), F.length(n).cast("long").alias("size"), F.left(n, F.lit(2)).alias("head"), F.right(n, F.lit(2)).alias("tail"))


@R.query(r"SELECT doc_id, regexp_extract(text, '([A-Za-z]+)[.,]', 1) AS word, md5(regexp_replace(text, '[aeiou]', '*', 'g')) AS masked, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers FROM documents")
def regex(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(t, "([A-Za-z]+)[.,]", 1).alias("word"), F.md5(F.regexp_replace(t, "[aeiou]", "*").cast("binary")).alias("masked"), F.regexp_count(t, F.lit("[0-9]+")).cast("long").alias("numbers"))


@R.query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance, md5(p_name) AS md5, sha256(p_name) AS sha FROM part")
def similarity_and_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.md5(F.col("p_name").cast("binary")).alias("md5"), F.sha2("p_name", 256).alias("sha"))


@R.query()
def engine_hashes(spark, sf_dir):
    """Hashes and codes that are Spark's own."""
    return table(spark, sf_dir, "part").select("p_partkey", F.soundex("p_name").alias("sound"), F.xxhash64("p_name").alias("xx"), F.hash("p_name").alias("murmur"), F.crc32(F.col("p_name").cast("binary")).alias("crc"))


@R.query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, week(o_orderdate) AS w, dayofyear(o_orderdate) AS n, dayofweek(o_orderdate) + 1 AS k, date_trunc('month', o_orderdate)::TIMESTAMP AS opening FROM orders")
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    parts = {"y": F.year(d), "m": F.month(d), "d": F.dayofmonth(d), "q": F.quarter(d), "w": F.weekofyear(d), "n": F.dayofyear(d), "k": F.dayofweek(d)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("long").alias(k) for k, c in parts.items()], F.date_trunc("month", d).cast("timestamp_ntz").alias("opening"))


@R.query("SELECT o_orderkey, strftime(o_orderdate::DATE + 10, '%Y-%m-%d') AS later, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_on, strftime(last_day(o_orderdate), '%d.%m.%Y') AS ends FROM orders")
def date_arithmetic(spark, sf_dir):
    d = F.to_date("o_orderdate")
    text = lambda c, f="yyyy-MM-dd": F.date_format(c, f)
    return table(spark, sf_dir, "orders").select("o_orderkey", text(F.date_add(d, 10)).alias("later"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), text(F.add_months(d, 1)).alias("month_on"), text(F.last_day(d), "dd.MM.yyyy").alias("ends"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up, abs(l_discount - 0.05) AS gap, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_extendedprice), 9) AS logarithm, round(exp(l_tax), 9) AS grown, round(pow(l_quantity, 2), 3) AS square, sign(l_discount - 0.05)::DOUBLE AS side, CAST(l_quantity % 7 AS DOUBLE) AS rest FROM lineitem")
def numbers(spark, sf_dir):
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(p).alias("down"), F.ceil(p).alias("up"), F.abs(d - 0.05).alias("gap"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.ln(p), 9).alias("logarithm"), F.round(F.exp("l_tax"), 9).alias("grown"), F.round(F.pow("l_quantity", F.lit(2)), 3).alias("square"), F.signum(d - 0.05).alias("side"), (F.col("l_quantity") % 7).alias("rest"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, round(sin(l_tax), 9) AS s, round(atan2(l_tax, l_discount + 1), 9) AS a, round(degrees(l_tax), 9) AS deg, CAST(CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5) + 1 END AS BIGINT) AS bucket FROM lineitem")
def trigonometry_and_buckets(spark, sf_dir):
    tax = F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sin(tax), 9).alias("s"), F.round(F.atan2(tax, F.col("l_discount") + 1), 9).alias("a"), F.round(F.degrees(tax), 9).alias("deg"), F.width_bucket(F.col("l_quantity"), F.lit(0.0), F.lit(50.0), F.lit(10)).alias("bucket"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio, try_cast(l_returnflag AS INTEGER) AS number, TRY_CAST(l_linestatus || '1' AS DOUBLE) AS real FROM lineitem")
def safe_variants(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.try_divide("l_tax", "l_discount").alias("ratio"), F.col("l_returnflag").try_cast("int").alias("number"), F.concat("l_linestatus", F.lit("1")).try_cast("double").alias("real"))


@R.query("""
    WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS kinds FROM events GROUP BY user_id)
    SELECT user_id, list_contains(kinds, 'purchase') AS buys, array_to_string(list_sort(list_distinct(kinds)), ',') AS distinct_kinds,
           CAST(len(kinds) AS BIGINT) AS n, array_to_string(kinds[2:4], ',') AS part, kinds[1] AS first FROM a""")
def array_basics(spark, sf_dir):
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"])
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("kinds"))
    return a.select("user_id", F.array_contains("kinds", "purchase").alias("buys"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("distinct_kinds"), F.size("kinds").cast("long").alias("n"), F.array_join(F.slice("kinds", 2, 3), ",").alias("part"), F.element_at("kinds", 1).alias("first"))


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def safe_sum(a: Column, b: Column) -> Column:
    """a + b of longs; null if it overflows. Told beforehand: try_add raises and catches an error for each such row."""
    fits = F.when(b < 0, a >= F.lit(_LEAST) - b).otherwise(a <= F.lit(_MOST) - b)
    return F.when(fits, a + b)


def safe_product(a: Column, b: Column) -> Column:
    """a * b of longs; null if it overflows, told beforehand."""
    part = lambda x: F.call_function("div", F.lit(x), b)
    fits = F.when(b > 0, a.between(part(_LEAST), part(_MOST))).when(b < -1, a.between(part(_MOST), part(_LEAST))).when(b == -1, a > _LEAST).otherwise(b == 0)
    return F.when(fits, a * b)


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey > 107 THEN NULL ELSE 9223372036854775700 + l_partkey END AS total, CASE WHEN l_linenumber > 2 THEN NULL ELSE 4000000000000000000 * l_linenumber END AS product FROM lineitem")
def safe_arithmetic(spark, sf_dir):
    """Sums and products that overflow are null."""
    key, line = F.col("l_partkey").cast("long"), F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", safe_sum(F.lit(9223372036854775700), key).alias("total"), safe_product(F.lit(4000000000000000000), line).alias("product"))


@R.query("SELECT user_id, array_to_string(flatten(list([event_type, props] ORDER BY event_id)), '|') AS flat FROM events GROUP BY user_id")
def array_flatten(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.array("event_type", "props").alias("a"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r")).select("user_id", F.array_join(F.flatten(F.transform("r", lambda s: s["a"])), "|").alias("flat"))


@R.query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, CAST(len(list_filter(v, lambda x: x > 0)) AS BIGINT) AS positive, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square,
           len(list_filter(v, lambda x: x > 0.3)) > 0 AS some_large, len(list_filter(v, lambda x: abs(x) <= 1)) = len(v) AS all_small FROM e""")
def array_higher_order(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.round(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("square"), F.exists(v, lambda x: x > 0.3).alias("some_large"), F.forall(v, lambda x: F.abs(x) <= 1).alias("all_small"))


@R.query("SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def explode_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@R.query("SELECT doc_id, unnest(CASE WHEN len(n) = 0 THEN [NULL] ELSE n END) AS number FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS n FROM documents)")
def explode_outer_numbers(spark, sf_dir):
    """A row for each number in a text, and one with null where it has none."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("number"))


@R.query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, string_agg(n, ',' ORDER BY event_type) AS counts,
           coalesce(string_agg(event_type || '=' || n, ',' ORDER BY event_type) FILTER (n > 5), '') AS many,
           string_agg(upper(event_type) || '=' || n, ',' ORDER BY event_type) AS upper, string_agg(event_type || '=' || n * 2, ',' ORDER BY event_type) AS double
    FROM c GROUP BY user_id""")
def maps(spark, sf_dir):
    """Counts of a user's events by type as a map, and functions on it."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    written = lambda x: F.array_join(F.transform(F.map_entries(x), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select(
        "user_id",
        F.array_join(F.map_keys("m"), ",").alias("kinds"),
        F.array_join(F.map_values("m").cast("array<string>"), ",").alias("counts"),
        written(F.map_filter("m", lambda k, v: v > 5)).alias("many"),
        written(F.transform_keys("m", lambda k, v: F.upper(k))).alias("upper"),
        written(F.transform_values("m", lambda k, v: v * 2)).alias("double"),
    )


@R.query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, coalesce(max(n) FILTER (event_type = 'click'), 0) AS clicks, count(*) FILTER (event_type = 'error') > 0 AS has_errors,
           string_agg(event_type, ',' ORDER BY event_type) FILTER (n * most > 100) AS heavy
    FROM c GROUP BY user_id""")
def maps_of_arrays(spark, sf_dir):
    """Maps built from two parallel arrays, looked up by key and zipped with one another."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    rows = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n", "most"))).alias("a"))
    both = rows.select("user_id", F.map_from_arrays("a.event_type", "a.n").alias("n"), F.map_from_arrays("a.event_type", "a.most").alias("most"))
    heavy = F.map_keys(F.map_filter(F.map_zip_with("n", "most", lambda k, n, most: n * most), lambda k, v: v > 100))
    written = F.array_join(F.transform(F.map_entries("n"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return both.select("user_id", written.alias("counts"), F.coalesce(F.try_element_at("n", F.lit("click")), F.lit(0).cast("long")).alias("clicks"), F.map_contains_key("n", "error").alias("has_errors"), F.when(F.size(heavy) > 0, F.array_join(heavy, ",")).alias("heavy"))


@R.query("""
    SELECT p_partkey, CAST(strpos(p_name, 'a') AS INTEGER) AS first, CAST(CASE WHEN strpos(substr(p_name, 4), 'a') = 0 THEN 0 ELSE strpos(substr(p_name, 4), 'a') + 3 END AS INTEGER) AS later,
           CAST(strpos(p_type, ' ') AS INTEGER) AS blank, p_name LIKE 'b%' AS starts, p_type LIKE '%L' AS ends, contains(p_name, 'e') AS within
    FROM part""")
def string_places(spark, sf_dir):
    """Where a string is found in another, from any place on."""
    return table(spark, sf_dir, "part").select("p_partkey", F.locate("a", "p_name").alias("first"), F.locate("a", "p_name", 4).alias("later"), F.position(F.lit(" "), "p_type").alias("blank"), F.startswith("p_name", F.lit("b")).alias("starts"), F.endswith("p_type", F.lit("L")).alias("ends"), F.contains("p_name", F.lit("e")).alias("within"))


@R.query(r"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
           nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page
    FROM pages""")
def url_parts(spark, sf_dir):
    """The parts of every page's address; null where it has none."""
    part = lambda name, *key: F.try_parse_url("url", F.lit(name), *map(F.lit, key))
    return table(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("ref"), part("QUERY", "page").alias("page"))


@R.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS next FROM events")
def json_paths(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (k + 1).alias("next"))


@R.query("SELECT event_id, '{\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def json_write(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("doc"))


@R.query("SELECT 'STRUCT<k: BIGINT>' AS shape, event_type, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least, count(*) AS n FROM events GROUP BY event_type")
def json_schema(spark, sf_dir):
    """The type that all the events' properties have together, found by a pass over them, and the values read by it."""
    events = table(spark, sf_dir, "events").select("event_type", "props")
    shape = events.agg(F.schema_of_variant_agg(F.try_parse_json("props")).alias("s")).first()["s"].replace("OBJECT", "STRUCT")
    read = events.withColumn("p", F.from_json("props", shape))
    return read.groupBy("event_type").agg(F.lit(shape).alias("shape"), F.min("p.k").alias("least"), F.count("*").alias("n")).select("shape", "event_type", "least", "n")


@R.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'OBJECT<k: BIGINT>' AS shape FROM events")
def variants(spark, sf_dir):
    """Properties as a variant, read by path with a type."""
    v = F.parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(v, "$.k", "long").alias("k"), F.schema_of_variant(v).alias("shape"))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of double, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@R.query("""
    WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (
      SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], centre) / sqrt(list_dot_product(centre, centre)), 6) AS nearness FROM embeddings JOIN c USING (label)""")
def vector_nearness(spark, sf_dir):
    """Cosine of every vector (of unit length) to its label's mean; one row per label and dimension is shuffled after the partial sums."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    part = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = part.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(centre, "label").select("vec_id", F.round(dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("c"), F.col("c"))), 6).alias("nearness"))


@R.query("""
    WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (
      SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
    n AS (SELECT label, vec_id, round(list_dot_product(embedding::DOUBLE[], centre) / sqrt(list_dot_product(centre, centre)), 6) AS nearness FROM embeddings JOIN c USING (label))
    SELECT label, vec_id, nearness, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY nearness DESC, vec_id) AS r FROM n) WHERE r <= 3""")
def vector_nearest_k(spark, sf_dir):
    """The three vectors nearest to each label's mean; a partial limit for each label runs before the shuffle."""
    near = vector_nearness(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    order = Window.partitionBy("label").orderBy(F.desc("nearness"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("label", "vec_id", "nearness", "rank")


@R.query("SELECT conv_id, string_agg('<' || role || '> ' || text, chr(10) ORDER BY turn) AS whole, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_assembly(spark, sf_dir):
    turn = F.concat(F.lit("<"), "role", F.lit("> "), "text")
    rows = F.array_sort(F.collect_list(F.struct("turn", turn.alias("t"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda s: s["t"]), "\n").alias("whole"), F.count("*").alias("turns"))


@R.query("SELECT source, lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def label_rates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
