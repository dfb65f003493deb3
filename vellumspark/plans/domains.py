"""Queries of argument domains, settings, eligibility, tolerances and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import domains as D
from vellumspark.operators import grid, scaling, scheduling
from vellumspark.operators import sequences as S

from .base import query, read


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x <= 0 THEN 'must be > 0' WHEN x > 4294967295 THEN 'too large' END AS a, CASE WHEN x < 0 THEN 'must be >= 0' WHEN x > 4294967295 THEN 'too large' END AS b, CASE WHEN y < 0 THEN 'must be finite and >= 0' END AS c
FROM (SELECT *, (l_linenumber - 3) * l_partkey * 5000000 AS x, l_discount - 0.05 AS y FROM lineitem)""")
def p08_argument_domains(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("x", (F.col("l_linenumber") - 3) * F.col("l_partkey") * 5000000).withColumn("y", F.col("l_discount") - 0.05)
    return rows.select("l_orderkey", "l_linenumber", D.positive(F.col("x")).alias("a"), D.non_negative(F.col("x")).alias("b"), D.finite(F.col("y")).alias("c"))


@query("""SELECT p_partkey, list_filter([CASE WHEN a > 0 AND a <= 1 THEN '' ELSE 'alpha' END, CASE WHEN p > 0 AND p < 1 THEN '' ELSE 'p0' END, CASE WHEN s >= 0 AND s * (1 - p) < 1 THEN '' ELSE 'lambda' END, CASE WHEN c >= 1 THEN '' ELSE 'cadence' END], lambda x: x <> '') AS bad,
CASE WHEN s < 0 THEN 'Infinity' ELSE 'kept' END AS margin FROM (SELECT p_partkey, p_partkey % 12 / 10.0::DOUBLE AS a, p_partkey % 11 / 10.0::DOUBLE AS p, (p_partkey % 9 - 2)::DOUBLE AS s, p_partkey % 5 AS c FROM part)""")
def f15_calibration_domain(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select("p_partkey", (k % 12 / 10.0).alias("a"), (k % 11 / 10.0).alias("p"), (k % 9 - 2).cast("double").alias("s"), (k % 5).alias("c"))
    margin = D.margin(F.col("s"))
    return rows.select("p_partkey", D.calibration(F.col("a"), F.col("p"), F.col("s"), F.col("c")).alias("bad"), F.when(margin == float("inf"), "Infinity").otherwise("kept").alias("margin"))


SETTING = "CASE WHEN regexp_full_match({0}, '\\+?[0-9]+') AND ltrim({0}, '+')::BIGINT > 0 THEN ltrim({0}, '+')::BIGINT END"


@query(f"""SELECT o_orderkey, coalesce({SETTING.format("flag")}, {SETTING.format("env")}, 30000) AS ms FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey::VARCHAR WHEN o_custkey % 3 = 1 THEN '-5' END AS flag, CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '+70' WHEN 2 THEN '7 s' END AS env FROM orders)""")
def p20_settings(spark, sf):
    k = F.col("o_orderkey") % 4
    rows = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")).when(F.col("o_custkey") % 3 == 1, "-5").alias("flag"), F.when(k == 0, "0").when(k == 1, "+70").when(k == 2, "7 s").alias("env"))
    return rows.select("o_orderkey", D.setting(F.col("flag"), F.col("env"), F.lit(30000).cast("long")).alias("ms"))


@query("""WITH r AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 8::DOUBLE END AS cv, p_partkey % 4 AS n, p_size % 7 AS best, p_partkey % 2 AS threads, CASE WHEN p_partkey % 3 = 0 THEN 'x' END AS allocator FROM part),
j AS (SELECT a.p_partkey, a.cv AS acv, a.n AS an, a.best AS abest, a.threads AS ta, a.allocator AS aa, b.cv AS bcv, b.n AS bn, b.best AS bbest, b.threads AS bt, b.allocator AS ba FROM r a JOIN r b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, list_filter([CASE WHEN acv IS NULL AND an < 2 THEN 'ours: single sample' ELSE '' END, CASE WHEN acv > 5 THEN 'ours: noise' ELSE '' END, CASE WHEN abest = 0 THEN 'ours: no best' ELSE '' END,
CASE WHEN bcv IS NULL AND bn < 2 THEN 'theirs: single sample' ELSE '' END, CASE WHEN bcv > 5 THEN 'theirs: noise' ELSE '' END, CASE WHEN bbest = 0 THEN 'theirs: no best' ELSE '' END,
CASE WHEN ta IS DISTINCT FROM bt THEN 'threads' ELSE '' END, CASE WHEN aa IS DISTINCT FROM ba THEN 'allocator' ELSE '' END], lambda x: x <> '') AS bad FROM j""")
def p22_eligible_pairs(spark, sf):
    """Every part's measurement against the next one's."""
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(k, F.struct(F.when(k % 5 > 0, (k % 8).cast("double")).alias("cv_pct"), (k % 4).alias("n"), (F.col("p_size") % 7).alias("best_ms"), (k % 2).alias("threads"), F.when(k % 3 == 0, "x").alias("allocator")).alias("ours"))
    pairs = rows.join(rows.select((k - 1).alias("p_partkey"), F.col("ours").alias("theirs")), "p_partkey")
    return pairs.select("p_partkey", D.eligible(pairs).alias("bad"))


@query("SELECT round(max(s) * 1.5, 8) AS tolerance, min(f) AS first_divergence FROM (SELECT l_orderkey, max(l_tax) - min(l_tax) AS s, min(CASE WHEN l_discount > 0.05 THEN l_linenumber END) AS f FROM lineitem GROUP BY l_orderkey)")
def a37_tolerance(spark, sf):
    spreads = read(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.max("l_tax") - F.min("l_tax")).alias("spread"), F.min(F.when(F.col("l_discount") > 0.05, F.col("l_linenumber"))).alias("first"))
    return D.tolerance(spreads, 1.5)


@query("SELECT l_returnflag, count(*) AS cases, count(*) FILTER (WHERE l_tax <> CASE WHEN l_returnflag < 'O' THEN l_tax ELSE l_discount END) AS mismatches, count(*) FILTER (WHERE l_tax <> CASE WHEN l_returnflag < 'O' THEN l_tax ELSE l_discount END) = 0 AS passed FROM lineitem GROUP BY l_returnflag")
def a40_battery(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("other", F.when(F.col("l_returnflag") < "O", F.col("l_tax")).otherwise(F.col("l_discount")))
    return D.battery(rows, "l_returnflag", "l_tax", "other")


@query("SELECT o_orderkey, coalesce(n_nationkey + 100, s_suppkey) AS id FROM orders LEFT JOIN nation ON n_nationkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey")
def j03_token_ids(spark, sf):
    tokens = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("token"))
    added = read(spark, sf, "nation").select(F.col("n_nationkey").alias("token"), (F.col("n_nationkey") + 100).alias("id"))
    vocab = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("token"), F.col("s_suppkey").alias("id"))
    return D.token_id(tokens, added, vocab).select("o_orderkey", "id")


@query("SELECT p_brand, string_agg(p_type, '|' ORDER BY p_size, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 + list_sum(list_transform(string_split(p_type, ''), lambda c: ascii(c))) END, p_type) AS options FROM part GROUP BY p_brand")
def t06_points(spark, sf):
    grouped = read(spark, sf, "part").groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_size").alias("bytes"), F.col("p_type").alias("option"))).alias("options"))
    return grouped.select("p_brand", F.array_join(D.points(F.col("options"), ["ECONOMY", "PROMO"]), "|").alias("options"))


@query("SELECT p_partkey, CASE WHEN b < 128 THEN 1 WHEN b >> 5 = 6 THEN 2 WHEN b >> 4 = 14 THEN 3 WHEN b >> 3 = 30 THEN 4 ELSE 1 END AS width FROM (SELECT p_partkey, (p_partkey % 256)::INTEGER AS b FROM part)")
def x21_lead_bytes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", D.char_bytes((F.col("p_partkey") % 256).cast("int")).alias("width"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN strlen(t) <= 512 THEN t ELSE list_max(list_filter(list_transform(range(120, 513), lambda n: t[1:n]), lambda s: strlen(s) <= 512)) || '...' END) AS h FROM t""")
def x30_compact(spark, sf):
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(D.compact(F.col("text"))).alias("h"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, -1, 0 FROM lineitem")
def t14_sentinel_rows(spark, sf):
    return D.with_first(read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 0)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 128 WHEN p_partkey % 5 = 1 THEN CASE WHEN p_size * 9 > 256 THEN 256 WHEN p_size = 0 THEN 128 ELSE p_size * 9 END ELSE 128 END::BIGINT AS size FROM part")
def t05_batch_sizes(spark, sf):
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, "0").when(k == 1, F.concat(F.lit(" "), (F.col("p_size") * 9).cast("string"))).when(k == 2, " ").when(k == 3, "-7")
    return read(spark, sf, "part").select("p_partkey", scheduling.batch_sizes(said).cast("long").alias("size"))


@query("SELECT p_partkey, ceil((p_partkey // 16) / 4.0)::BIGINT AS queries FROM part")
def f07_queries(spark, sf):
    return read(spark, sf, "part").select("p_partkey", grid.queries_of(F.col("p_partkey")).cast("long").alias("queries"))


@query("SELECT doc_id, lower(hex(unhex(sha256(text)))) AS h, strlen(text)::INTEGER AS n FROM documents")
def x25_lower_hex(spark, sf):
    return read(spark, sf, "documents").select("doc_id", D.hex_digest(F.col("text")).alias("h"), F.octet_length("text").alias("n"))


@query("SELECT page_id, sha256(html) AS h, sha256(html) = CASE WHEN page_id % 4 = 0 THEN sha256(html || ' ') ELSE sha256(html) END AS same FROM pages")
def a42_blob_digests(spark, sf):
    """Digests of pages against a list that is wrong for a fourth of them."""
    pages = read(spark, sf, "pages")
    said = F.when(F.col("page_id") % 4 == 0, D.hex_digest(F.concat("html", F.lit(" ")))).otherwise(D.hex_digest(F.col("html")))
    return pages.select("page_id", D.hex_digest(F.col("html")).alias("h"), (D.hex_digest(F.col("html")) == said).alias("same"))


@query("SELECT p_partkey, [7, 8] || list_transform(range(p_size), lambda x: 99) || [9] AS ids FROM part")
def x27_prompts(spark, sf):
    return read(spark, sf, "part").select("p_partkey", D.prompt([7, 8], 99, F.col("p_size"), [9]).alias("ids"))


@query("""WITH r AS (SELECT p_partkey, p_partkey % 11 / 10.0::DOUBLE AS a, p_partkey % 7 / 2000.0::DOUBLE AS b FROM part), p AS (SELECT *, least(64, CASE WHEN b <= 0 THEN 1e300 WHEN a >= 1 THEN 1 ELSE sqrt((1 - a) / b) END) AS peak FROM r),
c AS (SELECT p_partkey, a, b, unnest([greatest(1, floor(peak)), greatest(1, least(64, ceil(peak)))]) AS n FROM p)
SELECT p_partkey, arg_min(n, -round(n / (1 + a * (n - 1) + b * n * (n - 1)), 12) + n * 1e-14)::INTEGER AS n FROM c GROUP BY p_partkey""")
def a17_integer_peaks(spark, sf):
    k = F.col("p_partkey")
    a, b = k % 11 / 10.0, k % 7 / 2000.0
    return read(spark, sf, "part").select("p_partkey", scaling.integer_peak(a, b, scaling.peak(a, b), 64).cast("int").alias("n"))


@query("SELECT doc_id, CASE WHEN strlen(text) >= 3 AND position('e' IN b) > 0 THEN position('e' IN b) + 2 END::INTEGER AS at FROM (SELECT doc_id, text, substr(regexp_replace(text, '[^\\x00-\\x7F]', '??', 'g'), 4) AS b FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\x{0800}-\\x{10FFFF}]'))")
def x09_byte_search(spark, sf):
    """The first e from the fourth byte on, of texts whose characters have two bytes at most."""
    rows = read(spark, sf, "documents").where("text IS NOT NULL").where(~F.col("text").rlike("[\\x{0800}-\\x{10FFFF}]"))
    return rows.select("doc_id", D.found_from(F.col("text"), "e", F.lit(3)).alias("at"))


@query("""SELECT doc_id, regexp_matches(c, '^[A-Za-z_]$') AS ident_start, regexp_matches(c, '^\\p{L}$') AS letter, regexp_matches(c, '^\\p{N}$') AS number, regexp_matches(c, '^\\p{P}$') AS punctuation, regexp_matches(c, '^\\p{S}$') AS symbol
FROM (SELECT doc_id, substr(text, doc_id % 97 + 1, 1) AS c FROM documents) WHERE c <> '' AND c <> chr(10)""")
def x15_classes(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.substr("text", (F.col("doc_id") % 97 + 1).cast("int"), F.lit(1)).alias("c")).where("c <> '' AND c <> '\n'")
    return rows.select("doc_id", *[D.is_class(F.col("c"), n).alias(n) for n in ("ident_start", "letter", "number", "punctuation", "symbol")])


@query("""WITH o AS (SELECT DISTINCT p_brand AS name, CASE p_size % 4 WHEN 0 THEN 'int4' WHEN 1 THEN 'int8' WHEN 2 THEN 'bf16' ELSE 'f32' END AS option FROM part),
r AS (SELECT *, CASE WHEN name LIKE '%1' THEN 'bf16' END AS pin, CASE WHEN name LIKE '%2' OR name LIKE '%1' THEN 'int8' END AS floor, CASE option WHEN 'int4' THEN 4 WHEN 'int8' THEN 8 WHEN 'bf16' THEN 16 ELSE 32 END AS bits FROM o)
SELECT name, option FROM r WHERE CASE WHEN pin IS NOT NULL THEN option = pin WHEN floor IS NOT NULL THEN bits >= 8 ELSE true END""")
def t07_allowed_options(spark, sf):
    k = F.col("p_size") % 4
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("name"), F.when(k == 0, "int4").when(k == 1, "int8").when(k == 2, "bf16").otherwise("f32").alias("option"))
    names = rows.select("name").distinct()
    pins = names.where("name LIKE '%1'").select("name", F.lit("bf16").alias("pin"))
    floors = names.where("name LIKE '%2' OR name LIKE '%1'").select("name", F.lit("int8").alias("floor"))
    return D.allowed(rows, pins, floors, {"int4": 4, "int8": 8, "bf16": 16, "f32": 32})


@query("SELECT o_orderkey, n_nationkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
def j02_symbol_ids(spark, sf):
    """Names of nations to ids; a name that the vocabulary lacks is an error."""
    nation = read(spark, sf, "nation")
    said = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_name").alias("symbol"))
    return S.looked_up(said, nation.select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("id")), "symbol").select("o_orderkey", "id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
def j09_input_order(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return scheduling.in_order(rows.repartition("o_totalprice"), "o_orderkey")
