"""Queries over texts, layout annotations, token sequences and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import layout as L
from vellumspark.functions import text as T
from vellumspark.operators import policy
from vellumspark.operators import sequences as S

from .base import query, read

EOS = T.END
#: Documents dressed as decoded model output: one reference span, two bare ones, an end mark.
TAGGED = f"""SELECT doc_id, '<|ref|>' || CASE WHEN doc_id % 3 = 0 THEN ' image ' ELSE 'title' END || '<|/ref|><|det|>[[' || doc_id % 999 || ', 10, 500, ' || (doc_id * 7) % 999 || ']]<|/det|>' || coalesce(text, '')
    || ' \\coloneqq ' || '<|det|>text [1, 2, 3.7, -4, 9]<|/det|>' || '<|det|>image [' || doc_id % 10 || ', 0, 99, 98.6]<|/det|>  ' || '{EOS}' AS t FROM documents"""


def _tagged(spark, sf):
    d = F.col("doc_id")
    num = lambda c: c.cast("string")
    t = F.concat(
        F.lit("<|ref|>"), F.when(d % 3 == 0, " image ").otherwise("title"), F.lit("<|/ref|><|det|>[["), num(d % 999), F.lit(", 10, 500, "), num(d * 7 % 999), F.lit("]]<|/det|>"), F.coalesce("text", F.lit("")),
        F.lit(" \\coloneqq "), F.lit("<|det|>text [1, 2, 3.7, -4, 9]<|/det|>"), F.lit("<|det|>image ["), num(d % 10), F.lit(", 0, 99, 98.6]<|/det|>  "), F.lit(EOS),
    )
    return read(spark, sf, "documents").select("doc_id", t.alias("t"))


SPANS = f"""WITH d AS ({TAGGED}), s AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)<\\|ref\\|>.*?<\\|/ref\\|><\\|det\\|>.*?<\\|/det\\|>') || regexp_extract_all(t, '<\\|det\\|>[a-z]+ \\[[^\\]]+\\]<\\|/det\\|>') AS f FROM d),
e AS (SELECT doc_id, unnest(f) AS span, generate_subscripts(f, 1) AS k FROM s),
l AS (SELECT *, CASE WHEN span LIKE '<|ref|>%' THEN regexp_extract(span, '(?s)<\\|ref\\|>(.*?)<\\|/ref\\|>', 1) ELSE regexp_extract(span, '<\\|det\\|>([a-z]+)', 1) END AS label,
    regexp_extract(span, '\\[[^<]*') AS box FROM e)"""


def _spans(spark, sf):
    return _tagged(spark, sf).select("doc_id", F.posexplode(L.spans(F.col("t"))).alias("k", "s"))


@query(f"SELECT doc_id, md5(trim(replace(t, '{EOS}', ''))) AS h FROM ({TAGGED})")
def x01_strip_end(spark, sf):
    return _tagged(spark, sf).select("doc_id", F.md5(T.strip_end(F.col("t"))).alias("h"))


@query(f"{SPANS} SELECT doc_id, k::INTEGER AS k, label, length(span)::INTEGER AS n FROM l")
def x02_spans(spark, sf):
    return _spans(spark, sf).select("doc_id", (F.col("k") + 1).alias("k"), "s.label", F.char_length("s.full").alias("n"))


@query(f"{SPANS} SELECT doc_id, k::INTEGER AS k, array_to_string(list_transform(regexp_extract_all(box, '[+-]?[0-9.]+')[1:4], lambda x: trunc(x::DOUBLE)::BIGINT), ',') AS box FROM l")
def x03_boxes(spark, sf):
    each = _spans(spark, sf).select("doc_id", (F.col("k") + 1).alias("k"), F.explode(L.boxes(F.col("s.box_text"))).alias("b"))
    return each.select("doc_id", "k", F.array_join("b", ",").alias("box"))


@query("SELECT doc_id, trunc((doc_id % 1000) / 999.0::DOUBLE * (n_chars % 4000 + 1))::BIGINT AS px FROM documents")
def x04_rescale(spark, sf):
    return read(spark, sf, "documents").select("doc_id", L.rescaled(F.col("doc_id") % 1000, F.col("n_chars") % 4000 + 1).alias("px"))


@query(f"{SPANS} SELECT doc_id, k::INTEGER AS k, trim(label) = 'image' AS image FROM l")
def p01_is_image(spark, sf):
    return _spans(spark, sf).select("doc_id", (F.col("k") + 1).alias("k"), L.is_image(F.col("s")).alias("image"))


@query(f"{SPANS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS figure, label FROM l WHERE trim(label) = 'image'")
def w16_figures(spark, sf):
    figures = F.filter(L.spans(F.col("t")), L.is_image)
    return _tagged(spark, sf).select("doc_id", F.posexplode(figures).alias("figure", "s")).select("doc_id", "figure", "s.label")


MARKDOWN = "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(replace(t, '%s', '')), '(?s)<\\|ref\\|>title<\\|/ref\\|><\\|det\\|>.*?<\\|/det\\|>', ''), '(?s)<\\|ref\\|> image <\\|/ref\\|><\\|det\\|>.*?<\\|/det\\|>', '![](images/0.jpg)' || chr(10)), '<\\|det\\|>text \\[[^\\]]+\\]<\\|/det\\|>', ''), '<\\|det\\|>image \\[[^\\]]+\\]<\\|/det\\|>', '![](images/' || CASE WHEN doc_id %% 3 = 0 THEN 1 ELSE 0 END || '.jpg)' || chr(10)), '\\coloneqq', ':=')" % EOS


@query(f"SELECT doc_id, md5({MARKDOWN}) AS h FROM ({TAGGED})")
def x07_markdown(spark, sf):
    return _tagged(spark, sf).select("doc_id", F.md5(L.one_page(F.col("t"))).alias("h"))


@query("""WITH p AS (SELECT conv_id, list_sort(list(struct_pack(turn := turn, t := coalesce(text, '')))) AS ts FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('<PAGE>' || chr(10) || array_to_string(list_transform(ts, lambda x: regexp_replace(x.t, '^\\s+|\\s+$', '', 'g')), chr(10) || '<PAGE>' || chr(10))) AS h FROM p""")
def x08_pages(spark, sf):
    """Every turn is a page; what stands before the first page mark goes."""
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("ts"))
    decoded = F.concat(F.lit("lost"), F.aggregate("ts", F.lit(""), lambda a, x: F.concat(a, F.lit(T.PAGE), x["t"])), F.lit(EOS))
    return turns.select("conv_id", F.md5(L.many_pages(decoded, F.lit(100))).alias("h"))


@query("SELECT doc_id, replace(replace(lang || '\\coloneqq' || source || '\\eqqcolon', '\\coloneqq', ':='), '\\eqqcolon', '=:') AS s FROM documents")
def x06_colon_equals(spark, sf):
    s = F.concat("lang", F.lit("\\coloneqq"), "source", F.lit("\\eqqcolon"))
    return read(spark, sf, "documents").select("doc_id", L.markdown(s).alias("s"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\p{N}{1,3}|\\P{N}+'))::INTEGER AS n, md5(array_to_string(regexp_extract_all(text, '\\p{N}{1,3}|\\P{N}+'), '|')) AS h FROM documents WHERE text IS NOT NULL")
def x11_digit_groups(spark, sf):
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.digit_groups(F.col("text")).alias("g"))
    return rows.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("h"))


@query("SELECT doc_id, len(regexp_extract_all(text || '漢字かなx', '[\\x{4E00}-\\x{9FA5}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}]+|[^\\x{4E00}-\\x{9FA5}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}]+'))::INTEGER AS n FROM documents WHERE text IS NOT NULL")
def x12_cjk_runs(spark, sf):
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.cjk_runs(F.concat("text", F.lit("漢字かなx")))).alias("n"))


@query()
def x13_pretokenized(spark, sf):
    """The word stage looks ahead, which DuckDB's expressions can't; tests compare it with
    the regex module."""
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.pretokenized(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\u0000")).alias("h"))


@query()
def x14_byte_level(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.byte_level(F.col("text")).alias("s"))


NORMAL = """trim(regexp_replace(lower(regexp_replace(body, '([A-Za-z])-\\s*\\n\\s*([A-Za-z])', '\\1\\2', 'g')), '\\s+', ' ', 'g'))"""


@query(f"""WITH d AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '12  THE HISTORY OF ROME  [1848]' || chr(10) ELSE '' END || translate(text, '‘’“”–—', '''''""--') || '-' || chr(10) || 'end' || CASE WHEN turn % 3 = 0 THEN chr(10) || ' [ 42 ] ' ELSE '' END AS t FROM conversations WHERE text IS NOT NULL),
b AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN substr(t, strpos(t, chr(10)) + 1) ELSE t END, '\\n \\[ 42 \\] $', '') AS body FROM d)
SELECT conv_id, turn, md5({NORMAL}) AS h FROM b""")
def x22_normalized(spark, sf):
    t = F.concat(F.when(F.col("turn") % 2 == 0, "12  THE HISTORY OF ROME  [1848]\n").otherwise(""), "text", F.lit("-\nend"), F.when(F.col("turn") % 3 == 0, "\n [ 42 ] ").otherwise(""))
    return read(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.md5(T.normalized(t)).alias("h"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL")
def x23_white_space(spark, sf):
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.collapsed(F.col("text"))).alias("h"))


@query("SELECT DISTINCT l_discount AS x, regexp_replace(printf('%.6f', l_discount), '\\.?0+$', '') AS name, replace(regexp_replace(printf('%.4f', l_discount * 100), '\\.?0+$', ''), '.', '') AS pct FROM lineitem")
def x24_metric_names(spark, sf):
    x = F.col("l_discount")
    return read(spark, sf, "lineitem").select(x.alias("x")).distinct().select("x", T.fraction_name(F.col("x")).alias("name"), T.percentile_name(F.col("x")).alias("pct"))


@query("SELECT page_id, lower(hex(encode(substr(url, 1, 8)))) AS start, sha256(html) AS digest, true AS ok FROM pages WHERE html IS NOT NULL")
def x26_digests(spark, sf):
    rows = read(spark, sf, "pages").where("html IS NOT NULL")
    digest = F.sha2("html", 256)
    return rows.select("page_id", F.lower(F.hex(F.left("url", F.lit(8)))).alias("start"), digest.alias("digest"), T.same_digest(F.col("html"), F.concat(F.lit(" "), F.upper(digest))).alias("ok"))


@query("SELECT doc_id, array_to_string([0] || list_transform(range(doc_id % 5), lambda x: 128815) || [7, 8], ',') AS ids, (doc_id % 5)::INTEGER AS images FROM documents")
def x28_prompt_ids(spark, sf):
    d = (F.col("doc_id") % 5).cast("int")
    ids = F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(128815), d), F.array(F.lit(7), F.lit(8)))
    return read(spark, sf, "documents").select("doc_id", F.array_join(ids, ",").alias("ids"), F.size(F.filter(F.transform(ids, lambda i: i == 128815), lambda m: m)).alias("images"))


@query("SELECT conv_id, turn, left(replace(replace(text, '|', '\\|'), chr(10), ' '), 80) AS cell FROM conversations")
def x29_cells(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.left(F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(80)).alias("cell"))


CER = """WITH r AS (SELECT p_partkey AS page, p_name AS ref, CASE WHEN p_partkey % 5 <> 0 THEN p_type || ' ' || p_name END AS hyp FROM part),
e AS (SELECT *, levenshtein(ref, hyp) AS ed FROM r)"""


def _pages(spark, sf):
    """Part names as reference pages, types before names as read ones; a fifth is missing."""
    part = read(spark, sf, "part")
    ref = part.select(F.col("p_partkey").alias("page"), F.col("p_name").alias("ref"))
    hyp = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("page"), F.concat_ws(" ", "p_type", "p_name").alias("hyp"))
    return ref.join(hyp, "page", "left").withColumn("ed", F.levenshtein("ref", "hyp"))


@query(f"{CER} SELECT page, round(ed / greatest(1, length(ref)), 5) AS cer, ref = hyp AS exact FROM e WHERE hyp IS NOT NULL")
def a27_page_error_rate(spark, sf):
    return _pages(spark, sf).where("hyp IS NOT NULL").select("page", F.round(T.error_rate(F.col("ed"), F.char_length("ref")), 5).alias("cer"), (F.col("ref") == F.col("hyp")).alias("exact"))


@query(f"{CER} SELECT count(*) AS pages, count(hyp) AS with_hyp, round(coalesce(sum(ed), 0)::DOUBLE / greatest(1, sum(length(ref))), 5) AS cer, count(*) FILTER (WHERE ref = hyp) AS exact FROM e")
def j11_corpus_error_rate(spark, sf):
    """A page that was not read adds its length but no edits; one division at the end."""
    return _pages(spark, sf).agg(F.count("*").alias("pages"), F.count("hyp").alias("with_hyp"), F.round(F.coalesce(F.sum("ed"), F.lit(0)) / F.greatest(F.sum(F.char_length("ref")), F.lit(1)), 5).alias("cer"), F.count_if(F.col("ref") == F.col("hyp")).alias("exact"))


@query()
def a28_word_error_rate(spark, sf):
    """Edit distance over words is no SQL function; tests compare it with a plain table."""
    rows = _pages(spark, sf).where("hyp IS NOT NULL")
    return rows.select("page", T.word_distance(F.col("ref"), F.col("hyp")).alias("edits"), F.size(T.words(F.col("ref"))).alias("words"))


TOKENS = "SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL"


def _tokens(spark, sf):
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.words(F.col("text")).alias("w"))


@query(f"""WITH t AS ({TOKENS}), s AS (SELECT doc_id, w, len(w) AS n, list_max(list_filter(range(0, len(w) - 1), lambda s: w[s + 1] = w[-1])) AS hit FROM t)
SELECT doc_id, CASE WHEN hit IS NULL OR n <= 1 THEN '' ELSE array_to_string(w[hit + 2 : hit + 5], ' ') END AS draft FROM s""")
def j07_draft(spark, sf):
    return _tokens(spark, sf).select("doc_id", F.array_join(S.draft(F.col("w"), 1, 4), " ").alias("draft"))


@query(f"""WITH t AS ({TOKENS}), s AS (SELECT doc_id, w, len(w) AS n FROM t),
b AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(list_filter(range(greatest(0, n - 90), greatest(0, n - 1)), lambda i: w[i + 1] = w[-1]), lambda i: w[i + 2]), lambda x: x <> 'the'))) AS b FROM s)
SELECT doc_id, array_to_string(coalesce(b, []), ' ') AS bans FROM b""")
def j08_bans(spark, sf):
    return _tokens(spark, sf).select("doc_id", F.array_join(S.bans(F.col("w"), 2, 90, F.array(F.lit("the"))), " ").alias("bans"))


@query(f"""WITH t AS ({TOKENS}), s AS (SELECT doc_id, list_transform(w, lambda x: lower(x)) AS g, w FROM t)
SELECT doc_id, coalesce(list_min(list_filter(range(0, len(w)), lambda i: w[i + 1] <> g[i + 1])), len(w))::INTEGER AS n FROM s""")
def w15_accepted_prefix(spark, sf):
    """Words against their lower case; no end token stands in them."""
    greedy = F.transform("w", F.lower)
    return _tokens(spark, sf).select("doc_id", S.accepted(F.col("w"), greedy, F.lit("")).cast("int").alias("n"))


ATTEND = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, exp(value / 100) AS e FROM events"


@query(f"""WITH s AS ({ATTEND})
SELECT user_id, event_id, round((coalesce(sum(e * value) FILTER (WHERE pos <= 16) OVER h, 0) + coalesce(sum(e * value) FILTER (WHERE pos > 16) OVER t, 0)) / (coalesce(sum(e) FILTER (WHERE pos <= 16) OVER h, 0) + coalesce(sum(e) FILTER (WHERE pos > 16) OVER t, 0)), 7) AS attended
FROM s WINDOW h AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)""")
def w01_ring_attention(spark, sf):
    rows = read(spark, sf, "events").withColumn("s", F.col("value") / 100)
    return S.ring_attention(rows, "user_id", ["ts", "event_id"], "s", "value", prefix=16).select("user_id", "event_id", F.round("attended", 7).alias("attended"))


@query(f"WITH s AS ({ATTEND}) SELECT user_id, event_id, round(sum(e * value) OVER w / sum(e) OVER w, 7) AS attended FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def w05_causal_attention(spark, sf):
    rows = read(spark, sf, "events").withColumn("s", F.col("value") / 100)
    return S.causal_attention(rows, "user_id", ["ts", "event_id"], "s", "value").select("user_id", "event_id", F.round("attended", 7).alias("attended"))


@query("""WITH s AS (SELECT user_id, ts, event_id, event_type = 'click' AS f FROM events),
m AS (SELECT *, coalesce((f <> lag(f) OVER w)::INT, 0) AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, island::BIGINT AS island, any_value(f) AS flag, count(*) AS n FROM i GROUP BY user_id, island""")
def w14_islands(spark, sf):
    return S.islands(read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click")


@query("""SELECT p_brand AS tensor, p_partkey, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS UNBOUNDED PRECEDING) AS distortion FROM part""")
def w08_running_minimum(spark, sf):
    from vellumspark.operators import allocation

    return allocation.monotone(read(spark, sf, "part"), "p_brand", ["p_size", "p_partkey"], "p_retailprice").select(F.col("p_brand").alias("tensor"), "p_partkey", F.col("repaired").alias("distortion"))


@query("SELECT row_number() OVER (ORDER BY chars, doc_id)::INTEGER AS place, doc_id FROM (SELECT doc_id, coalesce(n_chars, 0) AS chars FROM documents)")
def w13_admission_order(spark, sf):
    from vellumspark.operators import scheduling

    rows = read(spark, sf, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("chars"))
    return scheduling.numbered(rows, ["chars", "doc_id"], "place").select("place", "doc_id")


@query("""WITH g AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS k FROM range(1, 33) a(i), range(1, 33) b(j) WHERE i * j BETWEEN 2 AND 32) SELECT i, j, k FROM g""")
def t03_grids(spark, sf):
    return spark.createDataFrame([(i, j, k) for k, (i, j) in enumerate(S.grids(), 1)], "i long, j long, k long")


@query("""WITH g AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS k FROM range(1, 33) a(i), range(1, 33) b(j) WHERE i * j BETWEEN 2 AND 32),
s AS (SELECT p_partkey, 100 + p_size * 37 AS w, 100 + p_partkey % 1900 AS h FROM part),
d AS (SELECT *, abs(w / h - i / j) AS d FROM s, g), m AS (SELECT *, min(d) OVER (PARTITION BY p_partkey) AS low FROM d),
n AS (SELECT *, min(k) OVER (PARTITION BY p_partkey) AS k0 FROM m WHERE d = low)
SELECT p_partkey, arg_max(i, CASE WHEN k = k0 THEN 0 WHEN w * h > 0.5 * 640 * 640 * i * j THEN k ELSE -1 END)::INTEGER AS i, arg_max(j, CASE WHEN k = k0 THEN 0 WHEN w * h > 0.5 * 640 * 640 * i * j THEN k ELSE -1 END)::INTEGER AS j FROM n GROUP BY p_partkey""")
def j06_closest_grid(spark, sf):
    w, h = (100 + F.col("p_size") * 37).cast("double"), (100 + F.col("p_partkey") % 1900).cast("double")
    rows = read(spark, sf, "part").select("p_partkey", S.closest_grid(w, h, 640).alias("g"))
    return rows.select("p_partkey", "g.i", "g.j")


NAMES = """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'model.layers.' || p_size || '.mlp.experts.3.gate_proj.weight' WHEN 1 THEN 'model.layers.' || p_size || '.self_attn.q_proj.weight' WHEN 2 THEN 'lm_head.weight' WHEN 3 THEN 'model.vision_model.blocks.' || p_size || '.mlp.up_proj.weight'
    WHEN 4 THEN 'model.layers.' || p_size || '.mlp.gate.weight' WHEN 5 THEN 'model.layers.' || p_size || '.input_layernorm.weight' WHEN 6 THEN 'model.embed_tokens.weight' WHEN 7 THEN 'model.projector.layers.weight' WHEN 8 THEN 'image_newline' WHEN 9 THEN 'layers.' || p_size || '.mlp.down_proj.weight' ELSE p_name END AS name FROM part"""


def _names(spark, sf):
    k, size = F.col("p_partkey") % 11, F.col("p_size").cast("string")
    layer = lambda tail: F.concat(F.lit("model.layers."), size, F.lit(tail))
    forms = [layer(".mlp.experts.3.gate_proj.weight"), layer(".self_attn.q_proj.weight"), F.lit("lm_head.weight"), F.concat(F.lit("model.vision_model.blocks."), size, F.lit(".mlp.up_proj.weight")), layer(".mlp.gate.weight"), layer(".input_layernorm.weight"), F.lit("model.embed_tokens.weight"), F.lit("model.projector.layers.weight"), F.lit("image_newline"), F.concat(F.lit("layers."), size, F.lit(".mlp.down_proj.weight")), F.col("p_name")]
    return read(spark, sf, "part").select("p_partkey", F.get(F.array(*forms), k.cast("int")).alias("name"))


@query(f"""SELECT p_partkey, CASE WHEN name LIKE 'model.vision_model.%' THEN 'keep-vision' WHEN name LIKE 'model.projector.%' THEN 'keep-projector' WHEN name = 'model.embed_tokens.weight' THEN 'keep-embedding' WHEN name = 'image_newline' THEN 'keep-connector'
    WHEN name LIKE '%.mlp.gate.weight' THEN 'keep-router' WHEN name LIKE '%layernorm%' THEN 'keep-norm' WHEN name LIKE '%.self_attn.%.weight' THEN 'gated-attention' WHEN name = 'lm_head.weight' THEN 'gated-head' WHEN name LIKE '%layers.%.mlp.%_proj.weight' THEN 'int8' ELSE 'keep-unknown' END AS policy FROM ({NAMES})""")
def p02_policy(spark, sf):
    return _names(spark, sf).select("p_partkey", policy.recipe(F.col("name")).alias("policy"))


@query(f"""SELECT name, CASE WHEN name LIKE '%.self_attn.%' OR name LIKE '%layers.%.mlp.%_proj.weight' AND name NOT LIKE '%vision%' THEN 'int8' ELSE 'keep' END AS policy FROM (SELECT DISTINCT name FROM ({NAMES}))""")
def p04_resolved_policies(spark, sf):
    return _names(spark, sf).select("name").distinct().select("name", policy.resolved(policy.recipe(F.col("name")), attention=True).alias("policy"))


@query(f"""SELECT p_partkey, name = 'lm_head.weight' OR (name LIKE 'model.layers.%' AND (name LIKE '%.self_attn.%' OR name LIKE '%_proj.weight')) AS int8 FROM ({NAMES})""")
def p05_converter_policy(spark, sf):
    return _names(spark, sf).select("p_partkey", policy.converter(F.col("name")).alias("int8"))


@query("""SELECT coalesce(a.n, b.n) AS name, CASE WHEN a.n IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT DISTINCT c_custkey AS n FROM customer) a FULL JOIN (SELECT DISTINCT p_partkey * 2 AS n FROM part) b ON a.n = b.n WHERE a.n IS NULL OR b.n IS NULL""")
def j12_census(spark, sf):
    """Customers' keys against twice the parts' keys."""
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    return S.census(a, read(spark, sf, "part").select((F.col("p_partkey") * 2).alias("name")))


@query("SELECT o_orderkey, n_name AS vector FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j01_lookup(spark, sf):
    tokens = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("token"))
    known = read(spark, sf, "customer").select(F.col("c_custkey").alias("token"), F.col("c_nationkey").alias("k"))
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("vector"))
    return S.looked_up(S.looked_up(tokens, known, "token"), names, "k").select("o_orderkey", "vector")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_linenumber) AS j FROM d)
SELECT a.l_orderkey, a.l_linenumber, b.q AS x FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.k = b.j""")
def j04_positional_join(spark, sf):
    """Lines of an order take its quantities from the last to the first."""
    items = read(spark, sf, "lineitem")
    numbered = items.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.count("*").alias("c"))
    slots = numbered.select("l_orderkey", "l_linenumber", F.lit(True).alias("open"), F.lit(None).cast("double").alias("x"))
    features = numbered.select("l_orderkey", (-F.col("l_linenumber")).alias("at"), F.col("q").alias("f"))
    return S.positional(slots, features, "l_orderkey", "l_linenumber", "at").select("l_orderkey", "l_linenumber", "x")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) = 1 AS same, round(max(l_tax) - min(l_tax), 9) AS spread FROM lineitem GROUP BY l_orderkey, l_linenumber")
def j19_spread(spark, sf):
    out = S.spread(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey", "l_tax")
    return out.withColumn("spread", F.round("spread", 9))


@query("SELECT a.doc_id, sha256(a.text) = sha256(b.t) AS same FROM documents a JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' ' ELSE text END AS t FROM documents) b ON a.doc_id = b.doc_id WHERE a.text IS NOT NULL")
def j18_determinism(spark, sf):
    """Two runs of which the second differs in a seventh of the documents."""
    docs = read(spark, sf, "documents").where("text IS NOT NULL")
    again = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    runs = [d.select("doc_id", F.sha2("text", 256).alias(n)) for d, n in ((docs, "a"), (again, "b"))]
    return runs[0].join(runs[1], "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))
