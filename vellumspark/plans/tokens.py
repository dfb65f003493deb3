"""Queries of tokenizers and of grids of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import bpe, tokenizer
from vellumspark.operators import grid

from .base import query, read


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _turns(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "text")


@query()
def x19_byte_pairs(spark, sf):
    """Merging is iterative; tests compare the ids with the public library's."""
    ids = bpe.encode(_turns(spark, sf), _ranks(), ["conv_id", "turn"])
    return ids.select("conv_id", "turn", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",")).alias("h"))


@query("SELECT conv_id, turn, md5(text) AS h FROM conversations")
def x20_round_trip(spark, sf):
    back = bpe.decode(bpe.encode(_turns(spark, sf), _ranks(), ["conv_id", "turn"]), _ranks(), ["conv_id", "turn"])
    return back.select("conv_id", "turn", F.md5("text").alias("h"))


ADDED = {"<|stop|>": 60000, "<|stop|>!": 60001}


@query("""SELECT conv_id, turn, md5('<|stop|>!' || coalesce(text, '') || '<|stop|>') AS h, 1 + (len(coalesce(text, '')) - len(replace(coalesce(text, ''), '<|stop|>', ''))) // 8 AS stops, 1 AS longer FROM conversations""")
def x17_added_tokens(spark, sf):
    """Added tokens around every turn; the longer of two that fit is taken."""
    key = ["conv_id", "turn"]
    texts = _turns(spark, sf).withColumn("text", F.concat(F.lit("<|stop|>!"), F.coalesce("text", F.lit("")), F.lit("<|stop|>")))
    ids = bpe.encode(texts, _ranks(), key, added=ADDED)
    count = lambda token: F.size(F.filter("ids", lambda i: i == ADDED[token]))
    counted = ids.select(*key, count("<|stop|>").alias("stops"), count("<|stop|>!").alias("longer"), "ids")
    back = bpe.decode(counted, _ranks(), [*key, "stops", "longer"], strict=True, added=ADDED)
    return back.select(*key, F.md5("text").alias("h"), "stops", "longer")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Two tokens beside the file's own: a special one and one that stays in decoded text.
MORE = (("<|begin|>", 60000, True), ("<|box|>", 60001, False))


@query()
def x10_pieces(spark, sf):
    """All four stages; the word stage looks ahead, so tests compare with the regex module."""
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.transform(tokenizer.cut(F.col("text"), {}), lambda p: p["piece"]).alias("pieces"))
    return rows.select("doc_id", F.size("pieces").alias("n"), F.md5(F.array_join("pieces", " ")).alias("h"))


@query()
def x16_token_ids(spark, sf):
    """Merging is iterative; tests compare the ids with the public library's."""
    ids = tokenizer.encode(read(spark, sf, "documents"), _tokenizer(), ["doc_id"])
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",")).alias("h"))


@query("SELECT doc_id, md5('<|begin|>' || text || '<|box|>' || text || '<|endoftext|>') AS h FROM documents WHERE text IS NOT NULL")
def x18_decoded(spark, sf):
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("<|begin|>"), "text", F.lit("<|box|>"), "text", F.lit("<|endoftext|>")).alias("text"))
    ids = tokenizer.encode(rows, _tokenizer(), ["doc_id"], more=MORE)
    return tokenizer.decode(ids, _tokenizer(), ["doc_id"], more=MORE).select("doc_id", F.md5("text").alias("h"))


@query("SELECT doc_id, md5(text || '<|box|>' || text) AS h, 60000 AS first, 50256 AS last FROM documents WHERE text IS NOT NULL")
def u02_skip_special(spark, sf):
    """Special tokens don't come back; their ids are those that the file and caller name."""
    own = tokenizer.vocabulary(_tokenizer(), MORE)
    bos, eos = own.token_to_id("<|begin|>"), own.token_to_id("<|endoftext|>")
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit("<|box|>"), "text").alias("text"))
    ids = tokenizer.encode(rows, _tokenizer(), ["doc_id"], more=MORE)
    framed = ids.select("doc_id", F.concat(F.array(F.lit(bos)), "ids", F.array(F.lit(eos))).alias("ids"))
    ended = framed.select("doc_id", F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"), "ids")
    back = tokenizer.decode(ended, _tokenizer(), ["doc_id", "first", "last"], skip_special=True, more=MORE)
    return back.select("doc_id", F.md5("text").alias("h"), "first", "last")


GRID = "SELECT vec_id // 256 AS image, (vec_id % 256 // 16)::INTEGER AS y, (vec_id % 16)::INTEGER AS x, embedding[1]::DOUBLE AS v FROM embeddings"


def _grid(spark, sf):
    v = F.col("vec_id")
    return read(spark, sf, "embeddings").select(F.floor(v / 256).alias("image"), F.floor(v % 256 / 16).cast("int").alias("y"), (v % 16).cast("int").alias("x"), F.col("embedding")[0].cast("double").alias("v"))


@query(f"""WITH g AS ({GRID}), w AS (SELECT *, y // 7 AS wy, x // 7 AS wx FROM g)
SELECT image, y, x, round(sum(exp(v) * v) OVER p / (sum(exp(v)) OVER p + 49 - count(*) OVER p), 7) AS attended FROM w WINDOW p AS (PARTITION BY image, wy, wx)""")
def w06_window_attention(spark, sf):
    """Windows of 7 by 7; what is missing of a window takes part as zeros."""
    return grid.window_attention(_grid(spark, sf), 7).select("image", "y", "x", F.round("attended", 7).alias("attended"))


@query(f"""WITH g AS ({GRID}), r AS (SELECT image, y, x, v FROM g UNION ALL SELECT DISTINCT image, y, 16, 0.5::DOUBLE FROM g)
SELECT image, (row_number() OVER (PARTITION BY image ORDER BY y, x) - 1)::INTEGER AS pos, v FROM r""")
def t10_newlines(spark, sf):
    return grid.with_newlines(_grid(spark, sf), 0.5)


@query(f"""WITH g AS ({GRID}) SELECT image // 2 AS page, (y + 16 * (image % 2))::INTEGER AS row, x AS col, v FROM g""")
def t11_tiles_to_page(spark, sf):
    """Two tiles, one above the other, make a page."""
    return grid.tiles_to_page(_grid(spark, sf), per_page=2, across=1, height=16, width=16)


@query("""SELECT p_partkey, (ceil((p_size * 64 // 16) / 4.0))::BIGINT AS q, ((ceil((p_size * 64 // 16) / 4.0) + 1) * ceil((p_size * 64 // 16) / 4.0) + 1)::BIGINT AS tokens FROM part""")
def f08_placeholder_tokens(spark, sf):
    q = grid.queries_of(F.col("p_size") * 64)
    return read(spark, sf, "part").select("p_partkey", q.alias("q"), grid.placeholders(q).alias("tokens"))


@query("""SELECT p_partkey, greatest(1, round_even(p_size::DOUBLE / (p_size + p_partkey % 100) * 1024, 0))::BIGINT AS edge FROM part""")
def f09_fit_edge(spark, sf):
    return read(spark, sf, "part").select("p_partkey", grid.fitted_edge(F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 100, 1024).alias("edge"))


@query("""SELECT p_partkey, i::INTEGER AS tile, (i % (p_size % 4 + 1) * 640)::INTEGER AS x, (i // (p_size % 4 + 1) * 640)::INTEGER AS y FROM part, range(0, 12) r(i) WHERE i < (p_size % 4 + 1) * (p_partkey % 3 + 1)""")
def f11_tile_boxes(spark, sf):
    boxes = grid.tile_boxes((F.col("p_size") % 4 + 1).cast("int"), (F.col("p_partkey") % 3 + 1).cast("int"), 640)
    return read(spark, sf, "part").select("p_partkey", F.posexplode(boxes).alias("tile", "b")).select("p_partkey", "tile", "b.x", "b.y")


@query("""SELECT p_partkey, CASE WHEN p_size < 16 THEN 'below 16' WHEN p_size > 40 THEN 'above 40' WHEN p_size % 16 <> 0 THEN 'no multiple of 16' ELSE '' END AS wrong FROM part""")
def p07_edges(spark, sf):
    return read(spark, sf, "part").select("p_partkey", grid.edge_violation(F.col("p_size"), 40).alias("wrong"))


@query("""SELECT p_partkey, (255 - least(255, p_size + p_partkey % 256))::INTEGER AS grey FROM part""")
def s10_ink_to_light(spark, sf):
    return read(spark, sf, "part").select("p_partkey", grid.light(F.col("p_size"), F.col("p_partkey") % 256).cast("int").alias("grey"))


@query("""SELECT vec_id, i::INTEGER AS pos, round(((floor((embedding[i + 1]::DOUBLE + 1) * 127) / 255) - 0.5) / 0.5, 9) AS v FROM embeddings, range(0, 64) r(i)""")
def f12_view_values(spark, sf):
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127))
    return read(spark, sf, "embeddings").select("vec_id", F.posexplode(grid.view(px)).alias("pos", "v")).withColumn("v", F.round("v", 9))


@query("""SELECT label, vec_id, (vec_id * 7919 % 1000 / 1000.0 * 0.4)::DOUBLE AS p_flip, round((vec_id * 7919 % 1000 / 1000.0 * 0.4)::DOUBLE * 10, 7) AS accept_loss, (vec_id * 7919 % 1000 / 1000.0 * 0.4)::DOUBLE * 10 <= 1 AS accept FROM embeddings""")
def f14_accept_loss(spark, sf):
    p = (F.col("vec_id") * 7919 % 1000 / 1000 * 0.4).cast("double")
    return read(spark, sf, "embeddings").select("label", "vec_id", p.alias("p_flip"), F.round(grid.accept_loss(p, 10.0), 7).alias("accept_loss"), (grid.accept_loss(p, 10.0) <= 1.0).alias("accept"))


@query("""WITH RECURSIVE x AS (SELECT 1 AS step, 2463534242::BIGINT AS s UNION ALL SELECT step + 1, c FROM (SELECT step, xor(b, (b << 5) & 4294967295) AS c FROM (SELECT step, xor(a, a >> 17) AS b FROM (SELECT step, xor(s, (s << 13) & 4294967295) AS a FROM x WHERE step < 200))))
SELECT step, s FROM x""")
def g02_xorshift(spark, sf):
    return grid.xorshift(spark, 2463534242, 200)


@query("""SELECT p_brand, min_by(p_name, p_size * 100000 + p_partkey) AS first FROM part WHERE p_size % 3 = 0 GROUP BY p_brand""")
def s25_first_candidate(spark, sf):
    rows = read(spark, sf, "part").select("p_brand", F.col("p_name").alias("path"), (F.col("p_size") * 100000 + F.col("p_partkey")).alias("ordinal"), (F.col("p_size") % 3 == 0).alias("there"))
    return grid.first_existing(rows, "p_brand").select("p_brand", F.col("path").alias("first"))


@query("""SELECT conv_id, coalesce(min(turn) FILTER (WHERE a <> b), -1) AS line FROM (SELECT conv_id, turn, text AS a, CASE WHEN turn % 4 = 3 THEN text || '!' ELSE text END AS b FROM conversations) GROUP BY conv_id""")
def f21_first_difference(spark, sf):
    other = F.when(F.col("turn") % 4 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("a"), other.alias("b"))
    return rows.groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("a") != F.col("b"), F.col("turn"))), F.lit(-1)).alias("line"))
