"""Operators that SQL can't express, and the errors that operators promise."""

import itertools
import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from vellumspark.functions import layout as L
from vellumspark.functions import text as T
from vellumspark.functions import vectors as V
from vellumspark.operators.exact_sums import exact_sums
from vellumspark.operators import allocation, gates, risk, scaling, scheduling
from vellumspark.operators import sequences as S
from vellumspark.sources import containers, records
from vellumspark.streaming import pages


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_argmax_ignores_nan_and_takes_the_first(spark):
    df = spark.createDataFrame([([float("nan"), 2.0, 2.0],), ([float("nan")],), ([],), ([float("-inf"), float("-inf")],)], "v array<double>")
    assert [r[0] for r in df.select(V.argmax(F.col("v"))).collect()] == [1, 0, 0, 0]


def test_top_k_needs_enough_finite_scores(spark):
    with pytest.raises(Exception, match="fewer finite"):
        spark.createDataFrame([([1.0, float("nan")],)], "v array<double>").select(V.top_k(F.col("v"), 2)).collect()


def test_half_goes_to_even(spark):
    got = one(spark, V.int8(F.col("v"))["q"], v=[127.0, 0.5, 1.5, 2.5, -0.5])
    assert list(got) == [127, 0, 2, 2, 0]
    assert list(one(spark, V.int8(F.col("v"))["q"], v=[0.0, 0.0])) == [0, 0]


def test_nibbles_come_back(spark):
    q = [random.Random(1).randrange(-7, 8) for _ in range(32)]
    assert list(one(spark, V.from_nibbles(V.nibbles(F.col("q").cast("array<int>"))), q=q)) == q


GPT = T.GPT_WORD.replace("\\p{L}", r"\p{L}")


def test_pretokenizer_against_the_regex_module(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab Z9.,!'\n\t é漢かxy  ") for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    got = [list(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.pretokenized(F.col("t"))).collect()]

    def cut(text, pattern):
        out, at = [], 0
        for m in regex.finditer(pattern, text):
            out += [text[at : m.start()], m.group()]
            at = m.end()
        return [x for x in [*out, text[at:]] if x]

    want = []
    for t in texts:
        ps = [q for p in regex.findall(r"\p{N}{1,3}|\P{N}+", t) for q in regex.findall(f"{T.CJK}|{T.NOT_CJK}", p)]
        want.append([q for p in ps for q in cut(p, GPT)])
    assert got == want and all("".join(g) == t for g, t in zip(got, texts, strict=True))


def test_byte_level_is_a_bijection(spark):
    text = "".join(map(chr, range(32, 1000))) + "漢😀"
    got = one(spark, T.byte_level(F.col("t")), t=text)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in own]
    back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}
    assert bytes(back[c] for c in got).decode() == text


def test_pieces_and_bytes_keep_everything(spark):
    text = "a\0b  c\n\n12\0\0é"
    assert "".join(one(spark, T.pretokenized(F.col("t")), t=text)) == text
    assert one(spark, F.size(T.pieces(F.col("t"), T.GPT_WORD)), t="\0\0x") == 2
    long = "é\0" * 200_000
    assert len(one(spark, T.byte_level(F.col("t")), t=long)) == 600_000 and one(spark, T.byte_level(F.col("t")), t="\0 ") == "\u0100\u0120"


def test_values_are_inherited_from_64_nodes(spark):
    from vellumspark.operators import checks

    rows = [(i, i - 1 if i else None, 90 if i == 0 else None) for i in range(140)] + [(500, 501, None), (501, 500, None)]
    got = {r.id: r.value for r in checks.inherited(spark.createDataFrame(rows, "id long, parent long, value int")).collect()}
    assert {i for i, v in got.items() if v == 90} == set(range(64)) and len(got) == 142
    with pytest.raises(ValueError):
        checks.inherited(spark.createDataFrame(rows, "id long, parent long, value int"), 60)


def test_running_heads_and_page_numbers(spark):
    heads = {"THE HISTORY OF ROME": True, " 12  THE HISTORY [1848] ": True, "A": True, "12": False, "The X": False, "CHAP. II. 14": True, "(NOTE)": False, "X [ 184 ]": True, "X [18]": False, "ÉTÉ": False, "": False}
    df = spark.createDataFrame([(k,) for k in heads], "t string")
    assert {r.t: r.h for r in df.select("t", T._header(F.col("t")).alias("h")).collect()} == heads
    pages = {"one\n[ 12 ]": "one", "one\n1234": "one", "one\n12345": "one 12345", "one\n[]": "one []", "9": "9"}
    df = spark.createDataFrame([(k,) for k in pages], "t string")
    assert {r.t: r.n for r in df.select("t", T.normalized(F.col("t")).alias("n")).collect()} == pages


def test_word_distance(spark):
    rng = random.Random(6)
    for _ in range(12):
        a, b = ([rng.choice("pqrst") * rng.randrange(1, 3) for _ in range(rng.randrange(8))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d = list(itertools.accumulate(zip(d, d[1:], b, strict=False), lambda left, c, x=x: min(left + 1, c[1] + 1, c[0] + (x != c[2])), initial=i))
        assert one(spark, T.word_distance(F.col("a"), F.col("b")), a=" ".join(a), b=" ".join(b)) == d[-1]


def test_normalised_text(spark):
    text = "12  THE HISTORY OF ROME  [1848]\n“pene-\ntrate”  the wood\n [ 42 ] "
    assert one(spark, T.normalized(F.col("t")), t=text) == '"penetrate" the wood'
    assert one(spark, T.normalized(F.col("t")), t="THE HISTORY") == "the history"


def test_an_orphan_reference_restarts_the_search(spark):
    text = "<|ref|>a<|/ref|> x <|ref|>b<|/ref|><|det|>[[1,2,3,4]]<|/det|> <|det|>5<|/det|> <|ref|>open <|det|> t [ 9 ] <|/det|>"
    got = one(spark, L.spans(F.col("t")), t=text)
    assert [(s.label, s.box_text) for s in got] == [("b", "[[1,2,3,4]]"), ("t", "[ 9 ]")]


def test_boxes_drop_what_is_left_over(spark):
    assert [list(b) for b in one(spark, L.boxes(F.col("t")), t="1.9 -2.9, +3 .5 7 5.")] == [[1, -2, 3, 0]]
    assert one(spark, L.boxes(F.col("t")), t="none") == []


def test_pages_behind_marks(spark):
    got = one(spark, L.many_pages(F.col("t"), F.lit(1)), t="lost<PAGE> a <|ref|>image<|/ref|><|det|>[[1,1,2,2]]<|/det|><PAGE> <|ref|>x<|/ref|><|det|>1<|/det|> ")
    assert got == "<PAGE>\na ![](images/page_0_0.jpg)\n\n<PAGE>\n<|ref|>x<|/ref|><|det|>1<|/det|>"


def test_samples_outside_are_errors(spark):
    for bad in (1.5, -0.1, float("nan"), None):
        with pytest.raises(Exception, match="not within"):
            risk.checked(spark.createDataFrame([(bad,)], "x double"), "x").collect()


@pytest.mark.parametrize("alpha", [0.01, 0.1, 0.5, 1.0])
def test_cvar_is_the_mean_of_the_worst(spark, alpha):
    xs = np.random.default_rng(3).integers(0, 11, 37) / 10
    got = risk.cvar(risk.histogram(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x"), alpha).first()[0]
    s, left, total = np.sort(xs)[::-1], alpha * len(xs), 0.0
    if left < 1:
        want = s[0]
    else:
        for x in s:
            take = min(1.0, left)
            total, left = total + x * take, left - take
        want = total / (alpha * len(xs))
    assert abs(got - want) < 1e-12


def test_few_exceedances_fall_back(spark):
    r = risk.report(spark.createDataFrame([(k / 20,) for k in range(20)], "x double"), "x").first()
    assert r.fallback and r.shape is None and r.evt == pytest.approx(0.95 - 0.05 * 0.019)
    base = spark.createDataFrame([], "cvar double, evt double")
    one_ = spark.createDataFrame([(0.5, 0.6)], "cvar double, evt double")
    assert risk.gate(one_, base, 0.0).first().verdict == "no-baseline"
    assert risk.gate(one_, spark.createDataFrame([(0.4, 0.6)], "cvar double, evt double"), 0.05).first().verdict == "fail"


def test_scaling_finds_the_law(spark):
    n = [1, 2, 4, 8, 16, 32]
    rows = [("m", k, 10 * k / (1 + 0.05 * (k - 1) + 0.002 * k * (k - 1))) for k in n]
    p = scaling.speedups(spark.createDataFrame(rows, "op string, n int, throughput double"), ["op"])
    fit = scaling.fit_linear(p, ["op"])
    assert fit.first().a == pytest.approx(0.05) and fit.first().b == pytest.approx(0.002)
    d = scaling.decide(scaling.goodness(p, fit, ["op"]), ["op"], 32, 16).first()
    assert (d.chosen, d.decision, d.fallback) == (22, "cap-at-usl-peak", False)
    rough = fit.selectExpr("op", "a + 0.1 AS a", "b * 3 AS b")
    r = scaling.refine(p, rough, ["op"]).first()
    assert r.sse < 1e-6 and r.a == pytest.approx(0.05, abs=1e-3)


def test_ratchet_and_unknown_status(spark):
    now = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "category string, lower double")
    say = lambda rows: gates.ratchet(now, spark.createDataFrame(rows, "category string, floor double, waived boolean")).first().verdict
    assert [say([("a", 0.4, False)]), say([("a", 0.504, False)]), say([("a", 0.6, True)]), say([("a", 0.6, False)]), say([("c", 0.1, False)])] == ["allow", "quarantine", "waiver", "block", "block"]
    with pytest.raises(Exception, match="unknown status"):
        gates.posteriors(spark.createDataFrame([("a", "odd", 1.0)], "category string, status string, weight double")).collect()


def test_better_of_both_histories(spark):
    schema = "name string, p50 double, p90 double, throughput double"
    got = gates.advance(spark.createDataFrame([("a", 1.0, 5.0, 7.0)], schema), spark.createDataFrame([("a", 2.0, 4.0, 8.0), ("b", 1.0, 1.0, 1.0)], schema))
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 4.0, 8.0), ("b", 1.0, 1.0, 1.0)]


def test_allocations(spark):
    rng = random.Random(2)
    rows = [("g", f"t{k}", r, round(10 / r + rng.random(), 3)) for k in range(5) for r in (1, 2, 4, 8)]
    points = spark.createDataFrame(rows, "g string, tensor string, rate long, distortion double")
    own = {t: [(r, d) for _, x, r, d in rows if x == t] for _, t, _, _ in rows}
    for budget in (5, 13, 40):
        best = min(sum(d for _, d in c) for c in itertools.product(*own.values()) if sum(r for r, _ in c) <= budget)
        got = allocation.exact(points, budget, "g").collect()
        assert len(got) == 5 and sum(r.rate for r in got) <= budget and sum(r.distortion for r in got) == pytest.approx(best)
        filled = allocation.waterfill(points.drop("g"), budget).collect()
        assert len(filled) == 5 and sum(r.rate for r in filled) <= budget and sum(r.distortion for r in filled) >= best - 1e-9
    with pytest.raises(ValueError):
        allocation.waterfill(points.drop("g"), 4)


def test_lookups_are_strict(spark):
    rows, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no entry for 2"):
        S.looked_up(rows, dim, "k").collect()
    slots = spark.createDataFrame([(1, 0, True, "a"), (1, 1, False, "b")], "g int, p int, open boolean, x string")
    with pytest.raises(Exception, match="differ in number"):
        S.positional(slots, spark.createDataFrame([(1, 0, "f"), (1, 1, "g")], "g int, q int, f string"), "g", "p", "q").collect()
    got = S.positional(slots, spark.createDataFrame([(1, 5, "f")], "g int, q int, f string"), "g", "p", "q").collect()
    assert sorted((r.p, r.x) for r in got) == [(0, "f"), (1, "b")]


def test_numbering_over_partitions(spark):
    rows = [(random.Random(k).randrange(50), k) for k in range(300)]
    got = scheduling.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "n").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(1, 301))
    assert [scheduling.batch_size(s) for s in (None, "", "0", "x", "7", "999")] == [128, 128, 128, 128, 7, 256]


def test_containers(spark, tmp_path):
    x = np.arange(6, dtype="<f4")
    own = containers.build([("b", "I8", [4], bytes(range(4))), ("a.w", "F32", [2, 3], x.tobytes()), ("h", "BF16", [2], b"\x80\x3f\x00\xc0")])
    assert own == containers.build([("a.w", "F32", [2, 3], x.tobytes()), ("h", "BF16", [2], b"\x80\x3f\x00\xc0"), ("b", "I8", [4], bytes(range(4)))])
    head = b'{"a.w":{"dtype":"F32","shape":[2,3],"data_offsets":[0,24]},"__metadata__":{"k":"v"}}'
    (tmp_path / "one.own").write_bytes(own)
    (tmp_path / "two.st").write_bytes(len(head).to_bytes(8, "little") + head + x.tobytes())
    rows = sorted((r.format, r.name, list(r.shape), r.byte_len) for r in containers.directory(spark, str(tmp_path)).collect())
    assert rows == [("own", "a.w", [2, 3], 24), ("own", "b", [4], 4), ("own", "h", [2], 4), ("safetensors", "a.w", [2, 3], 24)]
    got = {(r.path[-3:], r.name): list(r["values"]) for r in containers.values(spark, str(tmp_path), ["a.w", "h", "absent"]).collect()}
    assert got == {("own", "a.w"): x.tolist(), (".st", "a.w"): x.tolist(), ("own", "h"): [1.0, -2.0]}
    for bad in (b"nothing here", own[:-1] + b"\x09", len(head).to_bytes(8, "little") + head + b"short"):
        with pytest.raises(ValueError):
            containers.entries(bad)
    with pytest.raises(ValueError):
        containers.build([("a", "I8", [1], b"1"), ("a", "I8", [1], b"2")])
    with pytest.raises(ValueError):
        containers.build([("a", "F32", [2], b"1234")])
    ranges = {(r.path[-3:], r.name): list(r["values"]) for r in containers.values(spark, str(tmp_path), ["a.w", "h", "absent"], ranges=True).collect()}
    assert ranges == got
    with pytest.raises(Exception, match="a.w is F32"):
        containers.values(spark, str(tmp_path), ["a.w"], rank=1).collect()


def test_strict_lines_and_manifests(spark):
    lines = spark.createDataFrame([("r", 1, "[t] decode 1 s"), ("r", 2, "[t] odd")], "run string, line_no int, raw string")
    with pytest.raises(Exception, match="unknown line"):
        records.timing_lines(lines, "[t]").collect()
    for bad in ('{"schema_version": 2}', "{not json"):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(bad,)], "t string").select(records.manifest(F.col("t"))).collect()
    parts = spark.createDataFrame([("f", 1, b"ab", 2, "x", "y")], "file string, ordinal int, content binary, size long, sha256 string, file_sha256 string")
    assert tuple(records.reassembled(parts).first()) == ("f", False, 1)


def test_streamed_guard_is_the_batch_guard(spark, tmp_path):
    from vellumspark.operators import sequential

    rng = random.Random(5)
    rows = [(u, t, t, rng.random() < 0.3, rng.random() * 100) for t in range(60) for u in (1, 2, 3)]
    schema = "user_id long, ts long, event_id long, alarm boolean, value double"
    how = {"margin_at": 20.0, "cadence": 5, "up": 1.4, "down": 0.9, "alpha": 0.05}
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == k], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pages.guarded(stream, **how).writeStream.outputMode("update").format("memory").queryName("guarded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("guarded").collect():
        got[r.user_id] = max(got.get(r.user_id, (0,)), (r.steps, r.audits, r.accepted, r.tripped_at))
    want = {r.user_id: tuple(r)[1:] for r in sequential.guard(spark.createDataFrame(rows, schema), "user_id", ["ts", "event_id"], **how).collect()}
    assert got == want


def test_streams_end_alone(spark, tmp_path):
    schema = "user_id long, ts long, event_id long"
    for k in range(2):
        spark.createDataFrame([(u, k, k) for u in (3, 8)], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pages.generated(stream, lambda history, rows: [len(history) + i for i in range(2)], end=2, most=10).writeStream.outputMode("append").format("memory").queryName("made").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.step, r.token, r.done) for r in spark.table("made").collect())
    assert got == [(u, s, s, s == 2) for u in (3, 8) for s in range(3)]


def test_windows_and_sessions_with_watermarks(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_type string, value double"
    spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 00:01:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT 1L, timestamp'2024-01-01 00:04:00', 'a', 3.0D UNION ALL SELECT 1L, timestamp'2024-01-01 02:00:00', 'a', 1.0D").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("w", pages.windowed(stream)), ("s", pages.sessions(stream))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.n, r.total) for r in spark.table("w").collect()] == [(2, 5.0)]
    assert [r.n for r in spark.table("s").collect()] == [2]


def test_byte_pairs_are_the_public_librarys(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from vellumspark.functions import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    rng = random.Random(7)
    texts = ["", None, "Hello  world's été 漢字 😀\n\n x"] + ["".join(rng.choice("abcdeé 1'\n") for _ in range(60)) for _ in range(40)]
    rows = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), path, ["k"])
    got = {r.k: r.ids for r in rows.collect()}
    assert got == {k: None if t is None else public.encode_ordinary(t) for k, t in enumerate(texts)}
    assert {r.k: r.text for r in bpe.decode(rows, path, ["k"]).collect()} == dict(enumerate(texts))
    broken = spark.createDataFrame([(1, [known[b"\xff"]])], "k int, ids array<int>")
    assert bpe.decode(broken, path, ["k"]).first().text == "�"
    with pytest.raises(Exception, match="decode"):
        bpe.decode(broken, path, ["k"], strict=True).collect()


def test_beta_quantiles_and_last_places(spark):
    from vellumspark.operators import checks

    rows = spark.createDataFrame([(1.0, 1.0, 0.3), (2.0, 1.0, 0.25), (1.0, 3.0, 0.5), (40.0, 60.0, 0.5)], "a double, b double, p double")
    got = [r[0] for r in rows.select(checks.beta_quantile("a", "b", "p")).collect()]
    assert got[:3] == pytest.approx([0.3, 0.5, 1 - 0.5 ** (1 / 3)], abs=1e-12) and got[3] == pytest.approx(0.3993, abs=1e-3)
    up = float(np.nextafter(np.float32(1), np.float32(2)))
    pairs = spark.createDataFrame([([1.0], [1.0]), ([1.0], [up]), ([-0.0, 1.0], [0.0, up]), ([1e-45], [-1e-45])], "x array<float>, y array<float>")
    assert [r[0] for r in pairs.select(checks.ulps("x", "y")).collect()] == [0, 1, 1, 2]


def test_pages_fail_alone(spark):
    from vellumspark.operators import model

    def make():
        def step(contents):
            if any(c == b"bad" for c in contents):
                raise ValueError("unreadable")
            return [c.decode().upper() for c in contents]

        return step

    rows = [("d", 1, b"a"), ("d", 2, b"bad"), ("d", 3, None), ("e", 1, b"c")]
    got = model.recognize(spark.createDataFrame(rows, "doc string, page int, content binary").coalesce(1), make, batch=3)
    assert [tuple(r) for r in got.collect()] == [("d", 1, "A", None), ("d", 2, None, "ValueError: unreadable"), ("d", 3, None, "no content"), ("e", 1, "C", None)]
    assert sorted(map(tuple, records.joined_pages(got).collect())) == [("d", "A", None), ("e", "C", None)]


def test_inflating_is_bounded():
    import zlib

    from vellumspark.operators import model

    assert model.inflated(zlib.compress(b"x" * 100), 5, 5, 1, 8) == b"x" * 100
    assert model.inflated(b"plain", 5, 5, 1, 8) == b"plain"
    with pytest.raises(ValueError):
        model.inflated(zlib.compress(b"x" * 101), 5, 5, 1, 8)


def test_domains_of_odd_values(spark):
    from vellumspark.operators import domains as D

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan,), (inf,), (-1.0,), (0.0,), (None,)], "x double")
    assert [r[0] is None for r in df.select(D.finite(F.col("x"))).collect()] == [False, False, False, True, False]
    assert [r[0] for r in df.select(D.margin(F.col("x"))).collect()] == [inf, inf, inf, 0.0, inf]
    bad = df.select(D.calibration(F.col("x"), F.lit(0.5), F.lit(1.9), F.lit(1)).alias("a"), D.calibration(F.lit(1.0), F.col("x"), F.lit(0.0), F.lit(0)).alias("b")).collect()
    assert all(r.a == ["alpha"] for r in bad) and all(r.b[0] == "p0" and r.b[-1] == "cadence" for r in bad)
    rows = spark.createDataFrame([("s", nan, nan), ("s", 0.0, -0.0), ("t", 1.0, 1.0)], "shape string, a double, b double")
    assert {r["shape"]: (r.mismatches, r.passed) for r in D.battery(rows, "shape", "a", "b").collect()} == {"s": (1, False), "t": (0, True)}
    assert one(spark, D.last_json(F.col("t")), t='x\n{"a": 1}\n{"a": 2}\n{broken\n') == '{"a": 2}'
    cut = one(spark, D.compact(F.col("t")), t="  " + "é" * 300 + " ")
    assert cut == "é" * 256 + "..." and one(spark, D.compact(F.col("t")), t="a" + "é" * 300) == "a" + "é" * 255 + "..."


def test_waterfill_spends_what_is_left(spark):
    """The steep step doesn't fit; the next one does."""
    points = spark.createDataFrame([("a", 0, 1000.0), ("a", 100, 0.0), ("b", 0, 10.0), ("b", 10, 0.0)], "tensor string, rate long, distortion double")
    got = {r.tensor: (r.rate, r.distortion) for r in allocation.waterfill(points, 60).collect()}
    assert got == {"a": (0, 1000), "b": (10, 0)}
    assert {r.fallback for r in allocation.allocated(points, 60, 0).collect()} == {None}
    forced = allocation.allocated(points, 60, 10, forced=True).collect()
    assert {(r.tensor, r.rate, r.method, r.fallback) for r in forced} == {("a", 100, "uniform-10", "forced fallback"), ("b", 10, "uniform-10", "forced fallback")}


def test_waterfill_against_one_step_at_a_time(spark):
    rng = random.Random(9)
    curves = {f"t{k:02}": [(r, round(100 / (r + 1) + rng.random() * 3, 3)) for r in sorted(rng.sample(range(40), 6))] for k in range(12)}
    points = spark.createDataFrame([(t, r, d) for t, c in curves.items() for r, d in c], "tensor string, rate long, distortion double")
    hulls = {r.tensor: [(p.r, p.d) for p in r.hull] for r in allocation.hull(points).collect()}
    least = sum(h[0][0] for h in hulls.values())
    for budget in (least, least + 3, least + 25, least + 90, 10_000):
        at, used = dict.fromkeys(hulls, 0), least
        while True:
            fits = [(-(h[at[t]][1] - h[at[t] + 1][1]) / (h[at[t] + 1][0] - h[at[t]][0]), t) for t, h in hulls.items() if at[t] + 1 < len(h) and used + h[at[t] + 1][0] - h[at[t]][0] <= budget]
            if not fits:
                break
            t = min(fits)[1]
            used += hulls[t][at[t] + 1][0] - hulls[t][at[t]][0]
            at[t] += 1
        assert {r.tensor: r.step for r in allocation.waterfill(points, budget).collect()} == at


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_sums_are_those_of_fsum(spark, parts):
    rng = random.Random(4)
    groups = {"a": [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(400)], "b": [5e-324, -0.0, 8e307, 8e307, -8e307, 3.0], "c": [0.1] * 10, "d": [1e16, 1.0, -1e16], "e": [float("inf"), 1.0], "f": [None], "g": [float("nan"), 2.0], "h": [2.5e-310, -1.5e-320]}
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    got = {r.k: (r.total, r.mean, r.n) for r in exact_sums(spark.createDataFrame(rows, "k string, x double").repartition(parts), ["k"], "x").collect()}
    for k in "abcdh":
        assert got[k] == (math.fsum(groups[k]), math.fsum(groups[k]) / len(groups[k]), len(groups[k]))
    assert got["e"][0] == math.inf and got["f"] == (None, None, 0) and math.isnan(got["g"][0])


def test_ranks_within_groups_of_any_size(spark):
    rows = [("a", None), ("b", None), ("b", 3.0), (None, 1.0), (None, 5.0)] + [("c", float(k % 7)) for k in range(70)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: tuple(r)[1:] for r in gates.timing(df, "k", "x").select("k", "best", "p50", "mean", "n").collect()}
    assert got == {"a": (None, None, None, 0), "b": (3.0, 3.0, 3.0, 1), None: (1.0, 3.0, 3.0, 2), "c": (0.0, 3.0, 3.0, 70)}
    near = {r.k: (r.p50, r.p90) for r in gates.nearest_rank(df, "k", "x").collect()}
    assert near == {"a": (None, None), "b": (3.0, 3.0), None: (1.0, 5.0), "c": (3.0, 6.0)}
