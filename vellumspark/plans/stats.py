"""Queries of statistics, scaling, sequential tests, timing and certification."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import gates, risk, scaling, sequential
from vellumspark.operators.exact_sums import exact_sums

from .base import query, read

TAIL = """WITH v AS (SELECT l_discount * 5 AS x FROM lineitem),
s AS (SELECT x, row_number() OVER (ORDER BY x DESC) AS rn, count(*) OVER () AS n FROM v),
u AS (SELECT quantile_cont(x, 0.85) AS u FROM v),
y AS (SELECT x - u AS y, row_number() OVER (ORDER BY x) AS j, count(*) OVER () AS m FROM v, u WHERE x > u),
m AS (SELECT max(m) AS m, avg(y) AS a0, avg((1 - (j - 0.35) / m) * y) AS a1 FROM y),
f AS (SELECT *, a0 - 2 * a1 AS d FROM m),
g AS (SELECT m, 2 - a0 / d AS shape, 2 * a0 * a1 / d AS scale FROM f)"""


def _discounts(spark, sf):
    """Discounts, scaled to a wider part of [0, 1]."""
    return read(spark, sf, "lineitem").select((F.col("l_discount") * 5).alias("x"))


@query("SELECT (count(*) > 0 AND bool_and(l_discount BETWEEN 0 AND 1)) AS ok, count(*) AS n FROM lineitem")
def p06_samples_in_range(spark, sf):
    return risk.checked(read(spark, sf, "lineitem"), "l_discount").agg((F.count("*") > 0).alias("ok"), F.count("x").alias("n"))


@query("SELECT round(avg(l_discount), 9) AS mean, round(quantile_cont(l_discount, 0.9), 9) AS var FROM lineitem")
def a09_quantile(spark, sf):
    hist = risk.histogram(read(spark, sf, "lineitem"), "l_discount")
    mean = hist.agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))
    return mean.join(F.broadcast(risk.quantiles(hist, {"var": 0.9}))).select(F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))


@query("SELECT l_returnflag, l_linestatus, round(fsum(l_extendedprice * (1 - l_discount)), 3) AS total, round(favg(l_extendedprice * (1 - l_discount)), 7) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a08_exact_mean(spark, sf):
    """Means that don't depend on the order of the rows; tests compare bits."""
    rows = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return exact_sums(rows, ["l_returnflag", "l_linestatus"], "x").withColumns({"total": F.round("total", 3), "mean": F.round("mean", 7)})


@query(f"{TAIL} SELECT round(sum(x * least(1, greatest(0, 0.1 * n - (rn - 1)))) / max(0.1 * n), 9) AS cvar FROM s")
def a10_cvar(spark, sf):
    return risk.cvar(risk.histogram(_discounts(spark, sf), "x")).select(F.round("cvar", 9).alias("cvar"))


@query(f"{TAIL} SELECT round(u, 9) AS threshold, round(shape, 7) AS shape, round(scale, 7) AS scale, m::BIGINT AS m FROM g, u")
def a11_pareto_tail(spark, sf):
    fit = risk.pareto(risk.histogram(_discounts(spark, sf), "x"))
    return fit.select(F.round("threshold", 9).alias("threshold"), F.round("shape", 7).alias("shape"), F.round("scale", 7).alias("scale"), F.col("m").cast("long").alias("m"))


REPORT = f"""{TAIL}, e AS (SELECT least(1, greatest(u + scale / shape * (pow(0.001 / (m / n.n), -shape) - 1), quantile_cont(v.x, 0.999))) AS evt
    FROM g, u, (SELECT count(*) AS n FROM v) n, v GROUP BY u, scale, shape, m, n.n)
SELECT n, round(mean, 7) AS mean, worst, round(var, 9) AS var, round(c.cvar, 9) AS cvar, round(evt, 7) AS evt, round(coverage, 9) AS coverage
FROM (SELECT count(*) AS n, avg(x) AS mean, max(x) AS worst, quantile_cont(x, 0.9) AS var, avg((x <= (SELECT evt FROM e))::INT) AS coverage FROM v), e,
    (SELECT sum(x * least(1, greatest(0, 0.1 * n - (rn - 1)))) / max(0.1 * n) AS cvar FROM s) c"""


@query(REPORT)
def a13_risk_report(spark, sf):
    r = risk.report(_discounts(spark, sf), "x", evt_q=0.999)
    return r.select("n", F.round("mean", 7).alias("mean"), "worst", F.round("var", 9).alias("var"), F.round("cvar", 9).alias("cvar"), F.round("evt", 7).alias("evt"), F.round("coverage", 9).alias("coverage"))


@query("""WITH s AS (SELECT l_returnflag, l_tax AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_tax DESC) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R')),
c AS (SELECT l_returnflag, sum(x * least(1, greatest(0, 0.1 * n - (rn - 1)))) / max(0.1 * n) AS cvar, max(x) AS evt FROM s GROUP BY l_returnflag)
SELECT round(a.cvar, 9) AS cvar, round(b.cvar, 9) AS base, CASE WHEN a.cvar <= b.cvar + 0.001 + 1e-12 AND a.evt <= b.evt + 0.001 + 1e-12 THEN 'pass' ELSE 'fail' END AS verdict
FROM c a, c b WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'""")
def j13_risk_gate(spark, sf):
    """Tax of returned items against accepted ones; the worst value stands for the tail."""
    items = read(spark, sf, "lineitem")

    def side(flag):
        hist = risk.histogram(items.where(F.col("l_returnflag") == flag), "l_tax")
        return risk.cvar(hist).join(F.broadcast(hist.agg(F.max("x").alias("evt"))))

    out = risk.gate(side("A"), side("R"), 0.001)
    return out.select(F.round("cvar", 9).alias("cvar"), F.round("b_cvar", 9).alias("base"), "verdict")


POINTS = """WITH t AS (SELECT l_returnflag AS op, l_linenumber::DOUBLE AS n, sum(l_quantity) * l_linenumber AS thr FROM lineitem GROUP BY l_returnflag, l_linenumber),
b AS (SELECT op, min_by(n, n) AS bn, min_by(thr, n) AS bt FROM t GROUP BY op),
p AS (SELECT t.op, n, thr * bn / bt AS c FROM t JOIN b USING (op)),
q AS (SELECT op, n - 1 AS x, n * (n - 1) AS z, n / c - 1 AS y FROM p WHERE n > 1 AND c > 0),
s AS (SELECT op, sum(x*x) AS pp, sum(x*z) AS pq, sum(z*z) AS qq, sum(x*y) AS py, sum(z*y) AS qy FROM q GROUP BY op),
f AS (SELECT op, (py*qq - qy*pq) / (pp*qq - pq*pq) AS a, (pp*qy - pq*py) / (pp*qq - pq*pq) AS b FROM s),
r AS (SELECT op, a, b, n, c, CASE WHEN 1 + a*(n-1) + b*n*(n-1) <= 0 THEN 0 ELSE n / (1 + a*(n-1) + b*n*(n-1)) END AS m, avg(c) OVER (PARTITION BY op) AS mean FROM p JOIN f USING (op))"""


def _sweep(spark, sf):
    """Quantity by line number as if it were throughput by threads."""
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("op"), F.col("l_linenumber").alias("n"))
    return scaling.speedups(rows.agg((F.sum("l_quantity") * F.first("l_linenumber")).alias("throughput")), ["op"])


@query(f"{POINTS} SELECT op, round(a, 7) AS a, round(b, 8) AS b FROM f")
def a14_scaling_fit(spark, sf):
    return scaling.fit_linear(_sweep(spark, sf), ["op"]).select("op", F.round("a", 7).alias("a"), F.round("b", 8).alias("b"))


@query(f"{POINTS} SELECT op, round(1 - sum((c - m) ** 2) / sum((c - mean) ** 2), 7) AS r2, round(sqrt(sum((c - m) ** 2) / count(*)), 7) AS rmse FROM r GROUP BY op")
def a16_scaling_goodness(spark, sf):
    p = _sweep(spark, sf)
    return scaling.goodness(p, scaling.fit_linear(p, ["op"]), ["op"]).select("op", F.round("r2", 7).alias("r2"), F.round("rmse", 7).alias("rmse"))


@query(f"""{POINTS}, g AS (SELECT op, a, b, 1 - sum((c - m) ** 2) / sum((c - mean) ** 2) AS r2 FROM r GROUP BY op, a, b),
k AS (SELECT *, least(8.0, CASE WHEN b <= 0 THEN 8.0 WHEN a >= 1 THEN 1.0 ELSE sqrt((1 - a) / b) END) AS peak FROM g),
h AS (SELECT *, greatest(1, floor(peak)) AS lo, greatest(1, least(8, ceil(peak))) AS hi FROM k),
j AS (SELECT *, CASE WHEN lo / (1 + a*(lo-1) + b*lo*(lo-1)) >= hi / (1 + a*(hi-1) + b*hi*(hi-1)) THEN lo ELSE hi END AS pn FROM h)
SELECT op, r2 < 0.9 AS fallback, CASE WHEN r2 < 0.9 THEN 4 ELSE pn END::INTEGER AS chosen,
    CASE WHEN r2 < 0.9 THEN 'fallback-physical-cores' WHEN pn >= 8 THEN 'no-cap-needed' ELSE 'cap-at-usl-peak' END AS decision FROM j""")
def a18_pool_decision(spark, sf):
    p = _sweep(spark, sf)
    return scaling.decide(scaling.goodness(p, scaling.fit_linear(p, ["op"]), ["op"]), ["op"], 8, 4).select("op", "fallback", "chosen", "decision")


@query()
def a15_scaling_refined(spark, sf):
    """Iterative: no SQL; tests compare it with a dense search."""
    p = _sweep(spark, sf)
    return scaling.refine(p, scaling.fit_linear(p, ["op"]), ["op"])


STREAM = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type = 'error' AS alarm, value, event_id FROM events"


def _stream(spark, sf):
    return read(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("alarm"), "value")


def _process(up: str, down: str, alpha: float) -> str:
    return f"""WITH RECURSIVE s AS ({STREAM}),
w AS (SELECT user_id, step, CASE WHEN alarm THEN {up} ELSE {down} END AS e FROM s WHERE step = 1
    UNION ALL SELECT s.user_id, s.step, least(8.98846567431158e307, greatest(1e-300, w.e * CASE WHEN s.alarm THEN {up} ELSE {down} END)) FROM w JOIN s ON s.user_id = w.user_id AND s.step = w.step + 1)
SELECT user_id, max_by(e, step) AS e, max(step)::BIGINT AS n, min(CASE WHEN e >= 1 / {alpha} THEN step END)::BIGINT AS crossed FROM w GROUP BY user_id"""


def _rounded(rows):
    """Powers differ in the last digits: ten significant ones are compared."""
    return rows.select("user_id", F.round(F.log10("e"), 7).alias("log_e"), "n", "crossed")


@query(f"SELECT user_id, round(log10(e), 7) AS log_e, n, crossed FROM ({_process('(1 + 0.5::DOUBLE * (1 - 0.2::DOUBLE))', '(1 + 0.5::DOUBLE * (0 - 0.2::DOUBLE))', '0.05::DOUBLE')})")
def w10_agreement_process(spark, sf):
    return _rounded(sequential.betting(_stream(spark, sf), "user_id", ["ts", "event_id"], up=1 + 0.5 * (1 - 0.2), down=1 - 0.5 * 0.2, alpha=0.05))


@query(f"SELECT user_id, round(log10(e), 7) AS log_e, n, crossed FROM ({_process('(0.7::DOUBLE + 0.3::DOUBLE / 0.15::DOUBLE)', '0.7::DOUBLE', '0.01::DOUBLE')})")
def w12_alarm_process(spark, sf):
    return _rounded(sequential.betting(_stream(spark, sf), "user_id", ["ts", "event_id"], up=0.7 + 0.3 / 0.15, down=0.7, alpha=0.01))


@query(f"SELECT round(log10(avg(e)), 7) AS log_e FROM ({_process('(0.7::DOUBLE + 0.3::DOUBLE / 0.15::DOUBLE)', '0.7::DOUBLE', '0.01::DOUBLE')})")
def a35_global_e_value(spark, sf):
    each = sequential.betting(_stream(spark, sf), "user_id", ["ts", "event_id"], up=0.7 + 0.3 / 0.15, down=0.7, alpha=0.01)
    return each.agg(F.round(F.log10(F.avg("e")), 7).alias("log_e"))


@query(f"""WITH RECURSIVE s AS ({STREAM}),
w AS (SELECT user_id, 0::BIGINT AS step, 1.0::DOUBLE AS e, 0 AS since, false AS tripped, 0::BIGINT AS audits, 0::BIGINT AS kept, NULL::BIGINT AS hit FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT user_id, step, e2, CASE WHEN verify THEN 0 ELSE since + 1 END, tripped OR e2 >= 20, audits + (verify AND NOT tripped)::INT, kept + (NOT verify AND NOT alarm)::INT, coalesce(hit, CASE WHEN e2 >= 20 THEN step END)
    FROM (SELECT w.user_id, s.step, w.since, w.tripped, w.audits, w.kept, w.hit, s.alarm, v.verify,
            CASE WHEN v.verify AND NOT w.tripped THEN w.e * CASE WHEN s.alarm THEN 1 + 0.5::DOUBLE * 0.8::DOUBLE ELSE 1 - 0.5::DOUBLE * 0.2::DOUBLE END ELSE w.e END AS e2
        FROM w JOIN s ON s.user_id = w.user_id AND s.step = w.step + 1,
        LATERAL (SELECT w.tripped OR s.value < 20 OR w.since + 1 >= 5 AS verify) v))
SELECT user_id, max(step)::BIGINT AS steps, max(audits)::BIGINT AS audits, max(kept)::BIGINT AS accepted, max(hit)::BIGINT AS tripped_at FROM w GROUP BY user_id""")
def w11_guard(spark, sf):
    return sequential.guard(_stream(spark, sf), "user_id", ["ts", "event_id"], margin_at=20.0, cadence=5, up=1.4, down=0.9, alpha=0.05)


@query("""WITH r AS (SELECT event_type, value AS ms FROM events)
SELECT event_type AS stage, min(ms) AS best, quantile_cont(ms, 0.5) AS p50, round(avg(ms), 7) AS mean, round(stddev_samp(ms) / avg(ms) * 100, 6) AS cv_pct, count(*) AS n FROM r GROUP BY event_type""")
def a29_timing_stats(spark, sf):
    return gates.timing(read(spark, sf, "events"), "event_type", "value").select(F.col("event_type").alias("stage"), "best", "p50", F.round("mean", 7).alias("mean"), F.round("cv_pct", 6).alias("cv_pct"), "n")


@query("""SELECT event_type AS stage, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, stddev_samp(value) / avg(value) * 100 <= 5 AS keep FROM events GROUP BY event_type""")
def a30_nearest_rank(spark, sf):
    return gates.nearest_rank(read(spark, sf, "events"), "event_type", "value").select(F.col("event_type").alias("stage"), "p50", "p90", "keep")


HALVES = """WITH h AS (SELECT event_type AS name, user_id % 2 AS half, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, count(*)::DOUBLE AS thr FROM events GROUP BY 1, 2),
j AS (SELECT a.name, a.p50 / b.p50 - 1 AS d50, a.p90 / b.p90 - 1 AS d90, 1 - a.thr / b.thr AS dt, a.p50 AS ap, b.p50 AS bp FROM h a JOIN h b ON a.name = b.name AND a.half = 0 AND b.half = 1)"""


def _halves(spark, sf):
    events = read(spark, sf, "events").withColumn("half", F.col("user_id") % 2)
    rows = gates.nearest_rank(events, ["event_type", "half"], "value").withColumn("throughput", F.col("n").cast("double")).withColumnRenamed("event_type", "name")
    return rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half")


@query(f"{HALVES} SELECT round(exp(avg(ln(ap / bp))) - 1, 7) AS geomean, round(max(d90), 7) AS worst_p90, round(max(dt), 7) AS worst_throughput FROM j")
def a31_regressions(spark, sf):
    r = gates.regressions(*_halves(spark, sf))
    return r.select(*[F.round(c, 7).alias(c) for c in ("geomean", "worst_p90", "worst_throughput")])


@query(f"""{HALVES} SELECT name, round(d50, 7) AS d50, d50 <= 0.03 + 1e-12 AS primary_ok, d90 <= 0.15 + 1e-12 AS tail_ok, dt <= 0.05 + 1e-12 AS throughput_ok FROM j""")
def j14_bench_gates(spark, sf):
    return gates.compare(*_halves(spark, sf)).select("name", F.round("d50", 7).alias("d50"), "primary_ok", "tail_ok", "throughput_ok")


CERT = """WITH e AS (SELECT o_orderpriority AS category, o_orderstatus AS s, 1.0 + o_custkey % 3 AS w FROM orders),
p AS (SELECT category, 1 + sum(CASE WHEN s = 'F' THEN w WHEN s = 'P' THEN 0.5 * w ELSE 0 END) AS a, 1 + sum(CASE WHEN s = 'O' THEN w WHEN s = 'P' THEN 0.5 * w ELSE 0 END) AS b FROM e GROUP BY category)"""


def _posteriors(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "present").when(F.col("o_orderstatus") == "P", "partial").otherwise("missing")
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), status.alias("status"), (1.0 + F.col("o_custkey") % 3).alias("weight"))
    return gates.posteriors(rows)


@query(f"{CERT} SELECT category, a::DOUBLE AS alpha, b::DOUBLE AS beta, floor(a / (a + b) * 1e6) / 1e6 AS mean, floor(greatest(0, a / (a + b) - 0.01) * 1e6) / 1e6 AS lower FROM p")
def a32_posterior(spark, sf):
    p = _posteriors(spark, sf)
    return p.select("category", "alpha", "beta", gates.truncated(F.col("mean")).alias("mean"), gates.truncated(F.greatest(F.lit(0.0), F.col("mean") - 0.01)).alias("lower"))


@query("""WITH r AS (SELECT event_type, list_sort(list(abs(value - 50) / 100)) AS xs FROM events GROUP BY event_type)
SELECT event_type, round(xs[greatest(0, least(ceil(0.95 * (len(xs) + 1)) - 1, len(xs) - 1))::INTEGER + 1], 9) AS half FROM r""")
def a33_conformal_halfwidth(spark, sf):
    rows = read(spark, sf, "events").select("event_type", (F.abs(F.col("value") - 50) / 100).alias("r"))
    return gates.conformal(rows, ["event_type"], "r", 0.95).select("event_type", F.round("half", 9).alias("half"))


@query(f"""{CERT}, f AS (SELECT category, a / (a + b) AS now, a / (a + b) + CASE WHEN category LIKE '1%' THEN 0.003 WHEN category LIKE '2%' THEN 0.1 ELSE -0.1 END AS floor FROM p)
SELECT count(*) FILTER (WHERE floor - now > 0)::BIGINT AS dips, CASE WHEN count(*) FILTER (WHERE floor - now > 0) = 0 THEN 'allow' WHEN count(*) FILTER (WHERE floor - now > 0 AND category NOT LIKE '2%') = 0 THEN 'waiver' WHEN count(*) FILTER (WHERE floor - now > 0 AND category NOT LIKE '2%') = 1 AND max(floor - now) FILTER (WHERE category NOT LIKE '2%') <= 0.005 THEN 'quarantine' ELSE 'block' END AS verdict FROM f""")
def j15_ratchet(spark, sf):
    now = _posteriors(spark, sf).select("category", F.col("mean").alias("lower"))
    step = F.when(F.col("category").startswith("1"), 0.003).when(F.col("category").startswith("2"), 0.1).otherwise(-0.1)
    floors = now.select("category", (F.col("lower") + step).alias("floor"), F.col("category").startswith("2").alias("waived"))
    return gates.ratchet(now, floors)


@query("""SELECT event_type, coalesce(count(*) FILTER (WHERE value > 60)::DOUBLE / nullif(count(*) FILTER (WHERE user_id % 2 = 0), 0), 0) AS rate FROM events GROUP BY event_type""")
def a41_safe_ratio(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(gates.ratio(F.count_if(F.col("value") > 60), F.count_if(F.col("user_id") % 2 == 0)).alias("rate"))


@query("""SELECT p_brand AS stage, round(sum(greatest(p_retailprice / 50, p_size * 3.0)), 6) AS floor_s, count(*) FILTER (WHERE p_retailprice / 50 >= p_size * 3.0)::BIGINT AS compute_bound FROM part GROUP BY p_brand""")
def a36_roofline(spark, sf):
    cost = read(spark, sf, "part").select(F.col("p_brand").alias("stage"), F.col("p_retailprice").alias("flops"), (F.col("p_size") * 1.0).alias("bytes"))
    return gates.roofline(cost, "stage", flops_per_s=50.0, bytes_per_s=1 / 3).withColumn("floor_s", F.round("floor_s", 6))
