"""Queries over vectors and logs, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import context, metrics
from .corpus import table

DIM = 64


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def _rounded(v: F.Column, digits: int = 6) -> F.Column:
    return F.array_join(F.transform(v, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + F.lit(0.0))), ",")


def sql_rounded(v: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({v}, lambda x: printf('%.{digits}f', round(x, {digits}) + 0.0)), ',')"


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


# vectors --------------------------------------------------------------------------------------------------------------


def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    """Product of each vector with the next one by id."""
    e = _vectors(spark, d)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.dot(F.col("v"), F.col("w")), 6).alias("dot"))


def axpy(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return _vectors(spark, d).select("vec_id", _rounded(V.axpy(F.lit(0.5), v, F.reverse(v))).alias("out"))


def rms_norm(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", _rounded(V.rms_norm(F.col("v"))).alias("normed"))


def silu_gate(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return _vectors(spark, d).select("vec_id", F.round(V.total(V.swiglu(v, F.reverse(v))), 6).alias("gated_sum"))


def rope_rotate(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", _rounded(V.rope(F.col("v"), F.col("vec_id") % 128, dim=DIM), 5).alias("rotated"))


def rope_shift_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Turning by 100 and then back by 40 against turning by 60: the largest difference, rounded."""
    e = _vectors(spark, d).select("vec_id", V.rope(F.col("v"), F.lit(100), dim=DIM).alias("a"), V.rope(F.col("v"), F.lit(60), dim=DIM).alias("b"))
    e = e.select("vec_id", V.rope(F.col("a"), F.lit(-40), dim=DIM).alias("a"), "b")
    return e.select("vec_id", F.round(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))), 6).alias("difference"))


def softmax_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most probable ids of each vector taken as logits, ties to the lesser id."""
    p = V.softmax(F.col("v"), 0.7)
    top = F.slice(F.array_sort(F.transform(p, lambda x, i: F.struct((-F.round(x, 9)).alias("m"), i.alias("i")))), 1, 10)
    return _vectors(spark, d).select("vec_id", F.inline(F.transform(top, lambda t: F.struct(t["i"].alias("id"), F.round(-t["m"], 6).alias("p")))))


def greedy_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", V.argmax(F.col("v")).alias("id"))


def nucleus_set(spark: SparkSession, d: str) -> DataFrame:
    ids = V.nucleus(F.col("v"), 0.9, 0.8)
    return _vectors(spark, d).select("vec_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def nucleus_draw(spark: SparkSession, d: str) -> DataFrame:
    """Draw from the nucleus with a number that follows from the id."""
    e = _vectors(spark, d).select("vec_id", V.softmax(F.col("v")).alias("p"), V.nucleus(F.col("v"), 0.9).alias("ids"))
    u = (F.col("vec_id") * 37 % 101) / 101
    return e.select("vec_id", V.draw(F.col("ids"), F.transform("ids", lambda i: F.get(F.col("p"), i)), u).alias("id"))


def quantize_q8_scales(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.posexplode(V.q8_scales(F.col("v"))).alias("block", "scale")).withColumn("scale", F.round("scale", 9))


def q8_dequant_error(spark: SparkSession, d: str) -> DataFrame:
    """Largest difference between a vector and its quantized form, and whether it is within half a step."""
    e = _vectors(spark, d).select("vec_id", "v", V.q8_scales(F.col("v")).alias("s"), V.q8_quants(F.col("v")).alias("q"))
    back = F.transform("q", lambda q, i: q * F.get(F.col("s"), F.floor(i / 32).cast("int")))
    worst = F.array_max(F.zip_with("v", back, lambda a, b: F.abs(a - b)))
    return e.select("vec_id", F.round(worst, 6).alias("worst"), (worst <= F.array_max("s") * 0.5000001).alias("within_half"))


def matvec(spark: SparkSession, d: str) -> DataFrame:
    """Eight fixed weight rows times each vector."""
    rows = V.fixed_matrix(8, DIM)
    out = F.array(*[V.dot(F.array(*[F.lit(x) for x in row]), F.col("v")) for row in rows])
    return _vectors(spark, d).select("vec_id", _rounded(out).alias("out"))


def causal_attention(spark: SparkSession, d: str) -> DataFrame:
    """Attention over sequences of 16 consecutive vectors, every position over itself and those before it."""
    e = _vectors(spark, d).select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("pos"), "v")
    k = e.select("seq", F.col("pos").alias("kpos"), F.col("v").alias("k"))
    score = V.dot(F.col("v"), F.col("k")) / F.sqrt(F.lit(float(DIM)))
    pairs = e.join(k, "seq").where("kpos <= pos").select("seq", "pos", "kpos", score.alias("s"), F.get("k", F.lit(0)).alias("x"), F.get("k", F.lit(63)).alias("y"))
    own = W.partitionBy("seq", "pos")
    weights = pairs.withColumn("e", F.exp(F.col("s") - F.max("s").over(own)))
    out = weights.groupBy("seq", "pos").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("first"), (F.sum(F.col("e") * F.col("y")) / F.sum("e")).alias("last"))
    return out.select((F.col("seq") * 16 + F.col("pos")).alias("vec_id"), F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


def token_losses(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy, its smoothed form, divergence from the reversed logits, and the distillation mix, with the label as target."""
    v, t = F.col("v"), F.col("label").cast("int") % DIM
    ce, kl = V.cross_entropy(v, t), V.kl_divergence(F.reverse(v), v, 2.0)
    return _vectors(spark, d).select("vec_id", F.round(ce, 6).alias("ce"), F.round(V.cross_entropy(v, t, 0.05), 6).alias("smoothed"), F.round(kl, 6).alias("kl"), F.round(0.7 * kl + 0.3 * ce, 6).alias("mixed"))


def row_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with halves turned into adjacent pairs over its first 32 places."""
    perm = V.pair_permutation(DIM, 32)
    return _vectors(spark, d).select("vec_id", _rounded(F.array(*[F.get("v", F.lit(i)) for i in perm])).alias("permuted"))


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select("label", F.posexplode("v").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


# logs: events serve as a training log, one step an event --------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"), (F.col("event_id") % 7 + 1).alias("tokens"), F.lit(0.25).alias("dt"), "user_id", "event_type")


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(metrics.learning_rate(step, 100, 5000, 3e-4, 3e-5), 10).alias("lr"))


def epoch_cap(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", metrics.epoch_cap(F.col("n"), F.lit(8), F.lit(40), F.lit(4.0)).alias("micro_steps"))


def log_window_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.log_windows(_log(spark, d))


def eval_macro_mean(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("batch", F.floor(F.col("step") / 30))
    return metrics.macro_mean(log, "batch", "loss")


def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """Each user's days as evaluations of a run."""
    day = table(spark, d, "events").groupBy("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("step")).agg(F.avg("value").alias("metric"))
    return metrics.early_stopping(day, "user_id", 3, 0.01)


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "purchase", 2.0).otherwise(1.0)
    return _log(spark, d).groupBy("user_id").agg(F.round(metrics.weighted_loss(F.col("loss"), weight), 6).alias("loss"))


def context_shift_plan(spark: SparkSession, d: str) -> DataFrame:
    """Eviction for made-up lengths of a context of 4096 places."""
    n, more = (F.col("event_id") * 97) % 4200, F.col("event_id") % 600
    return table(spark, d, "events").select("event_id", context.eviction(n, more, 4096).alias("discard"))


def props_paths(spark: SparkSession, d: str) -> DataFrame:
    """A path inside the JSON of each event, and whether the whole parses."""
    props = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(props, "$.k").alias("k"), F.try_parse_json(props).isNotNull().alias("valid"), F.get_json_object(props, "$.missing[3].x").alias("missing"))


def request_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Request fields with the defaults of missing or mistyped ones."""
    props = F.col("props")
    return table(spark, d, "events").select(
        "event_id", F.coalesce(F.get_json_object(props, "$.k").try_cast("int"), F.lit(256)).alias("max_tokens"),
        F.coalesce(F.get_json_object(props, "$.temperature").try_cast("double"), F.lit(0.7)).alias("temperature"), F.coalesce(F.get_json_object(props, "$.top_p").try_cast("double"), F.lit(0.9)).alias("top_p"),
    )


def sql_rope(v: str, pos: str) -> str:
    angle = f"(({pos}) * pow(10000.0, -2 * ((i - 1) // 2) / {DIM}.0))"
    return f"list_transform(range(1, {DIM + 1}), lambda i: CASE WHEN i % 2 = 1 THEN {v}[i] * cos({angle}) - {v}[i + 1] * sin({angle}) ELSE {v}[i - 1] * sin({angle}) + {v}[i] * cos({angle}) END)"


def sql_softmax(v: str, t: float = 1.0) -> str:
    e = f"list_transform({v}, lambda x: exp((x - list_max({v})) / {t}))"
    return f"list_transform({v}, lambda x: exp((x - list_max({v})) / {t}) / list_sum({e}))"


def sql_ranked(p: str, digits: int | None = None) -> str:
    x = f"round(x, {digits})" if digits else "x"
    return f"list_sort(list_transform({p}, lambda x, i: struct_pack(m := -{x}, i := (i - 1)::INT)))"


_W = ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in row) + "]" for row in V.fixed_matrix(8, DIM))
_NUCLEUS = f"""{_E}, p AS (SELECT vec_id, {{softmax}} AS p FROM e), r AS (SELECT vec_id, p, {sql_ranked("p")}[1:200] AS r FROM p),
  u AS (SELECT vec_id, p, generate_subscripts(r, 1) AS k, unnest(r) AS x FROM r),
  c AS (SELECT vec_id, p, k, x.i AS id, -x.m AS w, coalesce(sum(-x.m) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
  kept AS (SELECT * FROM c WHERE before < 0.9)"""
_LSE = "(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))))"
_PERM = "[" + ", ".join(f"v[{i + 1}]" for i in V.pair_permutation(DIM, 32)) + "]"

QUERIES = {
    "vector_dot": (vector_dot, f"WITH {_E} SELECT a.vec_id, round({sql_dot('a.v', 'b.v')}, 6) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"),
    "axpy": (axpy, f"WITH {_E} SELECT vec_id, {sql_rounded('list_transform(list_zip(v, list_reverse(v)), lambda p: p[2] + 0.5 * p[1])')} AS out FROM e"),
    "rms_norm": (rms_norm, f"WITH {_E}, s AS (SELECT vec_id, v, sqrt({sql_dot('v', 'v')} / len(v) + 1e-5) AS s FROM e) SELECT vec_id, {sql_rounded('list_transform(v, lambda y: y / s)')} AS normed FROM s"),
    "silu_gate": (silu_gate, f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] / (1 + exp(-p[1])) * p[2])), 6) AS gated_sum FROM e"),
    "rope_rotate": (rope_rotate, f"WITH {_E} SELECT vec_id, {sql_rounded(sql_rope('v', 'vec_id % 128'), 5)} AS rotated FROM e"),
    "rope_shift_equivalence": (rope_shift_equivalence, f"""WITH {_E}, a AS (SELECT vec_id, {sql_rope("v", "100")} AS a, {sql_rope("v", "60")} AS b FROM e), b AS (SELECT vec_id, {sql_rope("a", "-40")} AS a, b FROM a)
        SELECT vec_id, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 6) AS difference FROM b"""),
    "softmax_topk": (softmax_topk, f"WITH {_E}, p AS (SELECT vec_id, {sql_softmax('v', 0.7)} AS p FROM e), r AS (SELECT vec_id, unnest({sql_ranked('p', 9)}[1:10]) AS x FROM p) SELECT vec_id, x.i AS id, round(-x.m, 6) AS p FROM r"),
    "greedy_argmax": (greedy_argmax, f"WITH {_E} SELECT vec_id, (list_position(v, list_max(v)) - 1)::INT AS id FROM e"),
    "nucleus_set": (nucleus_set, f"WITH {_NUCLEUS.format(softmax=sql_softmax('v', 0.8))} SELECT vec_id, string_agg(id::VARCHAR, ',' ORDER BY k) AS ids FROM kept GROUP BY vec_id"),
    "nucleus_draw": (nucleus_draw, f"""WITH {_NUCLEUS.format(softmax=sql_softmax("v"))}, m AS (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS mass, sum(w) OVER (PARTITION BY vec_id ORDER BY k) AS upto FROM kept)
        SELECT vec_id, coalesce(arg_min(id, k) FILTER (upto >= (vec_id * 37 % 101) / 101 * mass), arg_min(id, k)) AS id FROM m GROUP BY vec_id"""),
    "quantize_q8_scales": (quantize_q8_scales, f"WITH {_E}, b AS (SELECT vec_id, v, unnest([0, 1]) AS block FROM e) SELECT vec_id, block, round(list_max(list_transform(v[block * 32 + 1 : block * 32 + 32], lambda x: abs(x))) / 127, 9) AS scale FROM b"),
    "q8_dequant_error": (q8_dequant_error, f"""WITH {_E}, s AS (SELECT vec_id, v, list_transform([0, 1], lambda b: list_max(list_transform(v[b * 32 + 1 : b * 32 + 32], lambda x: abs(x))) / 127) AS s FROM e),
        w AS (SELECT vec_id, s, list_max(list_transform(v, lambda x, i: abs(x - CASE WHEN s[(i - 1) // 32 + 1] = 0 THEN 0 ELSE greatest(-127, least(127, round(x / s[(i - 1) // 32 + 1]))) * s[(i - 1) // 32 + 1] END))) AS worst FROM s)
        SELECT vec_id, round(worst, 6) AS worst, worst <= list_max(s) * 0.5000001 AS within_half FROM w"""),
    "matvec": (matvec, f"WITH {_E} SELECT vec_id, {sql_rounded(f'list_transform([{_W}], lambda w: {sql_dot("w", "v")})')} AS out FROM e"),
    "causal_attention": (causal_attention, f"""WITH {_E}, s AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, v FROM e),
        p AS (SELECT q.seq, q.pos, {sql_dot("q.v", "k.v")} / 8.0 AS s, k.v[1] AS x, k.v[64] AS y FROM s q JOIN s k ON k.seq = q.seq AND k.pos <= q.pos),
        w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos)) AS w FROM p)
        SELECT (seq * 16 + pos)::BIGINT AS vec_id, round(sum(w * x) / sum(w), 6) AS first, round(sum(w * y) / sum(w), 6) AS last FROM w GROUP BY seq, pos"""),
    "token_losses": (token_losses, f"""WITH {_E}, t AS (SELECT vec_id, v, label % 64 AS t, {_LSE} AS lse, {sql_softmax("v", 2.0)} AS q FROM e), u AS (SELECT *, list_reverse(q) AS p FROM t),
        k AS (SELECT vec_id, lse - v[t + 1] AS ce, 0.95 * (lse - v[t + 1]) + 0.05 * (lse - list_sum(v) / len(v)) AS sm,
          list_sum(list_transform(list_zip(p, q), lambda z: CASE WHEN z[1] > 0 THEN z[1] * (ln(z[1]) - ln(z[2])) ELSE 0 END)) * 4 AS kl FROM u)
        SELECT vec_id, round(ce, 6) AS ce, round(sm, 6) AS smoothed, round(kl, 6) AS kl, round(0.7 * kl + 0.3 * ce, 6) AS mixed FROM k"""),
    "row_permutation": (row_permutation, f"WITH {_E} SELECT vec_id, {sql_rounded(_PERM)} AS permuted FROM e"),
    "label_centroids": (label_centroids, f"WITH {_E}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e) SELECT label, i::INT AS i, round(avg(x), 6) AS mean, count(*)::BIGINT AS n FROM u GROUP BY label, i"),
    "lr_schedule": (lr_schedule, """SELECT event_id, round(CASE WHEN event_id < 100 THEN 3e-4::DOUBLE * event_id / 100 WHEN event_id >= 5000 THEN 3e-5::DOUBLE
        ELSE 3e-5::DOUBLE + 0.5 * (3e-4::DOUBLE - 3e-5::DOUBLE) * (1 + cos(pi() * (event_id - 100) / 4900)) END, 10) AS lr FROM events"""),
    "epoch_cap": (epoch_cap, """WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), m AS (SELECT user_id, greatest(1, n // 8) AS per FROM p)
        SELECT user_id, (CASE WHEN 40 / per > 4.0 THEN floor(per * 4.0) ELSE 40 END)::BIGINT AS micro_steps FROM m"""),
    "log_window_metrics": (log_window_metrics, """SELECT event_id // 50 AS "window", count(*)::BIGINT AS n_steps, round(avg(value), 6) AS mean_loss,
        round(sum(value * (event_id % 7 + 1)) / greatest(coalesce(sum(CASE WHEN value IS NOT NULL THEN event_id % 7 + 1 END), 0), 1), 6) AS token_mean,
        round(sum(event_id % 7 + 1) / sum(0.25::DOUBLE), 6) AS tokens_per_s FROM events GROUP BY 1"""),
    "eval_macro_mean": (eval_macro_mean, """WITH p AS (SELECT (event_id + 1) // 30 AS b, avg(value) AS m, sum(value) AS s, count(value) AS c FROM events GROUP BY 1)
        SELECT count(*)::BIGINT AS n_batches, round(avg(m), 6) AS macro, round(sum(s) / sum(c), 6) AS micro FROM p"""),
    "early_stopping": (early_stopping, """WITH RECURSIVE ev AS (SELECT user_id, datediff('day', DATE '2024-01-01', ts::DATE) AS step, avg(value) AS metric FROM events GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS rn FROM ev WHERE metric IS NOT NULL),
        f AS (SELECT user_id, rn, metric AS best, 0 AS bad, NULL::BIGINT AS stop FROM r WHERE rn = 1
          UNION ALL SELECT r.user_id, r.rn, CASE WHEN r.metric < f.best - 0.01 THEN r.metric ELSE f.best END, CASE WHEN r.metric < f.best - 0.01 THEN 0 ELSE f.bad + 1 END,
            CASE WHEN NOT r.metric < f.best - 0.01 AND f.bad + 1 >= 3 THEN r.step END FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1 WHERE f.stop IS NULL)
        SELECT user_id, max(rn)::BIGINT AS n_seen, round(arg_max(best, rn), 6) AS best, max(stop)::BIGINT AS stop_at FROM f GROUP BY user_id"""),
    "weighted_loss": (weighted_loss, """SELECT user_id, round(sum(value * w) / greatest(sum(w), 1e-8), 6) AS loss FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 2.0::DOUBLE ELSE 1.0 END AS w FROM events) GROUP BY user_id"""),
    "context_shift_plan": (context_shift_plan, """WITH n AS (SELECT event_id, event_id * 97 % 4200 AS n, event_id % 600 AS more FROM events), k AS (SELECT *, least(4, n) AS keep, n + more - 4096 AS need FROM n)
        SELECT event_id, (CASE WHEN need <= 0 THEN 0 WHEN keep + more > 4096 THEN NULL ELSE least(n - keep, need + 1024) END)::BIGINT AS discard FROM k"""),
    "props_paths": (props_paths, "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_valid(props), false) AS valid, json_extract_string(props, '$.missing[3].x') AS missing FROM events"),
    "request_defaults": (request_defaults, """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 256) AS max_tokens, coalesce(TRY_CAST(json_extract_string(props, '$.temperature') AS DOUBLE), 0.7::DOUBLE) AS temperature,
        coalesce(TRY_CAST(json_extract_string(props, '$.top_p') AS DOUBLE), 0.9::DOUBLE) AS top_p FROM events"""),
}
