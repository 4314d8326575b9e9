"""Registered queries: statistical tests, effect sizes, intervals, regression."""

from pyspark.sql import functions as F

from staylens.functions.rounding import stable_round
from staylens.operators import stats as S
from staylens.plans import hypotheses

from .layers import fixed, wh
from .oracle_base import NORM_SF, R, statement
from .operator_queries import table

ENTRIES: dict[str, tuple] = {}


def op(name, build, sql=None, extra=None, digits=6):
    ENTRIES[name] = (lambda s, d: fixed(build(s, d), digits), statement(sql, extra) if sql else None)


def li(s, d):
    return table(s, d, "lineitem")


def ev(s, d):
    return table(s, d, "events")


# ---- normality ------------------------------------------------------------------------------------------
_NORM = {"m": "SELECT event_type, count(*)::DOUBLE n, avg(value) mu FROM events GROUP BY 1",
         "g": "SELECT event_type, max(n) n, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) g1, avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 g2 "
              "FROM events JOIN m USING (event_type) GROUP BY 1",
         "h": """SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) y, 3 * (n*n + 27*n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) be,
 (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) x,
 6 * (n*n - 5*n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) sb FROM g""",
         "i": "SELECT *, sqrt(2 * (be - 1)) - 1 w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) a FROM h",
         "j": """SELECT *, ln(y / sqrt(2 / (w2 - 1)) + sqrt(pow(y / sqrt(2 / (w2 - 1)), 2) + 1)) / sqrt(ln(w2) / 2) zs,
 (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * pow((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1e0 / 3)) / sqrt(2 / (9 * a)) zk FROM i"""}
op("normality_test", lambda s, d: S.normality(ev(s, d), ["event_type"], "value").select("event_type", "test", "n", "statistic", "is_normal"),
   f"SELECT event_type, 'D''Agostino-Pearson' AS test, n::BIGINT n, {R('zs*zs + zk*zk', 6)} statistic, exp(-(zs*zs + zk*zk) / 2) > 0.05 is_normal FROM j", _NORM)


def _f_sql(src):
    return (f"SELECT count(*) k, sum(n)::BIGINT n_total, count(*) - 1 df_between, (sum(n) - count(*))::BIGINT df_within, "
            f"{R('(sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*)))', 6)} statistic "
            f"FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () g FROM (SELECT grp, count(*) n, avg(x) m, var_samp(x) v FROM {src} GROUP BY grp))")


op("levene_test", lambda s, d: S.levene(li(s, d), "l_returnflag", "l_extendedprice"),
   _f_sql("(SELECT l_returnflag grp, abs(l_extendedprice - median(l_extendedprice) OVER (PARTITION BY l_returnflag)) x FROM lineitem)"))
op("anova_test", lambda s, d: S.anova(table(s, d, "part"), "p_type", "p_retailprice").drop("effect", "magnitude"),
   _f_sql("(SELECT p_type grp, p_retailprice x FROM part)"))
op("anova_effect", lambda s, d: S.anova(table(s, d, "part"), "p_brand", "p_size").select("effect", "magnitude"),
   f"SELECT {R('f * b / (f * b + w)', 6)} effect, CASE WHEN f * b / (f * b + w) >= 0.14 THEN 'large' WHEN f * b / (f * b + w) >= 0.06 THEN 'medium' "
   "WHEN f * b / (f * b + w) >= 0.01 THEN 'small' ELSE 'negligible' END magnitude FROM (SELECT (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) f, "
   "count(*) - 1 b, sum(n) - count(*) w FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () g FROM (SELECT p_brand, count(*) n, avg(p_size) m, var_samp(p_size) v FROM part GROUP BY 1)))")
op("cohens_d", lambda s, d: S.cohens_d(ev(s, d), "event_type", "value", "click", "purchase").select("n_a", "n_b", "d", "magnitude"),
   f"SELECT na n_a, nb n_b, {R('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))', 6)} d, 'negligible' magnitude FROM (SELECT count(*) FILTER (event_type = 'click') na, "
   "avg(value) FILTER (event_type = 'click') ma, var_samp(value) FILTER (event_type = 'click') va, count(*) FILTER (event_type = 'purchase') nb, "
   "avg(value) FILTER (event_type = 'purchase') mb, var_samp(value) FILTER (event_type = 'purchase') vb FROM events)")
ENTRIES["welch_test"] = (lambda s, d: fixed(S.welch(li(s, d), "l_linestatus", "l_extendedprice", "O", "F").select("n_a", "n_b", "statistic"), 6),
                         statement(f"SELECT na n_a, nb n_b, {R('(ma - mb) / sqrt(va / na + vb / nb)', 6)} statistic FROM (SELECT count(*) na, avg(l_extendedprice) ma, "
                                   "var_samp(l_extendedprice) va FROM lineitem WHERE l_linestatus = 'O'), (SELECT count(*) nb, avg(l_extendedprice) mb, "
                                   "var_samp(l_extendedprice) vb FROM lineitem WHERE l_linestatus = 'F')"))

_RANKED = """SELECT {g} grp, {v} x, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2e0 r FROM {t} WHERE {w}"""


def _u_sql(v, t, g, a, b):
    src = _RANKED.format(g=g, v=v, t=t, w=f"{g} IN ('{a}', '{b}')")
    return (f"SELECT na n_a, nb n_b, ra - na * (na + 1) / 2e0 statistic, {R('sqrt(na * nb / 12e0 * (n + 1 - ties / (n * (n - 1e0))))', 4)} se, "
            f"{R('1 - 2 * (ra - na * (na + 1) / 2e0) / (na * nb)', 6)} effect FROM (SELECT count(*) n, count(*) FILTER (grp = '{a}') na, count(*) FILTER (grp = '{b}') nb, "
            f"sum(r) FILTER (grp = '{a}') ra FROM rk), (SELECT sum(c * c * c - c) ties FROM (SELECT count(*)::DOUBLE c FROM rk GROUP BY x))", {"rk": src})


_U1 = _u_sql("l_quantity", "lineitem", "l_returnflag", "A", "R")
ENTRIES["rank_sum_test"] = (lambda s, d: _rank_sum(s, d), statement(*_U1))


def _rank_sum(s, d):
    return S.rank_sum(li(s, d), "l_returnflag", "l_quantity", "A", "R").select(
        "n_a", "n_b", "statistic", stable_round("se", 4).alias("se"), stable_round("effect", 6).alias("effect"))


op("rank_biserial", lambda s, d: S.rank_sum(ev(s, d), "event_type", "value", "view", "error").select("effect"),
   _u_sql("value", "events", "event_type", "view", "error")[0].replace("SELECT na n_a", "SELECT effect FROM (SELECT na n_a", 1) + ")",
   _u_sql("value", "events", "event_type", "view", "error")[1])
_KW = {"rk": _RANKED.format(g="p_brand", v="p_size", t="part", w="true")}
op("kruskal_wallis", lambda s, d: S.kruskal_wallis(table(s, d, "part"), "p_brand", "p_size").select("k", "n_total", "statistic", "effect"),
   f"SELECT k, n n_total, {R('h', 6)} statistic, {R('greatest(0, (h - k + 1) / (n - k))', 6)} effect FROM (SELECT k, n, (12e0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) h FROM "
   "(SELECT count(*) k, sum(c)::BIGINT n, sum(r * r / c) ss FROM (SELECT grp, count(*) c, sum(r) r FROM rk GROUP BY 1)), (SELECT sum(c * c * c - c) ties FROM (SELECT count(*)::DOUBLE c FROM rk GROUP BY x)))", _KW)
op("pairwise_rank_sums", lambda s, d: S.pairwise_rank_sums(table(s, d, "part"), "p_type", "p_size").select("group_a", "group_b", "n_a", "n_b", "statistic", "effect"),
   f"""SELECT a.p_type group_a, b.p_type group_b, any_value(ca) n_a, any_value(cb) n_b, sum(a.n * b.n * CASE WHEN a.x > b.x THEN 1e0 WHEN a.x = b.x THEN 0.5e0 ELSE 0 END) statistic,
 {R('1 - 2 * sum(a.n * b.n * CASE WHEN a.x > b.x THEN 1e0 WHEN a.x = b.x THEN 0.5e0 ELSE 0 END) / any_value(ca * cb)', 6)} effect
 FROM (SELECT *, sum(n) OVER (PARTITION BY p_type)::BIGINT ca FROM cells) a JOIN (SELECT *, sum(n) OVER (PARTITION BY p_type)::BIGINT cb FROM cells) b ON a.p_type < b.p_type GROUP BY 1, 2""",
   {"cells": "SELECT p_type, p_size x, count(*) n FROM part GROUP BY 1, 2"})
_PH = {"cells": "SELECT p_type, p_size x, count(*) n FROM part GROUP BY 1, 2",
       "sides": "SELECT a.p_type ga, b.p_type gb, a.x, a.n FROM cells a JOIN (SELECT DISTINCT p_type FROM cells) b ON a.p_type <> b.p_type",
       "prs": "SELECT least(ga, gb) group_a, greatest(ga, gb) group_b, x, sum(n) FILTER (ga < gb) na, sum(n) FILTER (ga > gb) nb FROM sides GROUP BY 1, 2, 3",
       "run": "SELECT *, sum(coalesce(nb, 0)) OVER (PARTITION BY group_a, group_b ORDER BY x) - coalesce(nb, 0) lower_b FROM prs",
       "us": """SELECT group_a, group_b, sum(na)::BIGINT n_a, sum(nb)::BIGINT n_b, sum(coalesce(na, 0) * (lower_b + coalesce(nb, 0) / 2e0)) u,
 sum(pow(coalesce(na, 0) + coalesce(nb, 0), 3) - (coalesce(na, 0) + coalesce(nb, 0))) ties FROM run GROUP BY 1, 2""",
       "zs": "SELECT *, u - n_a * n_b / 2e0 am, sqrt(n_a * n_b / 12e0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1e0)))) se FROM us",
       "ps": f"SELECT *, least(1, 2 * {NORM_SF('(abs(am) - 0.5e0) / se')}) p FROM zs"}
op("posthoc_tests", lambda s, d: S.posthoc(table(s, d, "part"), "p_type", "p_size").select("group_a", "group_b", "statistic", "p_value", "p_adjusted", "is_significant"),
   f"SELECT group_a, group_b, u::DOUBLE statistic, {R('p', 6)} p_value, {R('least(1, p * 15)', 6)} p_adjusted, p * 15 < 0.05 is_significant FROM ps", _PH)
_MG = {"rk": _RANKED.format(g="event_type", v="value", t="events", w="true")}
op("multi_group_test", lambda s, d: S.multi_group_test(ev(s, d), "event_type", "value", "events")["test"],
   f"SELECT 'events' hypothesis, 'Kruskal-Wallis H' AS test, {R('h', 6)} statistic, {R('exp(-h / 2) * (1 + h / 2)', 6)} p_value, {R('greatest(0, (h - k + 1) / (n - k))', 6)} effect, "
   "'ε² (epsilon-squared)' effect_label, CASE WHEN (h - k + 1) / (n - k) >= 0.01 THEN 'small' ELSE 'negligible' END magnitude, exp(-h / 2) * (1 + h / 2) < 0.05 is_significant, n n_total FROM "
   "(SELECT k, n, (12e0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) h FROM (SELECT count(*) k, sum(c)::BIGINT n, sum(r * r / c) ss FROM (SELECT grp, count(*) c, sum(r) r FROM rk GROUP BY 1)), "
   "(SELECT sum(c * c * c - c) ties FROM (SELECT count(*)::DOUBLE c FROM rk GROUP BY x)))", _MG)
_TG = _u_sql("value", "events", "event_type", "click", "view")
op("two_group_test", lambda s, d: S.two_group_test(ev(s, d), "event_type", "value", "click", "view", "clicks").select("test", "statistic", "p_value", "effect", "effect_label", "n_total"),
   f"SELECT 'Mann-Whitney U' AS test, {R('u', 6)} statistic, {R('least(1, 2 * ' + NORM_SF('(abs(u - na * nb / 2e0) - 0.5e0) / se') + ')', 6)} p_value, {R('1 - 2 * u / (na * nb)', 6)} effect, "
   "'rank-biserial r' effect_label, na + nb n_total FROM (SELECT na, nb, ra - na * (na + 1) / 2e0 u, sqrt(na * nb / 12e0 * (n + 1 - ties / (n * (n - 1e0)))) se FROM (SELECT count(*) n, "
   "count(*) FILTER (grp = 'click') na, count(*) FILTER (grp = 'view') nb, sum(r) FILTER (grp = 'click') ra FROM rk), (SELECT sum(c * c * c - c) ties FROM (SELECT count(*)::DOUBLE c FROM rk GROUP BY x)))", _TG[1])
_SR = {"pr": "SELECT l_quantity - l_linenumber * 5 dd FROM lineitem",
       "rk": "SELECT dd, rank() OVER (ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY abs(dd)) - 1) / 2e0 r FROM pr WHERE dd <> 0"}
# rank sums are multiples of a half, exact as they come
ENTRIES["signed_rank_test"] = (lambda s, d: S.signed_rank(li(s, d).withColumn("five", F.col("l_linenumber") * 5), "l_quantity", "five").drop("z"), statement(
   "SELECT count(*) n, sum(r) FILTER (dd > 0) plus, sum(r) FILTER (dd < 0) minus, least(sum(r) FILTER (dd > 0), sum(r) FILTER (dd < 0)) statistic FROM rk", _SR))
op("paired_t_test", lambda s, d: S.paired_t(li(s, d).withColumn("five", F.col("l_linenumber") * 5), "l_quantity", "five"),
   f"SELECT count(*) n, {R('avg(dd)', 6)} mean_difference, {R('avg(dd) / sqrt(var_samp(dd) / count(*))', 6)} statistic, count(*) - 1 df FROM pr", _SR)
ENTRIES["paired_test"] = (lambda s, d: _paired(s, d), statement(
   f"SELECT 'Wilcoxon signed-rank' AS test, least(up, down) statistic, {R('least(1, 2 * ' + NORM_SF('abs((up - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1e0) / 24 - ties / 48))') + ')', 6)} p_value, "
   f"{R('(ma - mb) / sqrt((va + vb) / 2)', 6)} effect, {R('ma - mb', 6)} mean_difference FROM (SELECT count(*) n, sum(r) FILTER (dd > 0) up, sum(r) FILTER (dd < 0) down FROM rk), "
   "(SELECT sum(c * c * c - c) ties FROM (SELECT count(*)::DOUBLE c FROM rk GROUP BY abs(dd))), "
   "(SELECT avg(l_quantity) ma, var_samp(l_quantity) va, avg(l_linenumber * 5 + 5) mb, var_samp(l_linenumber * 5 + 5) vb FROM lineitem)",
   {"pr": "SELECT l_quantity - (l_linenumber * 5 + 5) dd FROM lineitem", "rk": _SR["rk"]}))


def _paired(s, d):
    out = S.paired_test(li(s, d).withColumn("five", F.col("l_linenumber") * 5 + 5), "l_quantity", "five", "pairs")
    return out.select("test", "statistic", *[stable_round(c, 6).alias(c) for c in ("p_value", "effect", "mean_difference")])


op("chi_square", lambda s, d: S.chi_square(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
   f"SELECT sum(o)::BIGINT n, ((count(DISTINCT o_orderstatus) - 1) * (count(DISTINCT o_orderpriority) - 1)) df, {R('sum(pow(o - e, 2) / e)', 6)} statistic FROM (SELECT *, "
   "sum(o) OVER (PARTITION BY o_orderstatus) * sum(o) OVER (PARTITION BY o_orderpriority) / sum(o) OVER ()::DOUBLE e FROM (SELECT o_orderstatus, o_orderpriority, count(*) o FROM orders GROUP BY 1, 2))")
_SC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
op("spearman_matrix", lambda s, d: S.spearman(li(s, d), _SC),
   " UNION ALL ".join(f"SELECT '{a}' column_a, '{b}' column_b, count(*) n, {R('corr(ra, rb)', 6)} rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2e0 ra, "
                      f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2e0 rb FROM lineitem)" for i, a in enumerate(_SC) for b in _SC[i + 1:]))
op("rank_correlates", lambda s, d: S.correlates(wh(s, d).gold, "price_local", ["accommodates", "bedrooms", "review_scores_rating"]).select("feature", "rho", "direction"),
   " UNION ALL ".join(f"SELECT '{b}' feature, {R('corr(ra, rb)', 6)} rho, if(corr(ra, rb) > 0, 'positive', 'negative') direction FROM (SELECT rank() OVER (ORDER BY price_local) + "
                      f"(count(*) OVER (PARTITION BY price_local) - 1) / 2e0 ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2e0 rb FROM gold "
                      f"WHERE {b} IS NOT NULL AND price_local IS NOT NULL)" for b in ("accommodates", "bedrooms", "review_scores_rating")))
_TE = {"tests": "SELECT o_orderpriority || o_orderstatus AS test, count(*) / 20000e0 p_value FROM orders GROUP BY 1"}


def _tests(s, d):
    return table(s, d, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("test")).agg((F.count(F.lit(1)) / 20000.0).alias("p_value"))


_ADJ = {"bonferroni": "p_value * count(*) OVER ()",
        "holm": "max(s) OVER (ORDER BY p_value, test ROWS UNBOUNDED PRECEDING)",
        "fdr_bh": "min(s) OVER (ORDER BY p_value DESC, test DESC ROWS UNBOUNDED PRECEDING)"}
for _m, _e in _ADJ.items():
    _scale = {"holm": "p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, test) + 1)",
              "fdr_bh": "p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, test)"}.get(_m, "0")
    op(f"adjust_p_{_m}", lambda s, d, m=_m: S.adjust_p(_tests(s, d), method=m),
       f"SELECT test, {R('p_value', 6)} p_value, {R('least(adj, 1)', 6)} p_adjusted, least(adj, 1) < 0.05 is_significant FROM (SELECT *, {_e} adj FROM (SELECT *, {_scale} s FROM tests))", _TE)
_PE = {"mm": " UNION ALL ".join(f"SELECT '{c}' metric, l_returnflag g, count({c}) n, avg({c}) m, var_samp({c}) v, median({c}) md FROM lineitem GROUP BY 2" for c in ("l_quantity", "l_extendedprice"))}
op("pairwise_effects", lambda s, d: S.pairwise_effects(li(s, d), "l_returnflag", ["l_quantity", "l_extendedprice"]),
   f"SELECT a.metric, a.g group_a, b.g group_b, {R('(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))', 6)} d, 'negligible' magnitude, "
   f"{R('a.md', 6)} median_a, {R('b.md', 6)} median_b FROM mm a JOIN mm b ON a.metric = b.metric AND a.g < b.g", _PE)
_BOOT_STEPS = " + ".join(f"(u >= {p!r})::INT" for p in S.POISSON_STEPS)


def _weights(resamples):
    """Poisson weights of a thousand blocks, each digest made once."""
    return (f"SELECT blk, b, {_BOOT_STEPS} w FROM (SELECT blk, i * 4 + j b, ('0x' || substr(h, (8 * j + 1)::INT, 8))::BIGINT / 4294967296e0 u FROM "
            f"(SELECT blk, i, md5(blk || '|' || i || '|42') h FROM (SELECT unnest(range(0, 1000)) blk), (SELECT unnest(range(0, {(resamples + 3) // 4})) i)), "
            f"(SELECT unnest(range(0, 4)) j)) WHERE b < {resamples}")


_BLOCK = "(('0x' || substr(md5({key} || '|42'), 1, 8))::BIGINT) % 1000 blk"
_BT = {"cells": f"SELECT event_type, {_BLOCK.format(key='event_id')}, count(*) n, sum(value) s FROM events GROUP BY 1, 2",
       "wts": _weights(10_000), "means": "SELECT event_type, b, sum(w * s) / sum(w * n) m FROM cells JOIN wts USING (blk) GROUP BY 1, 2 HAVING sum(w * n) > 0"}
op("bootstrap_mean", lambda s, d: S.bootstrap_mean(ev(s, d), ["event_type"], "value", "event_id"),
   f"SELECT e.event_type, n, {R('mean', 4)} mean, {R('lo', 4)} ci_lower, {R('hi', 4)} ci_upper FROM (SELECT event_type, count(*) n, avg(value) mean FROM events GROUP BY 1) e JOIN "
   "(SELECT event_type, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi FROM means GROUP BY 1) c USING (event_type)", _BT, digits=4)
_LI = "l_orderkey || '-' || l_linenumber"
_KEYED = lambda s, d: li(s, d).withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
op("bootstrap_ratio", lambda s, d: S.bootstrap(_KEYED(s, d), ["l_returnflag"], {"taxed": F.col("l_extendedprice") * F.col("l_tax"), "all": F.col("l_extendedprice")},
                                               lambda t: t["taxed"] / t["all"], "k"),
   f"SELECT l_returnflag, {R('e', 6)} estimate, {R('lo', 6)} ci_lower, {R('hi', 6)} ci_upper FROM (SELECT l_returnflag, sum(t) / sum(p) e FROM cells GROUP BY 1) JOIN "
   "(SELECT l_returnflag, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi FROM (SELECT l_returnflag, b, sum(w * t) / sum(w * p) m FROM cells JOIN wts USING (blk) GROUP BY 1, 2) GROUP BY 1) USING (l_returnflag)",
   {"cells": f"SELECT l_returnflag, {_BLOCK.format(key=_LI)}, sum(l_extendedprice * l_tax) t, sum(l_extendedprice) p FROM lineitem GROUP BY 1, 2", "wts": _weights(10_000)})
op("bootstrap_median", lambda s, d: S.bootstrap_quantile(_KEYED(s, d), [], "l_tax", "k"),
   f"SELECT {R('(SELECT quantile_disc(l_tax, 0.5) FROM lineitem)', 6)} estimate, {R('quantile_cont(v, 0.025)', 6)} ci_lower, {R('quantile_cont(v, 0.975)', 6)} ci_upper FROM "
   "(SELECT b, min(v) v FROM (SELECT b, v, sum(c) OVER (PARTITION BY b ORDER BY v) c, sum(c) OVER (PARTITION BY b) t FROM sums) WHERE c >= 0.5 * t GROUP BY b)",
   {"cells": f"SELECT l_tax v, {_BLOCK.format(key=_LI)}, count(*) n FROM lineitem GROUP BY 1, 2", "wts": _weights(10_000),
    "sums": "SELECT b, v, sum(w * n) c FROM cells JOIN wts USING (blk) GROUP BY 1, 2"})
_Z = 1.959963984540054  # normal quantile; the t quantile follows by its expansion in 1 / degrees of freedom
_T = " + ".join([f"{_Z!r}", f"{(_Z**3 + _Z) / 4!r} / v", f"{(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (v * v)",
                 f"{(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / (v * v * v)"])
op("mean_interval", lambda s, d: S.mean_ci(ev(s, d), ["event_type"], "value"),
   f"SELECT event_type, n, {R('m', 5)} mean, {R(f'm - ({_T}) * se', 5)} ci_lower, {R(f'm + ({_T}) * se', 5)} ci_upper FROM (SELECT event_type, count(*) n, (count(*) - 1)::DOUBLE v, avg(value) m, "
   "sqrt(var_samp(value) / count(*)) se FROM events GROUP BY 1)", digits=5)
op("vif", lambda s, d: S.vif(li(s, d), ["l_quantity", "l_discount", "l_tax"]))
op("vif_of_two", lambda s, d: S.vif(li(s, d), ["l_quantity", "l_discount"]).select("feature", "vif"),
   f"SELECT unnest(['l_quantity', 'l_discount']) feature, {R('1 / (1 - ab * ab / (aa * bb))', 6)} vif FROM (SELECT sum(l_quantity * l_discount) ab, sum(l_quantity * l_quantity) aa, "
   "sum(l_discount * l_discount) bb FROM lineitem)")


def _regression(s, d):
    src = li(s, d).withColumn("y", F.col("l_quantity") * 3 - F.col("l_discount") * 40 + F.col("l_extendedprice") / 1000)
    return S.ols(src, ["l_quantity", "l_discount", "l_tax"], "y", log_target=False)


op("ols_regression", lambda s, d: _regression(s, d)["coefficients"])
op("ols_fit", lambda s, d: _regression(s, d)["fit"])
op("ols_one_feature", lambda s, d: S.ols(li(s, d).withColumn("y", F.log("l_extendedprice")), ["l_quantity"], "y", log_target=False)["coefficients"].select("feature", "coefficient"),
   f"SELECT 'l_quantity' feature, {R('regr_slope(ln(l_extendedprice), l_quantity)', 6)} coefficient FROM lineitem UNION ALL "
   f"SELECT 'const', {R('regr_intercept(ln(l_extendedprice), l_quantity)', 6)} FROM lineitem")
op("percent_effects", lambda s, d: S.percent_effects(_regression(s, d)["coefficients"]))
op("hypothesis_tests", lambda s, d: hypotheses.hypothesis_tests(wh(s, d).star))
op("city_tests", lambda s, d: hypotheses.city_tests(wh(s, d).star))
from .market_queries import BASE  # noqa: E402

_CE = {"base": BASE["base"], "trimmed": BASE["trimmed"],
       "mm": " UNION ALL ".join(f"SELECT '{c}' metric, city g, count({c}) n, avg({c}) m, var_samp({c}) v, median({c}) md FROM trimmed GROUP BY 2" for c in hypotheses.METRICS)}
_D = "(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))"
op("city_effects", lambda s, d: hypotheses.city_effects(wh(s, d).star),
   f"SELECT a.metric, a.g group_a, b.g group_b, {R(_D, 6)} d, CASE WHEN abs({_D}) >= 0.8 THEN 'large' WHEN abs({_D}) >= 0.5 THEN 'medium' WHEN abs({_D}) >= 0.2 THEN 'small' ELSE 'negligible' END magnitude, "
   f"{R('a.md', 6)} median_a, {R('b.md', 6)} median_b FROM mm a JOIN mm b ON a.metric = b.metric AND a.g < b.g", _CE)


def _boot(keys, src, resamples, value="price_local", key="listing_id"):
    """Common table expressions of the block bootstrap over ``src``."""
    k = ", ".join(keys)
    return {"bcells": f"SELECT {k}, {_BLOCK.format(key=key)}, count(*) n, sum({value}) s FROM {src} GROUP BY ALL", "wts": _weights(resamples),
            "means": f"SELECT {k}, b, sum(w * s) / sum(w * n) m FROM bcells JOIN wts USING (blk) GROUP BY ALL HAVING sum(w * n) > 0",
            "cis": f"SELECT {k}, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi FROM means GROUP BY ALL"}


_RI = {"base": BASE["base"], "kept": "SELECT * FROM base WHERE price_local <= (SELECT quantile_cont(price_local, 0.99) FROM base)",
       "big": "SELECT * FROM kept WHERE room_type IN (SELECT room_type FROM kept GROUP BY 1 HAVING count(*) >= 30)"}
op("room_intervals", lambda s, d: hypotheses.room_intervals(wh(s, d).star),
   f"SELECT p.room_type, n, {R('mean', 4)} mean, {R('lo', 4)} ci_lower, {R('hi', 4)} ci_upper FROM (SELECT room_type, count(*) n, avg(price_local) mean FROM big GROUP BY 1) p JOIN cis USING (room_type)",
   {**_RI, **_boot(["room_type"], "big", 10_000)}, digits=4)
op("area_intervals", lambda s, d: hypotheses.area_intervals(wh(s, d).star))
