"""Names of all queries with their callables and, where SQL can express them, DuckDB texts.

Queries run over views of the driver's tables (``views``); both sides use the same integer arithmetic, and probabilities are
rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import sequence as S
from .operators import adapters as A
from .operators import candidates as C
from .operators import dedup as D
from .operators import evaluation as E
from .operators import fragments as G
from .operators import hits as H
from .operators import reads as R
from .operators import summits as M
from .operators import tracks as K
from .params import PeakParams, TrimParams
from .plans import peaks as PP
from .plans import preprocess as PR

#: The queries' parameters: pair distances, strand shifts, genome size.
Q_MIN, Q_MAX, STEPS = 50, 150, 300
GENOME = views.CHROMS * views.LENGTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Named pieces of SQL that oracles are put together from, in order of dependence.
CTE = dict(views.SQL)
#: Those that are used several times and are costly: computed once.
ONCE = {"fx_reads", "places", "sites", "site_scores", "site_windows", "opens", "opens_next", "peaks1", "peaks2", "peaks3"}


def query(sql: str | None = None, uses: str = ""):
    """Registers a query under its function's name; ``uses`` names the pieces of SQL (and those they need) that its oracle begins with."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_ctes(uses, sql)
        return f

    return put


def with_ctes(uses: str, sql: str) -> str:
    import re

    need, todo = set(), uses.split()
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in CTE if m != n and re.search(rf"\b{m}\b", CTE[n])]
    body = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({CTE[n]})" for n in CTE if n in need)
    return f"WITH RECURSIVE {body} {sql}" if body else sql


def chip(spark, sf_dir):
    return H.distinct_hits(views.hits(spark, sf_dir))


def ctrl(spark, sf_dir):
    return H.distinct_hits(views.control(spark, sf_dir))


def pairs(spark, sf_dir):
    return G.pairs(chip(spark, sf_dir), Q_MIN, Q_MAX)


def refined(spark, sf_dir):
    return M.refined_summits(M.raw_summits(pairs(spark, sf_dir)), Q_MAX)


def summits(spark, sf_dir):
    return M.merged_summits(refined(spark, sf_dir), Q_MAX)


CTE |= {
    "pairs": f"SELECT f.chrom, f.pos AS f_pos, r.pos AS r_pos FROM hits f JOIN hits r ON f.chrom = r.chrom AND f.strand = 0 AND r.strand = 1 AND r.pos > f.pos + {Q_MIN} AND r.pos <= f.pos + {Q_MAX}",
    "cpairs": f"SELECT f.chrom, f.pos AS f_pos, r.pos AS r_pos FROM ctrl f JOIN ctrl r ON f.chrom = r.chrom AND f.strand = 0 AND r.strand = 1 AND r.pos > f.pos + {Q_MIN} AND r.pos <= f.pos + {Q_MAX}",
    "deltas": "SELECT chrom, pos, CAST(sum(d) AS BIGINT) AS d FROM (SELECT chrom, f_pos AS pos, 1 AS d FROM pairs UNION ALL SELECT chrom, r_pos + 1, -1 FROM pairs) GROUP BY chrom, pos HAVING sum(d) <> 0",
    "cov": "SELECT chrom, pos, d, CAST(sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS cov FROM deltas",
    "raws": "SELECT chrom, pos + (np - pos) // 2 AS pos, cov AS q_cov FROM (SELECT *, lead(pos) OVER w AS np, lead(d) OVER w AS nd FROM cov WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE d > 0 AND nd < 0 AND pos >= 1",
    "refs": f"SELECT chrom, pos, q_cov FROM (SELECT chrom, pos, q_cov, coalesce(max(CASE WHEN rn > 1 THEN q_cov END) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN {Q_MAX - 1} PRECEDING AND CURRENT ROW), q_cov) AS l, max(q_cov) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND {Q_MAX - 1} FOLLOWING) AS r FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn FROM raws)) WHERE q_cov >= l AND q_cov >= r",
    "runs": f"SELECT *, sum(gap) OVER (PARTITION BY chrom ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) >= {Q_MAX} THEN 1 ELSE 0 END AS gap FROM refs)",
    "folded": f"SELECT chrom, list_reduce(list({{'done': CAST([] AS STRUCT(pos BIGINT, q_cov BIGINT)[]), 'pos': pos, 'q_cov': q_cov}} ORDER BY pos), lambda a, x: CASE WHEN x.pos - a.pos < {Q_MAX} THEN {{'done': a.done, 'pos': a.pos + (x.pos - a.pos) // 2, 'q_cov': a.q_cov}} ELSE {{'done': list_append(a.done, {{'pos': a.pos, 'q_cov': a.q_cov}}), 'pos': x.pos, 'q_cov': x.q_cov}} END) AS m FROM runs GROUP BY chrom, run",
    "allmerged": "SELECT chrom, u.pos AS pos, u.q_cov AS q_cov FROM (SELECT chrom, unnest(list_append(m.done, {'pos': m.pos, 'q_cov': m.q_cov})) AS u FROM folded)",
    "merged": "SELECT * FROM allmerged a WHERE pos < (SELECT max(pos) FROM allmerged b WHERE b.chrom = a.chrom)",
}


# hits


@query("SELECT chrom, CASE WHEN strand = 0 THEN pos ELSE pos + 35 END AS pos, strand, read_len FROM fx_hits WHERE pos % 11 <> 5", "fx_hits")
def hits_from_reads(spark, sf_dir):
    """SAM flags to strands, 5' ends, other flags dropped."""
    h = views.hits(spark, sf_dir)
    flag = F.when(F.col("pos") % 11 == 5, 4).when(F.col("strand") == 0, F.when(F.col("pos") % 2 == 0, 0).otherwise(89)).otherwise(F.when(F.col("pos") % 2 == 0, 16).otherwise(147))
    return H.from_alignments(h.select("chrom", F.col("pos").alias("pos0"), flag.alias("flag"), F.col("read_len").alias("seq_len")))


@query("SELECT chrom, pos, strand, read_len FROM hits", "hits")
def hits_dedup(spark, sf_dir):
    return chip(spark, sf_dir)


@query("SELECT chrom, CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) - count(DISTINCT (pos, strand)) AS BIGINT) AS n_redundant, round((count(*) - count(DISTINCT (pos, strand))) / count(*)::DOUBLE, 9) AS dup_rate FROM fx_hits GROUP BY chrom", "fx_hits")
def dup_rate(spark, sf_dir):
    return H.duplication(views.hits(spark, sf_dir)).withColumn("dup_rate", F.round("dup_rate", 9))


@query("SELECT chrom, count(*) AS n_hits, count(*) FILTER (strand = 0) AS n_forward, count(*) FILTER (strand = 1) AS n_reverse, max(read_len) AS read_len FROM hits GROUP BY chrom", "hits")
def strand_counts(spark, sf_dir):
    return H.strand_counts(chip(spark, sf_dir))


@query("SELECT chrom, pos, strand FROM fx_ctrl WHERE chrom IN ('chr2', 'chr5')", "fx_ctrl")
def ctrl_semi(spark, sf_dir):
    return H.on_known_chroms(views.control(spark, sf_dir), views.chroms(spark).where(F.col("chrom").isin("chr2", "chr5"))).select("chrom", "pos", "strand")


@query("SELECT chrom, pos, strand FROM fx_hits WHERE NOT regexp_full_match(chrom, '(.*)[246](.*)')", "fx_hits")
def chrom_regex(spark, sf_dir):
    return H.chrom_filter(views.hits(spark, sf_dir), "(.*)[246](.*)").select("chrom", "pos", "strand")


@query("SELECT chrom, CAST(CASE WHEN strand = 0 THEN least(pos + read_len - 1, 200000) ELSE greatest(pos - read_len + 1, 0) END AS BIGINT) AS pos, 1 - strand AS strand, read_len FROM hits", "hits")
def pseudo_control(spark, sf_dir):
    return H.pseudo_control(chip(spark, sf_dir), views.chroms(spark))


@query("SELECT chrom, pos, min(strand) AS strand, count(*) AS n_hits FROM hits GROUP BY chrom, pos HAVING min(strand) = max(strand)", "hits")
def one_strand_positions(spark, sf_dir):
    return H.one_strand_positions(chip(spark, sf_dir))


# pairs and fragment length

CTE["curve"] = f"SELECT s AS shift, CAST((SELECT count(*) FROM hits WHERE strand = 0 AND pos + s + 1 < 200000) + (SELECT count(*) FROM hits WHERE strand = 1) - 2 * (SELECT count(*) FROM hits f JOIN hits r ON f.chrom = r.chrom AND f.strand = 0 AND r.strand = 1 AND r.pos = f.pos + s + 1) AS BIGINT) AS hd FROM range(0, {STEPS}) t(s)"


@query("SELECT shift, hd FROM curve", "curve")
def hamming_curve(spark, sf_dir):
    return G.hamming_curve(chip(spark, sf_dir), views.chroms(spark), STEPS)


@query("SELECT (SELECT shift + 1 FROM curve WHERE shift >= 73 ORDER BY hd, shift DESC LIMIT 1) AS fragment_length, (SELECT shift FROM curve WHERE shift <= 72 ORDER BY hd, shift LIMIT 1) AS phantom, round(((SELECT max(hd) FROM curve WHERE shift >= 73) - (SELECT min(hd) FROM curve WHERE shift >= 73)) / ((SELECT max(hd) FROM curve WHERE shift >= 73) - (SELECT min(hd) FROM curve WHERE shift <= 72))::DOUBLE, 6) AS rsc", "curve")
def fragment_length(spark, sf_dir):
    return G.fragment_length(G.hamming_curve(chip(spark, sf_dir), views.chroms(spark), STEPS), 36).withColumn("rsc", F.round("rsc", 6))


CTE["qld"] = f"SELECT l AS length, CAST(coalesce(a.n, 0) AS BIGINT) AS chip, CAST(coalesce(b.n, 0) AS BIGINT) AS ctrl, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS diff FROM range(1, {STEPS + 2}) t(l) LEFT JOIN (SELECT r.pos - f.pos + 1 AS d, count(*) AS n FROM hits f JOIN hits r ON f.chrom = r.chrom AND f.strand = 0 AND r.strand = 1 AND r.pos BETWEEN f.pos AND f.pos + {STEPS} GROUP BY 1) a ON a.d = l LEFT JOIN (SELECT r.pos - f.pos + 1 AS d, count(*) AS n FROM ctrl f JOIN ctrl r ON f.chrom = r.chrom AND f.strand = 0 AND r.strand = 1 AND r.pos BETWEEN f.pos AND f.pos + {STEPS} GROUP BY 1) b ON b.d = l"


@query("SELECT length, chip, ctrl, diff FROM qld", "qld")
def qfrag_len_dist(spark, sf_dir):
    return G.pair_length_distribution(chip(spark, sf_dir), ctrl(spark, sf_dir), STEPS)


@query("SELECT length AS fragment_length, diff FROM qld WHERE length BETWEEN 2 AND 36 ORDER BY diff DESC, length LIMIT 1", "qld")
def nexus_len(spark, sf_dir):
    return G.nexus_length(G.pair_length_distribution(chip(spark, sf_dir), ctrl(spark, sf_dir), STEPS), 36)


@query("SELECT chrom, f_pos, r_pos FROM pairs", "pairs")
def qfrags(spark, sf_dir):
    return pairs(spark, sf_dir)


@query("SELECT DISTINCT chrom, f_pos AS pos, 0 AS strand FROM pairs UNION SELECT DISTINCT chrom, r_pos, 1 FROM pairs", "pairs")
def q_hits(spark, sf_dir):
    return G.pair_hits(pairs(spark, sf_dir))


# coverage and summits


@query("SELECT chrom, pos, d, cov FROM cov", "cov")
def coverage(spark, sf_dir):
    return M.coverage(pairs(spark, sf_dir))


@query("SELECT chrom, pos, q_cov FROM raws", "raws")
def raw_summits(spark, sf_dir):
    return M.raw_summits(pairs(spark, sf_dir))


@query("SELECT chrom, pos, q_cov FROM refs", "refs")
def refined_summits(spark, sf_dir):
    return refined(spark, sf_dir)


@query("SELECT chrom, pos, q_cov FROM merged", "merged")
def merged_summits(spark, sf_dir):
    return summits(spark, sf_dir)


@query("SELECT chrom, pos, q_cov FROM allmerged", "allmerged")
def merged_summits_all(spark, sf_dir):
    """With each chromosome's last summit."""
    return M.merged_summits(refined(spark, sf_dir), Q_MAX, drop_last=False)


# evaluation

CTE |= {
    "c1": f"SELECT s.chrom, s.pos AS s, count(*) AS pairs_chip FROM merged s JOIN pairs p ON s.chrom = p.chrom AND p.f_pos > s.pos - {Q_MAX} AND p.f_pos < s.pos AND p.r_pos >= s.pos GROUP BY 1, 2",
    "c1c": f"SELECT s.chrom, s.pos AS s, count(*) AS q_cov_ctrl FROM merged s JOIN cpairs p ON s.chrom = p.chrom AND p.f_pos > s.pos - {Q_MAX} AND p.f_pos < s.pos AND p.r_pos > s.pos GROUP BY 1, 2",
    "c2": f"SELECT s.chrom, s.pos AS s, count(DISTINCT f_pos) AS q_beg_chip, count(DISTINCT r_pos) AS q_end_chip FROM merged s JOIN pairs p ON s.chrom = p.chrom AND p.f_pos > s.pos - {Q_MAX} AND p.f_pos < s.pos AND p.r_pos > s.pos AND p.r_pos < p.f_pos + {Q_MAX} GROUP BY 1, 2",
    "c2c": f"SELECT s.chrom, s.pos AS s, count(DISTINCT f_pos) AS q_beg_ctrl, count(DISTINCT r_pos) AS q_end_ctrl FROM merged s JOIN cpairs p ON s.chrom = p.chrom AND p.f_pos > s.pos - {Q_MAX} AND p.f_pos < s.pos AND p.r_pos > s.pos AND p.r_pos < p.f_pos + {Q_MAX} GROUP BY 1, 2",
}
for _n, _t, _x in (("c3", "hits", "chip"), ("c3c", "ctrl", "ctrl")):
    CTE[_n] = f"SELECT s.chrom, s.pos AS s, count(*) FILTER (h.strand = 0 AND h.pos < s.pos) AS kfu_{_x}, count(*) FILTER (h.strand = 0 AND h.pos >= s.pos) AS kfd_{_x}, count(*) FILTER (h.strand = 1 AND h.pos < s.pos) AS kru_{_x}, count(*) FILTER (h.strand = 1 AND h.pos >= s.pos) AS krd_{_x} FROM merged s JOIN {_t} h ON s.chrom = h.chrom AND h.pos > s.pos - {Q_MAX} AND h.pos < s.pos + {Q_MAX} GROUP BY 1, 2"
_COUNTS = "pairs_chip q_cov_ctrl q_beg_chip q_end_chip q_beg_ctrl q_end_ctrl kfu_chip kfd_chip kru_chip krd_chip kfu_ctrl kfd_ctrl kru_ctrl krd_ctrl".split()
CTE["ev0"] = "SELECT m.chrom, m.pos, m.q_cov, " + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTS) + " FROM merged m JOIN c1 ON c1.chrom = m.chrom AND c1.s = m.pos" + "".join(f" LEFT JOIN {n} ON {n}.chrom = m.chrom AND {n}.s = m.pos" for n in ("c1c", "c2", "c2c", "c3", "c3c"))
CTE["ev"] = f"SELECT *, kfu_chip + kfd_chip + kru_chip + krd_chip AS q_cov_chip, greatest(0, q_beg_chip + q_end_chip - q_beg_ctrl - q_end_ctrl) / {2 * Q_MAX}.0::DOUBLE AS saturation FROM ev0"


@query("SELECT chrom, s, pairs_chip FROM c1", "c1")
def pair_coverage(spark, sf_dir):
    return E.pair_coverage(summits(spark, sf_dir), pairs(spark, sf_dir), Q_MAX, "pairs_chip")


@query("SELECT chrom, s, q_cov_ctrl FROM c1c", "c1c")
def pair_coverage_control(spark, sf_dir):
    return E.pair_coverage(summits(spark, sf_dir), G.pairs(ctrl(spark, sf_dir), Q_MIN, Q_MAX), Q_MAX, "q_cov_ctrl", True)


@query("SELECT chrom, s, q_beg_chip, q_end_chip FROM c2", "c2")
def saturated_pos(spark, sf_dir):
    return E.saturated_positions(summits(spark, sf_dir), pairs(spark, sf_dir), Q_MAX, "chip")


@query("SELECT chrom, s, kfu_chip, kfd_chip, kru_chip, krd_chip FROM c3", "c3")
def strand_side_counts(spark, sf_dir):
    return E.side_counts(summits(spark, sf_dir), chip(spark, sf_dir), Q_MAX, "chip")


def evaluated(spark, sf_dir):
    a, b = chip(spark, sf_dir), ctrl(spark, sf_dir)
    p = G.pairs(a, Q_MIN, Q_MAX)
    s = M.merged_summits(M.refined_summits(M.raw_summits(p), Q_MAX), Q_MAX)
    return E.evaluate(s, p, G.pairs(b, Q_MIN, Q_MAX), a, b, Q_MAX)


@query("SELECT chrom, pos, q_cov_chip, q_cov_ctrl, q_beg_chip, q_end_chip, q_beg_ctrl, q_end_ctrl, round(saturation, 9) AS saturation FROM ev", "ev")
def saturation_score(spark, sf_dir):
    return evaluated(spark, sf_dir).select("chrom", "pos", "q_cov_chip", "q_cov_ctrl", "q_beg_chip", "q_end_chip", "q_beg_ctrl", "q_end_ctrl", F.round("saturation", 9).alias("saturation"))


# probabilities

_N = 2 * Q_MAX
for _n, _t in (("", "hits"), ("c", "ctrl")):
    CTE[f"p{_n}0"] = f"SELECT 1 - exp(-2 * (count(*) FILTER (strand = 0) / {GENOME}.0::DOUBLE * (1 - exp(-{Q_MAX - Q_MIN}.0::DOUBLE * count(*) FILTER (strand = 1) / {GENOME}.0::DOUBLE)))) AS p FROM {_t}"
    CTE[f"pmf{_n}"] = f"SELECT k, exp(sum(r) OVER (ORDER BY k)) AS pmf FROM (SELECT k, CASE WHEN k = 0 THEN {_N} * ln(1 - p) ELSE ln(({_N} - k + 1) / k::DOUBLE) + ln(p) - ln(1 - p) END AS r FROM p{_n}0, range(0, {_N + 1}) t(k))"
CTE["tail"] = "SELECT CAST(k AS INTEGER) AS k, least(1.0::DOUBLE, sum(pmf) OVER (ORDER BY k DESC)) AS p_value FROM pmf"
CTE["dtail"] = "SELECT CAST(d AS INTEGER) AS d, least(1.0::DOUBLE, sum(pmf) OVER (ORDER BY d DESC)) AS p_value FROM (SELECT a.k - b.k AS d, sum(a.pmf * b.pmf) AS pmf FROM pmf a, pmfc b GROUP BY 1)"


def tail(spark, sf_dir):
    return E.upper_tail(E.binomial_pmf(E.success(chip(spark, sf_dir), GENOME, Q_MIN, Q_MAX), _N))


def diff_tail(spark, sf_dir):
    table = lambda h: E.binomial_pmf(E.success(h, GENOME, Q_MIN, Q_MAX), _N)
    return E.difference_tail(table(chip(spark, sf_dir)), table(ctrl(spark, sf_dir)), _N)


def log_p(c="p_value"):
    """-log10, clipped at 300 on both sides, six places."""
    return F.round(F.least(F.lit(300.0), -F.log10(F.greatest(F.col(c), F.lit(1e-300)))), 6)


def log_p_sql(c):
    return f"round(least(300.0::DOUBLE, -log10(greatest({c}, 1e-300::DOUBLE))), 6)"


@query(f"SELECT k, {log_p_sql('p_value')} AS log_p FROM tail", "tail")
def binom_tail(spark, sf_dir):
    return tail(spark, sf_dir).select("k", log_p().alias("log_p"))


@query(f"SELECT d, {log_p_sql('p_value')} AS log_p FROM dtail", "dtail")
def binom_diff_tail(spark, sf_dir):
    return diff_tail(spark, sf_dir).select("d", log_p().alias("log_p"))


_LAM = "SELECT chrom, 4.0::DOUBLE * count(*) * 20 / 200000 AS rate FROM hits GROUP BY chrom"
CTE["lam"] = _LAM
CTE["ptail"] = "SELECT chrom, k, coalesce(sum(exp(l)) OVER (PARTITION BY chrom ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_value FROM (SELECT chrom, k, sum(r) OVER (PARTITION BY chrom ORDER BY k) AS l FROM (SELECT chrom, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END AS r FROM lam, range(0, 301) t(k)))"


@query(f"SELECT chrom, CAST(k AS INTEGER) AS k, {log_p_sql('p_value')} AS log_p FROM ptail WHERE k <= 100", "ptail")
def poisson_tail(spark, sf_dir):
    rates = chip(spark, sf_dir).groupBy("chrom").agg((4.0 * F.count("*") * 20 / views.LENGTH).alias("lambda"))
    return E.poisson_tail(rates, 100).select("chrom", "k", log_p().alias("log_p"))


CTE["pv"] = "SELECT ev.*, q_beg_chip + q_end_chip - q_beg_ctrl - q_end_ctrl AS d, p_value FROM ev JOIN dtail ON dtail.d = q_beg_chip + q_end_chip - q_beg_ctrl - q_end_ctrl"
CTE["qv"] = "SELECT *, p_value * n / rn AS q_value FROM (SELECT *, row_number() OVER (ORDER BY d DESC, chrom, pos) AS rn, count(*) OVER () AS n FROM pv)"


def scored(spark, sf_dir):
    d = F.col("q_beg_chip") + F.col("q_end_chip") - F.col("q_beg_ctrl") - F.col("q_end_ctrl")
    p = evaluated(spark, sf_dir).withColumn("d", d.cast("int")).join(F.broadcast(diff_tail(spark, sf_dir)), "d", "left").na.fill(-1.0, ["p_value"])
    return E.q_values(E.rank_by(p, -F.col("d")))


@query(f"SELECT chrom, pos, d, {log_p_sql('p_value')} AS log_p FROM pv", "pv")
def summit_pvalues(spark, sf_dir):
    return scored(spark, sf_dir).select("chrom", "pos", F.col("d").cast("long").alias("d"), log_p().alias("log_p"))


@query(f"SELECT chrom, pos, rn, n, {log_p_sql('q_value')} AS log_q FROM qv", "qv")
def summit_qvalues(spark, sf_dir):
    return scored(spark, sf_dir).select("chrom", "pos", "rn", "n", log_p("q_value").alias("log_q"))


@query("SELECT chrom, pos, rn FROM qv WHERE rn <= 100", "qv")
def top_n(spark, sf_dir):
    return E.top_n(scored(spark, sf_dir), 100).select("chrom", "pos", "rn")


@query("SELECT chrom, pos, rn FROM qv WHERE rn < coalesce((SELECT min(rn) FROM qv WHERE -log10(q_value) <= -1.6), 1000000000)", "qv")
def q_cutoff_takewhile(spark, sf_dir):
    return E.take_while(scored(spark, sf_dir), -1.6).select("chrom", "pos", "rn")


# outputs


_HALF = (Q_MIN + Q_MAX) // 2


@query(f"SELECT chrom, greatest(0, pos - {Q_MIN}) AS start, least(200000, pos + {Q_MIN}) AS \"end\", '.' AS name, CAST(round(saturation * 1000) AS BIGINT) AS score, '.' AS strand, round(saturation, 6) AS signal, {log_p_sql('p_value')} AS log_p, {log_p_sql('q_value')} AS log_q, {Q_MIN} AS peak FROM qv", "qv")
def narrowpeak(spark, sf_dir):
    return K.narrow_peak(scored(spark, sf_dir), views.chroms(spark), Q_MIN).withColumns({"log_p": log_p(), "log_q": log_p("q_value")}).drop("p_value", "q_value")


@query(f"SELECT chrom, pos, q_cov_chip, q_cov_ctrl, q_beg_chip, q_end_chip, q_beg_ctrl, q_end_ctrl, round(saturation, 6) AS saturation, {log_p_sql('p_value')} AS log_p, {log_p_sql('q_value')} AS log_q FROM qv", "qv")
def summit_info(spark, sf_dir):
    return scored(spark, sf_dir).select("chrom", "pos", "q_cov_chip", "q_cov_ctrl", "q_beg_chip", "q_end_chip", "q_beg_ctrl", "q_end_ctrl", F.round("saturation", 6).alias("saturation"), log_p().alias("log_p"), log_p("q_value").alias("log_q"))


CTE |= {
    "qobs": "SELECT chrom, count(*) AS obs FROM (SELECT DISTINCT chrom, f_pos AS pos, 0 AS strand FROM pairs UNION SELECT DISTINCT chrom, r_pos, 1 FROM pairs) GROUP BY chrom",
    "qin": "SELECT c.chrom, c.length, coalesce(h.n, 0) AS n, coalesce(h.f, 0) AS f, coalesce(h.r, 0) AS r, coalesce(a.n, 0) - coalesce(h.n, 0) AS red, coalesce(k.n, 0) AS cn, coalesce(b.n, 0) - coalesce(k.n, 0) AS cred, coalesce(q.obs, 0) AS obs FROM fx_chrom c LEFT JOIN (SELECT chrom, count(*) n, count(*) FILTER (strand = 0) f, count(*) FILTER (strand = 1) r FROM hits GROUP BY 1) h USING (chrom) LEFT JOIN (SELECT chrom, count(*) n FROM fx_hits GROUP BY 1) a USING (chrom) LEFT JOIN (SELECT chrom, count(*) n FROM ctrl GROUP BY 1) k USING (chrom) LEFT JOIN (SELECT chrom, count(*) n FROM fx_ctrl GROUP BY 1) b USING (chrom) LEFT JOIN qobs q USING (chrom)",
    "qsum": "SELECT coalesce(chrom, 'total') AS chrom, chrom IS NULL AS total, CAST(sum(length) AS BIGINT) AS len, CAST(sum(n) AS BIGINT) AS n, CAST(sum(f) AS BIGINT) AS f, CAST(sum(r) AS BIGINT) AS r, CAST(sum(red) AS BIGINT) AS red, CAST(sum(cn) AS BIGINT) AS cn, CAST(sum(cred) AS BIGINT) AS cred, CAST(sum(obs) AS BIGINT) AS obs FROM qin GROUP BY ROLLUP (chrom)",
    "qx": f"SELECT *, (f + r) * (1 - exp(-{Q_MAX - Q_MIN}.0::DOUBLE * r / len)) AS ex, CASE WHEN n > 0 THEN red / (n + red)::DOUBLE ELSE 0 END AS dup, CASE WHEN cn > 0 THEN cred / (cn + cred)::DOUBLE ELSE 0 END AS cdup FROM qsum",
    "qy": "SELECT *, CASE WHEN f + r > 0 THEN greatest(0.0::DOUBLE, (obs - ex) / (f + r)) END AS qes FROM qx",
}


@query("SELECT chrom, n AS hits_chip, red AS removed_chip, round(dup, 6) AS dup_chip, cn AS hits_ctrl, cred AS removed_ctrl, round(cdup, 6) AS dup_ctrl, CAST(round(ex) AS BIGINT) AS q_expected, obs AS q_observed, round(qes, 6) AS qes, round(qes * (1 - dup), 6) AS qss, CAST(round(n * CASE WHEN total THEN qes ELSE qes * (1 - dup) END) AS BIGINT) AS ensh FROM qy", "qy")
def chrom_quality(spark, sf_dir):
    a, b = views.hits(spark, sf_dir), views.control(spark, sf_dir)
    return K.quality(a, b, views.chroms(spark), Q_MIN, Q_MAX)


@query("SELECT chrom, start, \"end\", value FROM (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS \"end\", CAST(sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS value FROM (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, CASE WHEN strand = 0 THEN pos ELSE greatest(0, pos - 99) END AS pos, 1 AS d FROM hits UNION ALL SELECT chrom, least(200001, CASE WHEN strand = 0 THEN pos + 100 ELSE pos + 1 END), -1 FROM hits UNION ALL SELECT chrom, unnest([0, 199999, 200001]), 0 FROM fx_chrom) GROUP BY 1, 2 HAVING sum(d) <> 0 OR pos IN (0, 199999, 200001))) WHERE \"end\" IS NOT NULL AND \"end\" <= 200000", "hits fx_chrom")
def bedgraph(spark, sf_dir):
    return K.bedgraph(chip(spark, sf_dir), views.chroms(spark), 100)


@query("SELECT chrom, greatest(0, s) AS start, least(200000, e) AS \"end\" FROM (SELECT chrom, CASE WHEN strand = 0 THEN pos + 50 ELSE pos - 50 + 1 - 36 END AS s, CASE WHEN strand = 0 THEN pos + 50 + 36 ELSE pos - 50 + 1 END AS e FROM hits WHERE chrom = 'chr1') WHERE s <= 200000 AND e >= 0", "hits")
def reads_bed(spark, sf_dir):
    return K.reads_bed(chip(spark, sf_dir).where("chrom = 'chr1'"), views.chroms(spark), 36, 50)


@query("SELECT chrom, f_pos AS start, r_pos + 1 AS \"end\", 'chip' AS sample FROM pairs UNION ALL SELECT chrom, f_pos, r_pos, 'ctrl' FROM cpairs", "pairs cpairs")
def qfrags_bed(spark, sf_dir):
    return K.pairs_bed(pairs(spark, sf_dir), G.pairs(ctrl(spark, sf_dir), Q_MIN, Q_MAX))


@query("SELECT o AS \"offset\", " + ", ".join(f"count(*) FILTER (x.strand = {st} AND x.sample = '{sm}') AS {'fr'[st]}_{sm}" for sm in ("chip", "ctrl") for st in (0, 1)) + " FROM range(-50, 51) t(o) LEFT JOIN (SELECT h.pos - s.pos AS off, h.strand, h.sample FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn FROM merged) s JOIN (SELECT chrom, pos, strand, 'chip' AS sample FROM hits UNION ALL SELECT chrom, pos, strand, 'ctrl' FROM ctrl) h ON h.chrom = s.chrom AND h.pos BETWEEN s.pos - 50 AND s.pos + 50 WHERE rn > 2 AND s.pos < 200000) x ON x.off = o GROUP BY o", "merged hits ctrl")
def hit_dist(spark, sf_dir):
    return E.hit_distribution(summits(spark, sf_dir), views.chroms(spark), chip(spark, sf_dir), ctrl(spark, sf_dir), 50)


# reads

#: Barcodes and adapters of the queries.
BARCODES = ("TTA", "ACT", "ACA", "TAA", "ACG", "TAG")
ADAPTERS = ((1, "TCTATTAACA", True, False), (2, "CATACTGCAC", True, False), (3, "ACTGA", False, True))


def barcodes(spark):
    return spark.createDataFrame([(i, b) for i, b in enumerate(BARCODES, 1)], "barcode_id int, barcode string")


def adapters(spark):
    return spark.createDataFrame([(i, s, three, anchored, False, 0) for i, s, three, anchored in ADAPTERS], "adapter_id int, adapter string, three boolean, anchored boolean, reverse boolean, overhang int")


CTE |= {
    "fx_barcodes": "SELECT CAST(i AS INTEGER) AS barcode_id, b AS barcode FROM (VALUES " + ", ".join(f"({i}, '{b}')" for i, b in enumerate(BARCODES, 1)) + ") t(i, b)",
    "fx_adapters": "SELECT CAST(i AS INTEGER) AS adapter_id, s AS adapter, three, anchored FROM (VALUES " + ", ".join(f"({i}, '{s}', {t}, {a})" for i, s, t, a in ADAPTERS) + ") t(i, s, three, anchored)",
    "variants": "SELECT DISTINCT barcode_id, substr(barcode, 1, i - 1) || x || substr(barcode, i + 1) AS variant FROM fx_barcodes, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS i), (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS x)",
    "demuxed": "SELECT r.*, CAST(coalesce(b, 0) AS INTEGER) AS demux FROM fx_reads r LEFT JOIN (SELECT barcode, min(barcode_id) AS b FROM fx_barcodes GROUP BY 1) k ON k.barcode = substr(seq, 1, 3) WHERE length(seq) > 3",
    "demuxed_near": "SELECT r.*, CAST(coalesce(b, 0) AS INTEGER) AS demux FROM fx_reads r LEFT JOIN (SELECT variant, min(barcode_id) AS b FROM variants GROUP BY 1) k ON k.variant = substr(seq, 1, 3) WHERE length(seq) > 3",
}


@query("SELECT read_no, CASE WHEN length(seq) > 7 THEN split_part(id, ' ', 1) || ':TL:' || substr(seq, 1, 4) || ':TR:' || substr(seq, length(seq) - 2) || substr(id, length(split_part(id, ' ', 1)) + 1) ELSE id END AS id, CASE WHEN length(seq) > 7 THEN substr(seq, 5, length(seq) - 7) ELSE '' END AS seq FROM fx_reads WHERE length(seq) - 7 >= 10", "fx_reads")
def pretrim_tag(spark, sf_dir):
    return R.pre_trim(views.reads(spark, sf_dir), 4, 3, 10, True).select("read_no", "id", "seq")


@query("SELECT read_no, substr(seq, 1, 30) AS seq, substr(qual, 1, 30) AS qual FROM fx_reads WHERE length(seq) >= 30", "fx_reads")
def trim_to(spark, sf_dir):
    return R.trim_to(views.reads(spark, sf_dir), 30).select("read_no", "seq", "qual")


@query("SELECT read_no, seq FROM fx_reads WHERE length(seq) >= 20", "fx_reads")
def min_length(spark, sf_dir):
    return R.min_length(views.reads(spark, sf_dir), 20).select("read_no", "seq")


@query("SELECT read_no, replace(seq, 'N', 'A') AS seq, length(seq) - length(replace(seq, 'N', '')) AS n_uncalled FROM fx_reads WHERE length(seq) - length(replace(seq, 'N', '')) <= 1", "fx_reads")
def n_filter(spark, sf_dir):
    """Letters z stand for uncalled bases."""
    return R.uncalled_filter(views.reads(spark, sf_dir), 1, "A").select("read_no", "seq", F.col("n_uncalled").cast("long").alias("n_uncalled"))


@query("SELECT read_no, CAST(coalesce(list_max(list_transform(range(0, length(seq)), lambda i: CASE WHEN q[i + 1] >= 20 THEN i + 1 ELSE 0 END)), 0) AS INTEGER) AS kept FROM fx_reads", "fx_reads")
def trim_tail(spark, sf_dir):
    return views.reads(spark, sf_dir).select("read_no", S.kept(S.scores(F.col("qual")), 20, "TAIL").cast("int").alias("kept"))


@query("SELECT read_no, CAST(coalesce(list_min(list_filter(list_transform(range(0, length(seq)), lambda i: CASE WHEN list_sum(q[i + 1 : i + 5]) < 100 THEN i END), lambda x: x IS NOT NULL)), length(seq)) AS INTEGER) AS kept FROM fx_reads", "fx_reads")
def trim_window(spark, sf_dir):
    return views.reads(spark, sf_dir).select("read_no", S.kept(S.scores(F.col("qual")), 20, "WIN").cast("int").alias("kept"))


CTE["sums"] = "SELECT read_no, length(seq) AS len, i, sum(20 - q[i]) OVER (PARTITION BY read_no ORDER BY i DESC) AS s FROM (SELECT read_no, seq, q, unnest(range(1, length(seq) + 1)) AS i FROM fx_reads)"
CTE["live"] = "SELECT * FROM (SELECT *, min(s) OVER (PARTITION BY read_no ORDER BY i DESC) AS m FROM sums) WHERE m >= 0"
CTE["bwa"] = "SELECT r.read_no, CAST(coalesce(b.keep, length(seq)) AS INTEGER) AS kept FROM fx_reads r LEFT JOIN (SELECT read_no, max(i) AS keep FROM (SELECT *, max(s) OVER (PARTITION BY read_no) AS top FROM live) WHERE s = top AND s > 0 GROUP BY 1) b USING (read_no)"


@query("SELECT read_no, kept FROM bwa", "bwa")
def trim_bwa(spark, sf_dir):
    """The running sum alone."""
    return views.reads(spark, sf_dir).select("read_no", S.kept(S.scores(F.col("qual")), 20, "SUM").cast("int").alias("kept"))


@query("SELECT read_no, CAST(coalesce(list_max(list_transform(range(0, kept), lambda i: CASE WHEN q[i + 1] >= 20 THEN i + 1 ELSE 0 END)), 0) AS INTEGER) AS kept FROM bwa JOIN fx_reads USING (read_no)", "bwa fx_reads")
def trim_bwa_then_tail(spark, sf_dir):
    return views.reads(spark, sf_dir).select("read_no", S.kept(S.scores(F.col("qual")), 20, "BWA").cast("int").alias("kept"))


@query("SELECT read_no, CASE WHEN k < length(seq) THEN id || ':QT' ELSE id END AS id, substr(seq, 1, k) AS seq FROM (SELECT *, CAST(coalesce(list_max(list_transform(range(0, length(seq)), lambda i: CASE WHEN q[i + 1] >= 35 THEN i + 1 ELSE 0 END)), 0) AS INTEGER) AS k FROM fx_reads) WHERE k >= 10", "fx_reads")
def quality_trim(spark, sf_dir):
    return R.quality_trim(views.reads(spark, sf_dir), 35, "TAIL", 10, True).select("read_no", "id", "seq")


@query("SELECT read_no, demux FROM demuxed", "demuxed")
def demux_exact(spark, sf_dir):
    return R.demultiplex(views.reads(spark, sf_dir), barcodes(spark), 3).select("read_no", "demux")


@query("SELECT read_no, demux FROM demuxed_near", "demuxed_near")
def demux_approx(spark, sf_dir):
    return R.demultiplex(views.reads(spark, sf_dir), barcodes(spark), 3, True).select("read_no", "demux")


@query("SELECT barcode_id, variant, count(*) AS n FROM (SELECT barcode_id, substr(barcode, 1, i - 1) || x || substr(barcode, i + 1) AS variant FROM fx_barcodes, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS i), (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS x)) GROUP BY 1, 2", "fx_barcodes")
def barcode_variants(spark, sf_dir):
    return R.barcode_variants(barcodes(spark)).groupBy("barcode_id", "variant").agg(F.count("*").alias("n"))


@query("SELECT read_no, CASE WHEN demux > 0 THEN substr(seq, 4) ELSE seq END AS seq, CASE WHEN demux > 0 THEN substr(qual, 4) ELSE qual END AS qual FROM demuxed", "demuxed")
def barcode_clip(spark, sf_dir):
    return R.clip_barcode(R.demultiplex(views.reads(spark, sf_dir), barcodes(spark), 3), 3).select("read_no", "seq", "qual")


@query("SELECT read_no, substr(seq, 4) AS seq FROM demuxed_near WHERE demux > 0", "demuxed_near")
def barcode_clip_excluding(spark, sf_dir):
    return R.clip_barcode(R.demultiplex(views.reads(spark, sf_dir), barcodes(spark), 3, True), 3, exclude=True).select("read_no", "seq")


@query("SELECT demux, count(*) AS n_reads, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM demuxed), 6) AS percent FROM demuxed GROUP BY demux", "demuxed")
def demux_counts(spark, sf_dir):
    return R.demux_counts(R.demultiplex(views.reads(spark, sf_dir), barcodes(spark), 3)).withColumn("percent", F.round("percent", 6))


CTE |= {
    "shifts": "SELECT *, unnest(range(CASE WHEN three THEN CASE WHEN anchored THEN n - m ELSE 0 END ELSE CASE WHEN anchored THEN 0 ELSE 4 - m END END, CASE WHEN three THEN CASE WHEN anchored THEN n - m ELSE n - 4 END ELSE CASE WHEN anchored THEN 0 ELSE n - m END END + 1)) AS s FROM (SELECT read_no, seq, length(seq) AS n, adapter_id, adapter, length(adapter) AS m, three, anchored FROM fx_reads, fx_adapters)",
    "aligned": "SELECT *, least(n - greatest(s, 0), m - greatest(-s, 0)) AS o FROM shifts",
    "compared": "SELECT *, list_sum(list_transform(range(0, o), lambda i: CASE WHEN seq[greatest(s, 0) + i + 1] = adapter[greatest(-s, 0) + i + 1] AND seq[greatest(s, 0) + i + 1] <> 'N' THEN 1 ELSE 0 END)) AS good, list_sum(list_transform(range(0, o), lambda i: CASE WHEN seq[greatest(s, 0) + i + 1] = 'N' OR adapter[greatest(-s, 0) + i + 1] = 'N' THEN 1 ELSE 0 END)) AS amb FROM aligned WHERE o > 0",
    "best": "SELECT read_no, seq, n, adapter_id, m, three, s, o, good, amb FROM (SELECT *, row_number() OVER (PARTITION BY read_no, adapter_id ORDER BY (o - good - amb) / o::DOUBLE, o DESC, s) AS rn FROM compared) WHERE rn = 1",
    "matched": "SELECT *, 2 * good - o + amb AS score, o - good - amb AS wrong FROM best WHERE o >= 4 AND good > 0 AND o - good - amb <= floor(0.2::DOUBLE * o)",
    "chosen": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_no ORDER BY score DESC, adapter_id) AS rk FROM matched) WHERE rk = 1",
}


@query("SELECT read_no, adapter_id, CAST(s AS INTEGER) AS shift, CAST(o AS INTEGER) AS overlap, CAST(good AS INTEGER) AS matches, CAST(amb AS INTEGER) AS ambiguous FROM best", "best")
def adapter_align(spark, sf_dir):
    """The best ungapped alignment of every read with every adapter."""
    return A.align_all(views.reads(spark, sf_dir), adapters(spark), TrimParams())


@query("SELECT r.read_no, CASE WHEN c.s IS NULL THEN r.seq WHEN c.three THEN substr(r.seq, 1, greatest(c.s, 0)) ELSE substr(r.seq, least(c.n, c.s + c.m) + 1) END AS seq, CASE WHEN c.s IS NULL THEN 0 WHEN c.three THEN c.n - greatest(c.s, 0) ELSE least(c.n, c.s + c.m) END AS removed FROM fx_reads r LEFT JOIN chosen c USING (read_no)", "fx_reads chosen")
def adapter_strip_best(spark, sf_dir):
    return A.strip(views.reads(spark, sf_dir), adapters(spark), TrimParams()).select("read_no", "seq", F.col("removed").cast("long").alias("removed"))


def strip_ctes(name: str, source: str, adapters: str = "fx_adapters", extra: str = "") -> str:
    """Registers SQL of one round over ``source`` (read_no, seq, live), and returns the name of its result (read_no, seq, removed, cut as of the quality, adapter_id, overlap, wrong, live).

    No adapter has an N, and a dot in its place keeps a read's N from matching.
    """
    CTE[f"{name}_s"] = f"SELECT *, unnest(range(CASE WHEN three THEN CASE WHEN anchored THEN n - m ELSE 0 END ELSE CASE WHEN anchored THEN 0 ELSE 4 - m END END, CASE WHEN three THEN CASE WHEN anchored THEN n - m ELSE n - 4 END ELSE CASE WHEN anchored THEN 0 ELSE n - m END END + 1)) AS s FROM (SELECT r.read_no, r.seq, length(r.seq) AS n, a.adapter_id, a.adapter, length(a.adapter) AS m, a.three, a.anchored FROM {source} r, {adapters} a WHERE r.live{extra})"
    CTE[f"{name}_o"] = f"SELECT *, substr(seq, CAST(greatest(s, 0) + 1 AS INTEGER), CAST(o AS INTEGER)) AS x, substr(adapter, CAST(greatest(-s, 0) + 1 AS INTEGER), CAST(o AS INTEGER)) AS y FROM (SELECT *, least(n - greatest(s, 0), m - greatest(-s, 0)) AS o FROM {name}_s) WHERE o > 0"
    CTE[f"{name}_c"] = f"SELECT * EXCLUDE (x, y), o - hamming(replace(x, 'N', '.'), y) AS good, o - length(replace(x, 'N', '')) AS amb FROM {name}_o"
    CTE[f"{name}_b"] = f"SELECT *, 2 * good - o + amb AS score, o - good - amb AS wrong FROM (SELECT *, row_number() OVER (PARTITION BY read_no, adapter_id ORDER BY (o - good - amb) / o::DOUBLE, o DESC, s) AS rn FROM {name}_c) WHERE rn = 1 AND o >= 4 AND good > 0 AND o - good - amb <= floor(0.2::DOUBLE * o)"
    CTE[f"{name}_w"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_no ORDER BY score DESC, adapter_id) AS rk FROM {name}_b) WHERE rk = 1"
    keep = "CASE WHEN c.s IS NULL THEN {0} WHEN c.three THEN substr({0}, 1, CAST(greatest(c.s, 0) AS INTEGER)) ELSE substr({0}, CAST(least(c.n, c.s + c.m) + 1 AS INTEGER)) END"
    CTE[name] = f"SELECT *, length(was) - length(seq) AS removed, live0 AND length(seq) < length(was) AND length(seq) >= 4 AS live FROM (SELECT r.read_no, r.seq AS was, r.live AS live0, {keep.format('r.seq')} AS seq, {keep.format('r.qual')} AS qual, c.adapter_id, c.o AS overlap, c.wrong FROM {source} r LEFT JOIN {name}_w c USING (read_no))"
    ONCE.update((name, source, f"{name}_w"))
    return name


def tagged(id_: str, removed: str) -> str:
    return f"CASE WHEN {removed} > 0 THEN split_part({id_}, ' ', 1) || ':AdapterRemoved' || substr({id_}, length(split_part({id_}, ' ', 1)) + 1) ELSE {id_} END"


CTE["strip0"] = "SELECT *, length(seq) > 0 AS live FROM fx_reads"
for _i in (1, 2, 3):
    strip_ctes(f"round{_i}", "strip0" if _i == 1 else f"round{_i - 1}")
    # adapters in turn, each over what the last one left, reads being live as they were at first
    CTE[f"down{_i}_in"] = "SELECT read_no, seq, qual, length(seq) > 0 AS live FROM " + ("strip0" if _i == 1 else f"down{_i - 1}")
    strip_ctes(f"down{_i}", f"down{_i}_in", extra=f" AND a.adapter_id = {_i}")


def stripped_sql(last: str) -> str:
    return f"SELECT r.read_no, {tagged('r.id', 'length(r.seq) - length(x.seq)')} AS id, x.seq, length(r.seq) - length(x.seq) AS removed FROM fx_reads r JOIN {last} x USING (read_no)"


@query(stripped_sql("round3"), "fx_reads round3")
def adapter_strip_rounds(spark, sf_dir):
    """Three rounds, each on what the one before left."""
    return A.strip(views.reads(spark, sf_dir), adapters(spark), TrimParams(times=3)).select("read_no", "id", "seq", F.col("removed").cast("long").alias("removed"))


@query(stripped_sql("down3"), "fx_reads down3")
def adapter_strip_topdown(spark, sf_dir):
    """All adapters in turn."""
    return A.strip(views.reads(spark, sf_dir), adapters(spark), TrimParams(top_down=True)).select("read_no", "id", "seq", F.col("removed").cast("long").alias("removed"))


CTE["pair_shifts"] = "SELECT *, least(n - greatest(s, 0), m - greatest(-s, 0)) AS o FROM (SELECT read_no, seq, reverse(translate(seq_rev, 'ACGT', 'TGCA')) AS rc, length(seq) AS n, length(seq_rev) AS m, unnest(range(1 - length(seq_rev), length(seq))) AS s FROM fx_pairs)"
CTE["pair_cut"] = "SELECT *, substr(seq, CAST(greatest(s, 0) + 1 AS INTEGER), CAST(o AS INTEGER)) AS x, substr(rc, CAST(greatest(-s, 0) + 1 AS INTEGER), CAST(o AS INTEGER)) AS y FROM pair_shifts WHERE o > 0"
# score: matches less mismatches; an N on either side counts for neither
CTE["pair_scored"] = "SELECT read_no, n, s, o, o - hamming(replace(x, 'N', '.'), replace(y, 'N', ',')) AS good, hamming(replace(x, 'N', '.'), y) - hamming(replace(x, 'N', '.'), replace(y, 'N', '.')) AS two, 2 * o - length(replace(x, 'N', '')) - length(replace(y, 'N', '')) AS ns FROM pair_cut"
CTE["pair_best"] = "SELECT * FROM (SELECT *, 2 * good - o + ns - two AS score, row_number() OVER (PARTITION BY read_no ORDER BY 2 * good - o + ns - two DESC, o DESC, s) AS rk FROM pair_scored) WHERE rk = 1"
CTE["pair_insert"] = "SELECT read_no, CASE WHEN o > 5 AND (o - score) // 2 <= o * 0.15::DOUBLE THEN CAST(2 * n - o AS INTEGER) END AS ins FROM pair_best"


@query('SELECT r.read_no, CASE WHEN ins IS NULL THEN seq ELSE substr(seq, 1, ins) END AS seq, CASE WHEN ins IS NULL THEN seq_rev ELSE substr(seq_rev, 1, ins) END AS seq_rev, ins AS "insert" FROM fx_pairs r LEFT JOIN pair_insert USING (read_no)', "fx_pairs pair_insert")
def adapter_strip_paired(spark, sf_dir):
    """Mates cut to the insert that their overlap shows."""
    return A.strip_pair(views.read_pairs(spark, sf_dir)).select("read_no", "seq", "seq_rev", "insert")


# pairs of reads


@query("SELECT read_no, id, id_rev, seq, seq_rev FROM (SELECT read_no, CASE WHEN k THEN split_part(id, ' ', 1) || ':TR:' || substr(seq, length(seq) - 2) || ':TL:' || substr(seq, 1, 4) || substr(id, length(split_part(id, ' ', 1)) + 1) ELSE id END AS id, CASE WHEN k THEN split_part(id_rev, ' ', 1) || ':TR:' || substr(seq_rev, length(seq_rev) - 2) || ':TL:' || substr(seq_rev, 1, 4) || substr(id_rev, length(split_part(id_rev, ' ', 1)) + 1) ELSE id_rev END AS id_rev, CASE WHEN k THEN substr(seq, 5, length(seq) - 7) ELSE '' END AS seq, CASE WHEN k THEN substr(seq_rev, 5, length(seq_rev) - 7) ELSE '' END AS seq_rev FROM (SELECT *, least(length(seq), length(seq_rev)) > 7 AS k FROM fx_pairs)) WHERE least(length(seq), length(seq_rev)) >= 10", "fx_pairs")
def paired_pretrim(spark, sf_dir):
    return R.pre_trim(views.read_pairs(spark, sf_dir), 4, 3, 10, True).select("read_no", "id", "id_rev", "seq", "seq_rev")


@query("SELECT read_no, seq, seq_rev FROM fx_pairs WHERE least(length(seq), length(seq_rev)) >= 30", "fx_pairs")
def paired_min_length(spark, sf_dir):
    return R.min_length(views.read_pairs(spark, sf_dir), 30).select("read_no", "seq", "seq_rev")


@query("SELECT read_no, replace(seq, 'N', 'A') AS seq, replace(seq_rev, 'N', 'A') AS seq_rev, a + b AS n_uncalled FROM (SELECT *, length(seq) - length(replace(seq, 'N', '')) AS a, length(seq_rev) - length(replace(seq_rev, 'N', '')) AS b FROM fx_pairs) WHERE a <= 1 AND b <= 1", "fx_pairs")
def paired_n_filter(spark, sf_dir):
    return R.uncalled_filter(views.read_pairs(spark, sf_dir), 1, "A").select("read_no", "seq", "seq_rev", F.col("n_uncalled").cast("long").alias("n_uncalled"))


@query("SELECT r.read_no, CAST(coalesce(b, 0) AS INTEGER) AS demux FROM fx_reads r LEFT JOIN (SELECT barcode, min(barcode_id) AS b FROM fx_barcodes GROUP BY 1) k ON k.barcode = substr(seq, length(seq) - 2)", "fx_reads fx_barcodes")
def mux_demux(spark, sf_dir):
    """Barcodes in reads of their own (here a read's last three bases)."""
    r = views.reads(spark, sf_dir).withColumn("mux", F.expr("substring(seq, length(seq) - 2, 3)"))
    return R.demultiplex(r, barcodes(spark), 3).select("read_no", "demux")


# quality-aware alignment: error probabilities of mismatches, summed, count as ambiguous by their whole part

CTE["qa_o"] = "SELECT *, substr(seq, CAST(greatest(s, 0) + 1 AS INTEGER), CAST(o AS INTEGER)) AS x, substr(adapter, CAST(greatest(-s, 0) + 1 AS INTEGER), CAST(o AS INTEGER)) AS y, q[greatest(s, 0) + 1 : greatest(s, 0) + o] AS qs FROM (SELECT *, least(n - greatest(s, 0), m - greatest(-s, 0)) AS o FROM (SELECT *, unnest(range(0, n - 3)) AS s FROM (SELECT read_no, seq, q, length(seq) AS n, adapter_id, adapter, length(adapter) AS m FROM fx_reads, fx_adapters WHERE three))) WHERE o > 0"
CTE["qa_c"] = "SELECT read_no, adapter_id, s, o, good, amb0 + CAST(floor(coalesce(list_sum(list_transform(range(0, o), lambda i: CASE WHEN x[i + 1] <> 'N' AND x[i + 1] <> y[i + 1] THEN pow(10.0::DOUBLE, -qs[i + 1] / 10.0::DOUBLE) ELSE 0.0::DOUBLE END)), 0)) AS BIGINT) AS amb FROM (SELECT *, o - hamming(replace(x, 'N', '.'), y) AS good, o - length(replace(x, 'N', '')) AS amb0 FROM qa_o)"
CTE["qa_b"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_no, adapter_id ORDER BY (o - good - amb) / o::DOUBLE, o DESC, s) AS rn FROM qa_c) WHERE rn = 1"


@query("SELECT read_no, adapter_id, CAST(s AS INTEGER) AS shift, CAST(o AS INTEGER) AS overlap, CAST(good AS INTEGER) AS matches, CAST(amb AS INTEGER) AS ambiguous FROM qa_b", "qa_b")
def adapter_align_quality(spark, sf_dir):
    """As adapter_align, for the 3' adapters, with mismatches of likely wrong bases as ambiguous."""
    return A.align_all(views.reads(spark, sf_dir), adapters(spark).where("three"), TrimParams(by_quality=True))


@query("SELECT adapter_id, count(*) AS n_removed, CAST(min(o) AS INTEGER) AS min_overlap, CAST(floor(avg(o)) AS BIGINT) AS mean_overlap, CAST(max(o) AS INTEGER) AS max_overlap FROM chosen GROUP BY adapter_id", "chosen")
def adapter_stats(spark, sf_dir):
    return A.adapter_stats(A.strip(views.reads(spark, sf_dir), adapters(spark), TrimParams()))


@query("SELECT CAST(CASE WHEN three THEN n - greatest(s, 0) ELSE least(n, s + m) END AS INTEGER) AS length, CAST(wrong AS INTEGER) AS mismatches, count(*) AS n FROM chosen GROUP BY 1, 2", "chosen")
def removed_lengths(spark, sf_dir):
    return A.removed_lengths(A.strip(views.reads(spark, sf_dir), adapters(spark), TrimParams()))


# mapped records with barcodes

CTE |= {
    "keyed": "SELECT *, CASE WHEN flag = 16 THEN 1 ELSE 0 END AS strand, CASE WHEN flag = 16 THEN pos0 + seq_len ELSE pos0 END AS pos5, regexp_extract(qname, 'TL:([^:]*)', 1) AS barcode FROM fx_barcoded WHERE flag IN (0, 16)",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY chrom, pos5, strand, barcode ORDER BY rec_no) AS rn FROM keyed",
    "places": "SELECT chrom, pos5, strand, count(*) AS n_total, count(DISTINCT barcode) AS n_unique FROM keyed GROUP BY 1, 2, 3",
}


@query("SELECT rec_no, qname, chrom, pos5, strand FROM numbered WHERE rn = 1", "numbered")
def barcode_dedup(spark, sf_dir):
    return D.deduplicated(views.barcoded(spark, sf_dir)).select("rec_no", "qname", "chrom", "pos5", "strand")


@query("SELECT rec_no, qname, chrom, pos5, strand FROM numbered WHERE rn > 1", "numbered")
def pcr_artifacts(spark, sf_dir):
    return D.artifacts(views.barcoded(spark, sf_dir)).select("rec_no", "qname", "chrom", "pos5", "strand")


@query("SELECT chrom, pos5, strand, n_total, n_unique FROM places", "places")
def occurrence(spark, sf_dir):
    return D.occurrences(views.barcoded(spark, sf_dir))


@query("SELECT rate, CAST(coalesce(u.n, 0) AS BIGINT) AS \"unique\", CAST(coalesce(v.n, 0) AS BIGINT) AS non_unique, CAST(rate * coalesce(u.n, 0) AS BIGINT) AS unique_reads, CAST(rate * coalesce(v.n, 0) AS BIGINT) AS non_unique_reads FROM (SELECT unnest(range(1, (SELECT max(greatest(n_unique, n_total - n_unique)) + 1 FROM places))) AS rate) r LEFT JOIN (SELECT n_unique AS k, count(*) AS n FROM places GROUP BY 1) u ON u.k = rate LEFT JOIN (SELECT n_total - n_unique AS k, count(*) AS n FROM places WHERE n_total > n_unique GROUP BY 1) v ON v.k = rate", "places")
def dup_histogram(spark, sf_dir):
    return D.duplication_histogram(D.occurrences(views.barcoded(spark, sf_dir)))


@query("SELECT rec_no, chrom, pos5, strand FROM numbered n WHERE rn = 1 AND (SELECT n_unique FROM places p WHERE p.chrom = n.chrom AND p.pos5 = n.pos5 AND p.strand = n.strand) >= 2", "numbered places")
def cluster_filter(spark, sf_dir):
    return D.cluster_filter(views.barcoded(spark, sf_dir), 2).select("rec_no", "chrom", "pos5", "strand")


@query("SELECT CASE WHEN xm = 0 THEN 'unmapped' WHEN xm IS NOT NULL THEN 'not_unique' WHEN flag IN (0, 16) THEN 'mapped' ELSE 'other' END AS kind, count(*) AS n FROM fx_barcoded GROUP BY 1", "fx_barcoded")
def xm_classes(spark, sf_dir):
    return D.mapping_classes(views.barcoded(spark, sf_dir))


CTE["kept_places"] = "SELECT chrom, pos5, strand, count(*) AS n_total, count(DISTINCT barcode) AS n_unique FROM keyed WHERE chrom <> 'chr7' GROUP BY 1, 2, 3"


@query("SELECT n_total, n_filtered, n_unmapped, n_not_unique, n_mapped, n_removed, n_same_position, round(n_removed / n_mapped::DOUBLE, 9) AS pcr_rate FROM (SELECT count(*) AS n_total, count(*) FILTER (chrom = 'chr7') AS n_filtered, count(*) FILTER (chrom <> 'chr7' AND xm = 0) AS n_unmapped, count(*) FILTER (chrom <> 'chr7' AND xm <> 0) AS n_not_unique FROM fx_barcoded), (SELECT CAST(sum(n_total) AS BIGINT) AS n_mapped, CAST(sum(n_total - n_unique) AS BIGINT) AS n_removed, CAST(coalesce(sum(n_total - n_unique) FILTER (n_total - n_unique > 1), 0) AS BIGINT) AS n_same_position FROM kept_places)", "fx_barcoded kept_places")
def dedup_stats(spark, sf_dir):
    return D.statistics(views.barcoded(spark, sf_dir), "chr7").withColumn("pcr_rate", F.round("pcr_rate", 9))


@query("SELECT rec_no, qname FROM fx_barcoded WHERE (rec_no * 7919 + rec_no // 13) % 2 = 0", "fx_barcoded")
def hash_split(spark, sf_dir):
    return D.half(views.barcoded(spark, sf_dir), 0).select("rec_no", "qname")


@query("SELECT chrom, pos5 AS start, pos5 + 1 AS \"end\", CASE WHEN strand = 1 THEN -n_unique ELSE n_unique END AS value FROM places", "places")
def strand_bedgraph(spark, sf_dir):
    return D.strand_track(D.occurrences(views.barcoded(spark, sf_dir)))


CTE["sites"] = "SELECT chrom, pos5 AS pos, strand, n_unique AS n, CASE WHEN strand = 1 THEN -n_unique ELSE n_unique END AS v, row_number() OVER (PARTITION BY chrom ORDER BY pos5, strand) AS rn, count(*) OVER (PARTITION BY chrom) AS c FROM places"


@query("SELECT s.chrom, s.pos, s.strand, CAST(CASE WHEN s.rn = 1 OR s.rn = s.c THEN 0 ELSE coalesce((SELECT sum(v) FROM sites l WHERE l.chrom = s.chrom AND l.rn BETWEEN greatest(2, s.rn - 21) AND s.rn AND l.pos >= s.pos - 10), 0) - coalesce((SELECT sum(v) FROM sites r WHERE r.chrom = s.chrom AND r.rn BETWEEN s.rn + 1 AND s.rn + 21 AND r.pos <= s.pos + 10), 0) END AS BIGINT) AS score FROM sites s", "sites")
def slide_score(spark, sf_dir):
    p = D.occurrences(views.barcoded(spark, sf_dir)).select("chrom", F.col("pos5").alias("pos"), "strand", F.col("n_unique").alias("n"))
    return E.sliding_score(p, 10)


def sites(spark, sf_dir):
    return D.occurrences(views.barcoded(spark, sf_dir)).select("chrom", F.col("pos5").alias("pos"), "strand", F.col("n_unique").alias("n"))


CTE |= {
    "site_scores": "SELECT s.chrom, s.pos, s.strand, s.rn - 1 AS i, s.c, CASE WHEN s.rn = 1 OR s.rn = s.c THEN 0 ELSE coalesce((SELECT sum(v) FROM sites l WHERE l.chrom = s.chrom AND l.rn BETWEEN greatest(2, s.rn - 21) AND s.rn AND l.pos >= s.pos - 10), 0) - coalesce((SELECT sum(v) FROM sites r WHERE r.chrom = s.chrom AND r.rn BETWEEN s.rn + 1 AND s.rn + 21 AND r.pos <= s.pos + 10), 0) END AS score FROM sites s",
    "site_windows": "SELECT *, least(greatest(min(i) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 10 PRECEDING AND CURRENT ROW), 1), i) AS lo, max(i) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 10 FOLLOWING) AS hi, max(score * 1000000000 + 999999999 - i) OVER (PARTITION BY chrom ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m FROM site_scores",
    "opens": "SELECT w.chrom, w.i, w.c, p.score AS top, p.i AS at, p.lo, p.hi FROM site_windows w JOIN site_windows p ON p.chrom = w.chrom AND p.i = 999999999 - w.m % 1000000000 WHERE w.score >= 3",
    "opens_next": "SELECT *, min(i) OVER (PARTITION BY chrom ORDER BY i RANGE BETWEEN (hi - i + 1) FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM opens",
    "chain": "SELECT chrom, min(i) AS i FROM opens GROUP BY chrom UNION ALL SELECT o.chrom, o.following FROM chain JOIN opens_next o USING (chrom, i) WHERE o.following IS NOT NULL",
    "peaks1": "SELECT o.*, coalesce((SELECT min(i) FROM site_windows k WHERE k.chrom = o.chrom AND k.i >= o.lo AND k.i < o.hi AND k.score > 0.9::DOUBLE * o.top), -1) AS above FROM chain JOIN opens o USING (chrom, i) WHERE o.i + 10 < o.c",
    "peaks2": "SELECT *, CASE WHEN above < 0 THEN lo ELSE above END AS first, CASE WHEN above < 0 THEN hi ELSE coalesce((SELECT min(i) - 1 FROM site_windows k WHERE k.chrom = p.chrom AND k.i > p.above AND k.i < p.hi AND k.score < 0.9::DOUBLE * p.top), hi) END AS last FROM peaks1 p",
    "peaks3": "SELECT *, (p0 + p1) // 2 AS mid FROM (SELECT *, (SELECT pos FROM site_windows k WHERE k.chrom = p.chrom AND k.i = p.first) AS p0, (SELECT pos FROM site_windows k WHERE k.chrom = p.chrom AND k.i = p.last) AS p1 FROM peaks2 p)",
    "peaks4": "SELECT *, coalesce((SELECT max(i) FROM site_windows k WHERE k.chrom = p.chrom AND k.i >= p.first AND k.i < p.last AND abs(p.mid - k.pos) < p.mid - p.p0), first) AS centre FROM peaks3 p",
    "candidates": "SELECT chrom, (SELECT pos FROM site_windows k WHERE k.chrom = p.chrom AND k.i = p.centre) AS pos, (SELECT strand FROM site_windows k WHERE k.chrom = p.chrom AND k.i = p.centre) AS strand, CAST(top AS BIGINT) AS score, (SELECT pos FROM site_windows k WHERE k.chrom = p.chrom AND k.i = p.lo) AS start, (SELECT pos FROM site_windows k WHERE k.chrom = p.chrom AND k.i = p.hi) AS \"end\", p1 - p0 AS width FROM peaks4 p",
}


@query("SELECT * FROM candidates", "candidates")
def forward_candidates(spark, sf_dir):
    """Peaks along a chain of opening sites; the SQL walks it recursively."""
    return C.forward_candidates(sites(spark, sf_dir), 10, 3)


@query("SELECT width, count(*) AS n FROM candidates GROUP BY width", "candidates")
def candidate_widths(spark, sf_dir):
    return C.width_histogram(C.forward_candidates(sites(spark, sf_dir), 10, 3))


@query('SELECT k.pos - p.pos AS "offset", CAST(sum(k.score) AS BIGINT) AS score FROM candidates p JOIN site_scores k ON k.chrom = p.chrom AND k.pos BETWEEN greatest(p.start, p.pos - 10) AND least(p."end", p.pos + 10) GROUP BY 1', "candidates site_scores")
def candidate_profile(spark, sf_dir):
    return C.score_profile(C.forward_candidates(sites(spark, sf_dir), 10, 3), sites(spark, sf_dir), 10, 10)


CTE["wide"] = "SELECT a.pos - b.pos AS d, a.chrom, a.rn, a.v, b.rn AS brn, b.v AS bv FROM sites a JOIN sites b ON a.chrom = b.chrom AND a.rn <> b.rn AND abs(a.pos - b.pos) <= 5"
CTE["halves"] = "SELECT CAST(h AS INTEGER) AS half, CAST((SELECT sum(CASE WHEN s.rn = 1 OR s.rn = s.c THEN 0 ELSE s.v + coalesce((SELECT sum(CASE WHEN w.brn < s.rn THEN CASE WHEN w.brn > 1 THEN w.bv ELSE 0 END ELSE -w.bv END) FROM wide w WHERE w.chrom = s.chrom AND w.rn = s.rn AND abs(w.d) <= h), 0) END) FROM sites s) AS BIGINT) AS score FROM range(1, 6) t(h)"


@query("SELECT half, score FROM halves", "halves")
def width_profile(spark, sf_dir):
    return C.width_profile(sites(spark, sf_dir), range(1, 6))


@query("SELECT length AS fragment_length FROM qld WHERE chip > 0 ORDER BY chip DESC, length LIMIT 1", "qld")
def correlation_length(spark, sf_dir):
    d = G.pair_length_distribution(chip(spark, sf_dir), ctrl(spark, sf_dir), STEPS)
    return C.correlation_length(d.select(F.col("length").alias("row"), F.col("chip").alias("value")))


@query("SELECT CASE WHEN coalesce(demux, 0) = 0 THEN 'unidentified' ELSE barcode END AS sample, count(*) AS n_reads FROM demuxed LEFT JOIN fx_barcodes ON demux = barcode_id GROUP BY 1", "demuxed fx_barcodes")
def reads_per_output(spark, sf_dir):
    d = R.demultiplex(views.reads(spark, sf_dir), barcodes(spark), 3)
    names = barcodes(spark).select(F.col("barcode_id").alias("demux"), F.col("barcode").alias("sample"))
    return d.join(F.broadcast(names), "demux", "left").groupBy(F.coalesce("sample", F.lit("unidentified")).alias("sample")).agg(F.count("*").alias("n_reads"))


CTE |= {
    "pc1": "SELECT * FROM (SELECT read_no, id, CASE WHEN length(seq) > 1 THEN substr(seq, 2) ELSE '' END AS seq, CASE WHEN length(seq) > 1 THEN substr(qual, 2) ELSE '' END AS qual FROM fx_reads) WHERE length(seq) >= 5",
    "pc2": "SELECT * FROM pc1 WHERE length(seq) - length(replace(seq, 'N', '')) <= 3",
    "pc3": "SELECT read_no, id, CASE WHEN demux > 0 THEN substr(seq, 4) ELSE seq END AS seq, CASE WHEN demux > 0 THEN substr(qual, 4) ELSE qual END AS qual, demux FROM (SELECT r.*, CAST(coalesce(b, 0) AS INTEGER) AS demux FROM pc2 r LEFT JOIN (SELECT barcode, min(barcode_id) AS b FROM fx_barcodes GROUP BY 1) k ON k.barcode = substr(seq, 1, 3) WHERE length(seq) > 3)",
    # what follows the last quality of at least 20 goes
    "pc4": "SELECT * FROM (SELECT read_no, CASE WHEN k < length(seq) THEN id || ':QT' ELSE id END AS id, substr(seq, 1, k) AS seq, substr(qual, 1, k) AS qual, demux FROM (SELECT *, length(regexp_replace(qual, '[!-4]*$', '')) AS k FROM pc3)) WHERE length(seq) >= 5",
    "pc5": "SELECT *, length(seq) > 0 AS live FROM pc4",
}
strip_ctes("pc6", "pc5")
CHAIN = TrimParams(trim_left=1, min_length=5, uncalled=3, quality=20, quality_min_length=5)


@query(f"SELECT r.read_no, {tagged('r.id', 'x.removed')} AS id, x.seq, x.qual, r.demux, CAST(x.removed AS BIGINT) AS removed FROM pc5 r JOIN pc6 x USING (read_no)", "pc5 pc6")
def preprocess_chain(spark, sf_dir):
    """All stages over all reads."""
    return PR.preprocess(views.reads(spark, sf_dir), CHAIN, barcodes(spark), adapters(spark)).select("read_no", "id", "seq", "qual", "demux", F.col("removed").cast("long").alias("removed"))


@query("SELECT * FROM (VALUES ('pre_trim', (SELECT count(*) FROM fx_reads) - (SELECT count(*) FROM pc1)), ('uncalled', (SELECT count(*) FROM pc1) - (SELECT count(*) FROM pc2)), ('demultiplex', (SELECT count(*) FROM pc2) - (SELECT count(*) FROM pc3)), ('quality', (SELECT count(*) FROM pc3) - (SELECT count(*) FROM pc4)), ('adapters', 0), ('kept', (SELECT count(*) FROM pc4))) t(reason, n_reads)", "fx_reads pc1 pc2 pc3 pc4")
def drop_statistics(spark, sf_dir):
    return PR.drop_statistics(views.reads(spark, sf_dir), CHAIN, barcodes(spark), adapters(spark))


@query(ORACLES["narrowpeak"])
def peak_caller(spark, sf_dir):
    """The whole caller with a control, the fragment length given."""
    run = PP.call_peaks(views.hits(spark, sf_dir), views.chroms(spark), PeakParams(fragment_length=(Q_MIN + Q_MAX) // 2), views.control(spark, sf_dir))
    return run.narrow_peak().withColumns({"log_p": log_p(), "log_q": log_p("q_value")}).drop("p_value", "q_value")


def _nexus_ctes(lo: int, hi: int) -> None:
    """The pieces from pairs to counts for hits with their repeats and other distances, under names that begin with nx_."""
    import re

    names = ("pairs", "deltas", "cov", "raws", "refs", "runs", "folded", "allmerged", "merged", "c3")
    to = {"hits": "fx_hits", **{n: f"nx_{n}" for n in names}}
    numbers = {str(Q_MIN): str(lo), str(Q_MAX): str(hi), str(Q_MAX - 1): str(hi - 1)}
    for n in names:
        text = re.sub(rf"\b({'|'.join(to)})\b", lambda m: to[m[0]], CTE[n])
        CTE[f"nx_{n}"] = re.sub(rf"\b({'|'.join(numbers)})\b", lambda m: numbers[m[0]], text)
    CTE["nx_c1"] = f"SELECT DISTINCT s.chrom, s.pos AS s FROM nx_merged s JOIN nx_pairs p ON s.chrom = p.chrom AND p.f_pos > s.pos - {hi} AND p.f_pos < s.pos AND p.r_pos >= s.pos"
    CTE["nx_c2"] = f"SELECT s.chrom, s.pos AS s, count(DISTINCT f_pos) + count(DISTINCT r_pos) AS taken FROM nx_merged s JOIN nx_pairs p ON s.chrom = p.chrom AND p.f_pos > s.pos - {hi} AND p.f_pos < s.pos AND p.r_pos > s.pos AND p.r_pos < p.f_pos + {hi} GROUP BY 1, 2"
    CTE["nx_ev"] = f"SELECT m.chrom, m.s AS pos, coalesce(kfu_chip + kfd_chip + kru_chip + krd_chip, 0) AS k, coalesce(taken, 0) / {2 * hi}.0::DOUBLE AS saturation FROM nx_c1 m LEFT JOIN nx_c2 USING (chrom, s) LEFT JOIN nx_c3 USING (chrom, s)"
    CTE["nx_lam"] = f"SELECT chrom, 4.0::DOUBLE * count(*) * {hi} / 200000 AS rate FROM fx_hits GROUP BY chrom"
    CTE["nx_tail"] = "SELECT chrom, k, coalesce(sum(exp(l)) OVER (PARTITION BY chrom ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_value FROM (SELECT chrom, k, sum(r) OVER (PARTITION BY chrom ORDER BY k) AS l FROM (SELECT chrom, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END AS r FROM nx_lam, range(0, (SELECT max(k) FROM nx_ev) + 201) t(k)))"
    CTE["nx_qv"] = "SELECT *, p_value * n / rn AS q_value FROM (SELECT e.*, p_value, row_number() OVER (ORDER BY p_value, e.chrom, e.pos) AS rn, count(*) OVER () AS n FROM nx_ev e JOIN nx_tail t ON t.chrom = e.chrom AND t.k = e.k)"


_nexus_ctes(15, 25)


@query(f"SELECT chrom, greatest(0, pos - 15) AS start, least(200000, pos + 15) AS \"end\", '.' AS name, CAST(round(saturation * 1000) AS BIGINT) AS score, '.' AS strand, round(k, 6) AS signal, {log_p_sql('p_value')} AS log_p, {log_p_sql('q_value')} AS log_q, 15 AS peak FROM nx_qv", "nx_qv")
def peak_caller_nexus(spark, sf_dir):
    """The whole caller without a control, hits with their repeats, probabilities of each chromosome's Poisson."""
    run = PP.call_peaks(views.hits(spark, sf_dir), views.chroms(spark), PeakParams(fragment_length=20, nexus=True))
    return run.narrow_peak().withColumns({"log_p": log_p(), "log_q": log_p("q_value"), "signal": F.col("signal").cast("double")}).drop("p_value", "q_value")


CTE["chance"] = f"SELECT chrom, CAST(round({2 * Q_MAX} * (1 - exp(-2 * (count(*) FILTER (strand = 0) / 200000.0::DOUBLE * (1 - exp(-{Q_MAX - Q_MIN}.0::DOUBLE * count(*) FILTER (strand = 1) / 200000.0::DOUBLE)))))) AS BIGINT) AS least FROM hits GROUP BY chrom"


@query("SELECT ev.chrom, ev.pos, least AS n_expected FROM ev JOIN chance USING (chrom) WHERE q_beg_chip > 0 AND q_end_chip > 0 AND least <= q_beg_chip + q_end_chip", "ev chance")
def expected_saturation(spark, sf_dir):
    """Summits with as many taken positions as chance would give, by the counts of their chromosome."""
    kept = E.expected_saturation(evaluated(spark, sf_dir), chip(spark, sf_dir), views.chroms(spark), Q_MIN, Q_MAX)
    return kept.select("chrom", "pos", "n_expected")


@query('SELECT rate, CAST("unique" AS BIGINT) + CAST(non_unique AS BIGINT) AS n_places, round(non_unique / ("unique" + non_unique)::DOUBLE, 9) AS artifact_ratio FROM (' + ORACLES["dup_histogram"] + ') WHERE rate <= 50 AND "unique" + non_unique > 0')
def artifact_ratio(spark, sf_dir):
    """The share of artefacts at each duplication rate up to 50."""
    return D.artifact_ratio(D.duplication_histogram(D.occurrences(views.barcoded(spark, sf_dir)))).withColumn("artifact_ratio", F.round("artifact_ratio", 9))
