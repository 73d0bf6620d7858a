"""The same statistics as ANSI SQL, for checking the queries in another engine."""

from __future__ import annotations

import math

from tamperscope.functions.stats import ALPHA_HIGH, ALPHA_MODERATE, ERFC_COEFFICIENTS
from tamperscope.model import MECHANISM
from tamperscope.plans import datasets, gates


def erfc(x: str) -> str:
    """Complementary error function of a non-negative column."""
    poly = repr(ERFC_COEFFICIENTS[-1])
    t = f"(1.0/(1.0+0.5*{x}))"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({poly}*{t}+({c!r}))"
    return f"({t}*exp(-({x})*({x})+{poly}))"


def z_to_p(z: str) -> str:
    return erfc(f"(abs({z})/{math.sqrt(2.0)!r})")


def normal_cdf(z: str) -> str:
    tail = f"(0.5*{z_to_p(z)})"
    return f"(CASE WHEN ({z})>=0 THEN 1-{tail} ELSE {tail} END)"


def chi2_sf(x: str, df: int) -> str:
    h = f"(({x})/2.0)"
    if df % 2 == 0:
        terms = "+".join(["1.0"] + [f"pow({h},{k})/{float(math.factorial(k))!r}" for k in range(1, df // 2)])
        p = f"exp(-{h})*({terms})"
    else:
        p = erfc(f"sqrt({h})") + "".join(
            f"+exp(-{h})*pow({h},{k + 0.5})/{math.gamma(k + 1.5)!r}" for k in range((df - 1) // 2))
    return f"(CASE WHEN ({x})<=0 THEN 1.0 ELSE least(1.0,{p}) END)"


def digits_of(x: str) -> str:
    """Plain decimal text without trailing zeros."""
    return f"regexp_replace(regexp_replace(CAST(CAST(abs({x}) AS DECIMAL(18,6)) AS VARCHAR),'0+$',''),'\\.$','')"


EV = """ev AS (SELECT row_number() OVER (ORDER BY ts,event_id)-1 row_idx, event_type cond, user_id, value x FROM events)"""

ORD = """l4 AS (SELECT l_orderkey k, l_extendedprice x, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 r FROM lineitem),
wide AS (SELECT k, r//4 part, max(CASE WHEN r%4=0 THEN x END) v0, max(CASE WHEN r%4=1 THEN x END) v1,
  max(CASE WHEN r%4=2 THEN x END) v2, max(CASE WHEN r%4=3 THEN x END) v3 FROM l4 GROUP BY k, r//4),
sheet AS (SELECT row_number() OVER (ORDER BY o_orderdate,o_orderkey,part)-1 row_idx, o_orderpriority cond, v0,v1,v2,v3,
  (CASE WHEN v0 IS NULL THEN 0 ELSE 1 END)+(CASE WHEN v1 IS NULL THEN 0 ELSE 1 END)
  +(CASE WHEN v2 IS NULL THEN 0 ELSE 1 END)+(CASE WHEN v3 IS NULL THEN 0 ELSE 1 END) nv
  FROM wide JOIN orders ON k=o_orderkey),
cell AS (SELECT row_idx,cond,nv,0 col,v0 x FROM sheet WHERE v0 IS NOT NULL UNION ALL
  SELECT row_idx,cond,nv,1,v1 FROM sheet WHERE v1 IS NOT NULL UNION ALL
  SELECT row_idx,cond,nv,2,v2 FROM sheet WHERE v2 IS NOT NULL UNION ALL
  SELECT row_idx,cond,nv,3,v3 FROM sheet WHERE v3 IS NOT NULL),
rowstat AS (SELECT row_idx,cond,nv,(coalesce(v0,0)+coalesce(v1,0)+coalesce(v2,0)+coalesce(v3,0))/nv m, v0,v1,v2,v3 FROM sheet),
rowvar AS (SELECT *, (coalesce((v0-m)*(v0-m),0)+coalesce((v1-m)*(v1-m),0)+coalesce((v2-m)*(v2-m),0)
  +coalesce((v3-m)*(v3-m),0))/greatest(nv-1,1) v FROM rowstat),
pair AS (SELECT a.row_idx,a.cond,a.col c1,b.col c2,a.x a,b.x b,a.x-b.x d,
  row_number() OVER (PARTITION BY a.col,b.col ORDER BY a.row_idx)-1 pos
  FROM cell a JOIN cell b ON a.row_idx=b.row_idx AND a.col<b.col)"""

LINES = """lines AS (SELECT row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,
  l_quantity,l_discount,l_tax,l_shipdate)-1 row_idx, l_quantity v0, CAST(l_linenumber AS DOUBLE) v1, l_discount v2,
  l_tax v3 FROM lineitem),
cell AS (SELECT row_idx,0 col,v0 x FROM lines UNION ALL SELECT row_idx,1,v1 FROM lines UNION ALL
  SELECT row_idx,2,v2 FROM lines UNION ALL SELECT row_idx,3,v3 FROM lines)"""

EMB = """emb AS (SELECT row_number() OVER (ORDER BY vec_id)-1 row_idx, CAST(label AS VARCHAR) cond,
  [CAST(x AS DOUBLE) FOR x IN embedding] vals FROM embeddings),
cell AS (SELECT row_idx,cond,unnest(range(len(vals))) col,unnest(vals) x FROM emb)"""

KEY = "CAST(floor(x*10000.0+0.5) AS BIGINT)"

#: Runs that recur over 200 rows away, of the cells fc (col, i, x): windows of
#: fk.k rows meet their nearest earlier occurrence, and the runs found so are
#: stretched row by row.
FAR = f"""fk AS (SELECT col, CAST(least(greatest(3, ceil(ln(greatest((sum(c)-1)/2.0,1))/-ln(sum(c*c*1.0)/(sum(c)*sum(c)))-1e-9)),4096) AS BIGINT) k
  FROM (SELECT col,{KEY} v,count(*) c FROM fc GROUP BY 1,2) GROUP BY col HAVING count(*)>1),
fw AS (SELECT w.col, i, k, l[1:k] g FROM (SELECT col,i,list(x) OVER (PARTITION BY col ORDER BY i ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) l FROM fc) w
  JOIN fk ON w.col=fk.col WHERE len(l)>=k AND len(list_distinct(l[1:k]))>1),
fs AS (SELECT col, k, i, i-lag(i) OVER (PARTITION BY col,g ORDER BY i) d FROM fw),
fl AS (SELECT DISTINCT col, d, i-d s, i-d+k-1 e, i-d lo FROM fs WHERE d>200 UNION ALL
  SELECT fl.col, d, s, e, lo-1 FROM fl JOIN fc a ON a.col=fl.col AND a.i=lo-1 JOIN fc b ON b.col=fl.col AND b.i=lo-1+d WHERE abs(a.x-b.x)=0),
fr AS (SELECT DISTINCT col, d, s, e, e hi FROM (SELECT DISTINCT col,d,s,e FROM fl) UNION ALL
  SELECT fr.col, d, s, e, hi+1 FROM fr JOIN fc a ON a.col=fr.col AND a.i=hi+1 JOIN fc b ON b.col=fr.col AND b.i=hi+1+d WHERE abs(a.x-b.x)=0),
far AS (SELECT DISTINCT l.col col, l.d d, l.lo lo, r.hi hi FROM (SELECT col,d,s,e,min(lo) lo FROM fl GROUP BY 1,2,3,4) l
  JOIN (SELECT col,d,s,e,max(hi) hi FROM fr GROUP BY 1,2,3,4) r ON l.col=r.col AND l.d=r.d AND l.s=r.s AND l.e=r.e)"""


def _benford(source: str, position: int, probs: list[float], low: int, dof: int) -> str:
    digits = "regexp_replace(replace(t,'.',''),'^0+','')"
    if position == 1:
        digit = f"CAST(substr({digits},1,1) AS INTEGER)"
    else:
        digit = f"(CASE WHEN length({digits})<2 THEN 0 ELSE CAST(substr({digits},2,1) AS INTEGER) END)"
    table = ",".join(f"({low + i},CAST({p!r} AS DOUBLE))" for i, p in enumerate(probs))
    return f"""WITH src AS ({source}), txt AS (SELECT x, {digits_of('x')} t FROM src WHERE x<>0),
dig AS (SELECT {digit} d FROM txt), prob(d,p) AS (VALUES {table}),
cnt AS (SELECT prob.d, p, count(dig.d) c FROM prob LEFT JOIN dig ON dig.d=prob.d GROUP BY prob.d,p),
tot AS (SELECT CAST(sum(c) AS DOUBLE) n FROM cnt),
lg AS (SELECT log10(abs(x)) l, row_number() OVER (ORDER BY abs(x))-1 i, count(*) OVER () m FROM src WHERE x<>0),
sp AS (SELECT max(CASE WHEN i=CAST(floor(m*0.95) AS BIGINT) THEN l END)-max(CASE WHEN i=CAST(floor(m*0.05) AS BIGINT) THEN l END) span FROM lg),
fit AS (SELECT n, sum((c-n*p)*(c-n*p)/(n*p)) chi, avg(abs(c*1.0/n-p)) mad FROM cnt, tot GROUP BY n)
SELECT cnt.d AS digit, cnt.c AS observed, CAST(n AS BIGINT) AS n, round(chi,6) AS chi2, round(mad,9) AS mad,
  round({chi2_sf('chi', dof)},9) AS p_chi2, round(span,6) AS span FROM cnt, fit, sp"""


FIRST = [math.log10(1 + 1 / d) for d in range(1, 10)]
SECOND = [sum(math.log10(1 + 1 / (10 * d + k)) for d in range(1, 10)) for k in range(10)]


def _terminal(group: str) -> str:
    """Last-digit chi-squared per group of events."""
    counts = ",".join(f"sum(CASE WHEN ld={d} THEN 1 ELSE 0 END) d{d}" for d in range(10))
    chi10 = "+".join(f"(d{d}-n/10.0)*(d{d}-n/10.0)/(n/10.0)" for d in range(10))
    chi9 = "+".join(f"(d{d}-(n-d0)/9.0)*(d{d}-(n-d0)/9.0)/((n-d0)/9.0)" for d in range(1, 10))
    return f"""{EV}, ld AS (SELECT {group} g, x, CAST(right({digits_of('x')},1) AS INTEGER) ld FROM ev),
cnt AS (SELECT g, count(*) n, sum(CASE WHEN x=floor(x) THEN 1 ELSE 0 END) ni, {counts} FROM ld GROUP BY g),
chi AS (SELECT *, (d0 < 0.4*n/10.0) stripped, {chi10} chi10, {chi9} chi9 FROM cnt),
res AS (SELECT g, n, ni, CASE WHEN stripped THEN chi9 ELSE chi10 END chi, CASE WHEN stripped THEN 8.0 ELSE 9.0 END df,
  CASE WHEN stripped THEN {chi2_sf('chi9', 8)} ELSE {chi2_sf('chi10', 9)} END p FROM chi),
verdict AS (SELECT *, CASE WHEN n<50 THEN 'tooFewRows' WHEN ni*1.0/n>0.95 THEN 'dataTypeMismatch' END cause FROM res),
flagged AS (SELECT *, CASE WHEN cause IS NOT NULL THEN 'N/A' WHEN p<0.001 THEN 'HIGH' WHEN p<0.01 THEN 'MODERATE' ELSE 'LOW' END flag FROM verdict)"""


def _flag(p: str) -> str:
    return f"CASE WHEN {p}<0.001 THEN 'HIGH' WHEN {p}<0.01 THEN 'MODERATE' ELSE 'LOW' END"


def _spike() -> str:
    def scan(sheet: str, kind: str, src: str, half: int, skip: str) -> str:
        return f"""SELECT '{sheet}' sheet, '{kind}' kind, g.key, coalesce(f.obs,0) obs, nb.n_near, nb.s/nb.n_near smoothed
FROM (SELECT unnest(range((SELECT min(key) FROM {src}),(SELECT max(key) FROM {src})+1)) AS key) g
LEFT JOIN {src} f ON f.key=g.key JOIN (SELECT g2.key, least(g2.key+{half},mx)-greatest(g2.key-{half},mn) n_near,
  coalesce(sum(f2.obs),0)*1.0 s FROM (SELECT unnest(range((SELECT min(key) FROM {src}),(SELECT max(key) FROM {src})+1)) AS key) g2
  CROSS JOIN (SELECT min(key) mn, max(key) mx FROM {src}) LEFT JOIN {src} f2 ON f2.key BETWEEN g2.key-{half} AND g2.key+{half} AND f2.key<>g2.key
  GROUP BY g2.key,mx,mn) nb ON nb.key=g.key {skip}"""

    frac = "regexp_extract(t,'\\.(\\d+)$',1)"
    return f"""WITH q AS (SELECT CAST(l_quantity AS BIGINT) AS key, count(*) obs FROM lineitem GROUP BY 1), {EV},
t AS (SELECT {digits_of('x')} t FROM ev), fr AS (SELECT {frac} f FROM t WHERE t LIKE '%.%'),
e1 AS (SELECT CAST(f AS BIGINT) AS key, count(*) obs FROM fr WHERE length(f)=1 GROUP BY 1),
e2 AS (SELECT CAST(f AS BIGINT) AS key, count(*) obs FROM fr WHERE length(f)=2 GROUP BY 1),
allk AS ({scan('quantity', 'full', 'q', 3, 'WHERE g.key<>0')} UNION ALL {scan('events', 'digit', 'e2', 3, '')})
SELECT sheet, kind, key, obs, n_near, round(smoothed,6) AS smoothed,
  round(CASE WHEN smoothed>0 THEN obs/smoothed ELSE 0.0 END,6) AS ratio
FROM allk WHERE n_near>=2 AND NOT (smoothed<0.5 AND obs<3)"""


def _autocorrelation() -> str:
    lags = ",".join(f"lag(e,{k}) OVER (PARTITION BY c1,c2 ORDER BY pos) l{k}" for k in range(1, 11))
    sums = ",".join(f"coalesce(sum(e*l{k}),0)/sum(e*e) r{k}" for k in range(1, 11))
    rounds = ",".join(f"round(r{k},8) AS r{k}" for k in range(1, 11))
    return f"""WITH {ORD}, m AS (SELECT c1,c2,avg(d) mu,count(*) n FROM pair GROUP BY c1,c2),
e AS (SELECT pair.c1,pair.c2,pos,n,d-mu e FROM pair JOIN m ON pair.c1=m.c1 AND pair.c2=m.c2),
l AS (SELECT *,{lags} FROM e), s AS (SELECT c1,c2,n,{sums} FROM l GROUP BY c1,c2,n)
SELECT c1,c2,n,{rounds},round({z_to_p('(r1*sqrt(n))')},7) AS p FROM s WHERE n>=10"""


def _runs(source: str, unit: str, extra: str = "") -> str:
    return f"""nz AS (SELECT {unit}, s, lag(s) OVER (PARTITION BY {unit} ORDER BY o) ps FROM ({source}) WHERE s<>0),
rc AS (SELECT {unit}, sum(CASE WHEN s>0 THEN 1 ELSE 0 END)*1.0 np, sum(CASE WHEN s<0 THEN 1 ELSE 0 END)*1.0 nm,
  1+sum(CASE WHEN ps IS NOT NULL AND ps<>s THEN 1 ELSE 0 END) runs FROM nz GROUP BY {unit}),
rz AS (SELECT *, 2*np*nm/(np+nm)+1 er, 2*np*nm*(2*np*nm-(np+nm))/((np+nm)*(np+nm)*((np+nm)-1)) vr FROM rc{extra}),
z AS (SELECT *, (runs-er)/sqrt(vr) z FROM rz WHERE vr>0)"""


def _windows(width: int, stride: int, total: str) -> str:
    return f"""win AS (SELECT i AS w, i*{stride} AS s FROM (SELECT unnest(range(0,(SELECT CAST(floor(({total}-{width})/{stride}.0) AS BIGINT)+1))) i))"""


def _mixed_gates() -> str:
    """Rule and minimum tables as VALUES, first cause by rank."""
    def values(rows) -> str:
        return ",".join("(" + ",".join(f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

    ruled = [(t, f"data type {k}", "dataTypeMismatch", 0) for k, tests in gates.DATA_TYPE_SKIP.items() for t in tests]
    ruled += [(t, "columns are conditions", "columnsNotReplicates", 1) for t in gates.REPLICATES_ONLY]
    ruled += [(t, "row order arbitrary", "rowOrderArbitrary", 2) for t in gates.ORDERED_ONLY]
    ruled += [(t, "subjects shared", "subjectsSharedAcrossConditions", 3) for t in gates.UNPAIRED_ONLY]
    least = [(t, m, float(v), gates._CAUSE[m], 10 + i) for t, need in gates.MINIMA.items() for i, (m, v) in enumerate(need.items())]
    measures = ",".join(f"('{m}',CAST({m} AS DOUBLE))" for m in gates._CAUSE)
    return f"""WITH {EV}, {ORD}, c AS (SELECT CAST(user_id AS VARCHAR) ds, cond, x FROM ev UNION ALL SELECT 'orders', cond, x FROM cell),
r AS (SELECT CAST(user_id AS VARCHAR) ds, count(*) n_rows, 1 n_cols, count(DISTINCT cond) n_conditions, 0 n_missing FROM ev GROUP BY 1 UNION ALL
  SELECT 'orders', count(*), 4, count(DISTINCT cond), sum(4-nv) FROM sheet),
v AS (SELECT ds, count(*) n_values, sum(CASE WHEN x<>floor(x) THEN 1 ELSE 0 END) n_decimal FROM c GROUP BY ds),
lg AS (SELECT ds, log10(abs(x)) l, row_number() OVER (PARTITION BY ds ORDER BY abs(x))-1 i, count(*) OVER (PARTITION BY ds) m FROM c WHERE x<>0),
sp AS (SELECT ds, CASE WHEN max(m)<10 THEN max(l)-min(l) ELSE max(CASE WHEN i=CAST(floor(m*0.95) AS BIGINT) THEN l END)
  -max(CASE WHEN i=CAST(floor(m*0.05) AS BIGINT) THEN l END) END span FROM lg GROUP BY ds),
s AS (SELECT r.ds ds, n_rows, n_cols, n_conditions, n_missing, n_values, n_decimal, span, n_rows*1.0/n_cols rows_per_col,
  CASE WHEN r.ds='orders' THEN 0 ELSE TRY_CAST(r.ds AS BIGINT)%5 END k FROM r JOIN v ON r.ds=v.ds LEFT JOIN sp ON r.ds=sp.ds),
f AS (SELECT ds, unnest([CASE k WHEN 0 THEN 'data type ordinal' WHEN 1 THEN 'data type count' ELSE 'data type continuous' END,
  CASE WHEN k=2 THEN 'columns are conditions' END, CASE WHEN k IN (1,2) THEN 'row order arbitrary' END, CASE WHEN k=3 THEN 'subjects shared' END]) fact FROM s),
t(test,mechanism) AS (VALUES {values(MECHANISM.items())}), rl(test,fact,cause,rank) AS (VALUES {values(ruled)}),
mn(test,measure,least,cause,rank) AS (VALUES {values(least)}),
ms AS (SELECT ds, p.measure measure, p.v v FROM s, LATERAL (VALUES {measures}) p(measure,v)),
hit AS (SELECT ds,test,rank,cause,NULL::DOUBLE observed,NULL::DOUBLE least FROM f JOIN rl ON f.fact=rl.fact UNION ALL
  SELECT ds,test,rank,cause,v,CAST(least AS DOUBLE) FROM ms JOIN mn ON ms.measure=mn.measure WHERE coalesce(v,0)<least),
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY ds,test ORDER BY rank)=1)
SELECT s.ds AS dataset_id,t.test AS test,mechanism,cause IS NULL AS runs,cause AS na_cause,round(observed,6) AS na_observed,least AS na_minimum
FROM s CROSS JOIN t LEFT JOIN one ON one.ds=s.ds AND one.test=t.test"""


def _flag(p: str) -> str:
    return f"(CASE WHEN {p}<{ALPHA_HIGH} THEN 'HIGH' WHEN {p}<{ALPHA_MODERATE} THEN 'MODERATE' ELSE 'LOW' END)"


def _stepped(source: str, p: str, family: str = "") -> str:
    """Benjamini-Hochberg: every p with its step-up value ``adj``."""
    fam = f"PARTITION BY {family} " if family else ""
    return f"""SELECT *, least(1.0, min({p}*m/r) OVER ({fam}ORDER BY {p} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) adj
  FROM (SELECT *, count(*) OVER ({fam.strip()}) m, count(*) OVER ({fam}ORDER BY {p} RANGE UNBOUNDED PRECEDING) r FROM {source})"""


def _verdict_sql(dataset: str, test: str, flag: str, p: str, source: str) -> str:
    return (f"SELECT '{dataset}' AS dataset_id, 'all' AS grp, '{test}' AS test, {flag} AS flag, round(CAST({p} AS DOUBLE),9) AS primary_p, "
            f"CAST(NULL AS VARCHAR) AS na_cause, 'closed form' AS null_method FROM {source}")


def _t5(t: str) -> str:
    """Two-sided p of Student's t with five degrees of freedom, in closed form."""
    a = f"atan(abs({t})/sqrt(5.0))"
    return f"(1-2/pi()*({a}+sin({a})*cos({a})*(1+2.0/3.0*cos({a})*cos({a}))))"


def _verdicts(o: dict[str, str]) -> None:
    """Whole verdicts of tests whose p is a closed form, built on the statistics' SQL."""
    seq = o["sequential_duplication"].rsplit("\nSELECT r.d AS d", 1)[0]
    chances = "greatest(1.0, m*(n-h+1)-m*(m+1)/2.0)"
    o["sequential_duplication_verdict"] = f"""{seq}, sz AS (SELECT count(*) n FROM lines),
hh AS (SELECT sum(c*c*1.0)/(sum(c)*sum(c)) hhi FROM (SELECT {KEY} v, count(*) c FROM fc GROUP BY 1)),
v_every AS (SELECT r.d d, lo, hi, h, CASE WHEN n>500 THEN least(n-1,200) ELSE n-1 END reach FROM r, sz UNION ALL SELECT d, lo, hi, hi-lo+1, n-1 FROM far, sz),
v_priced AS (SELECT least(1.0, pow(hhi,h)*{chances}) p FROM (SELECT e.h h, n, hhi, greatest(0, least(reach, n-e.h))*1.0 m
  FROM v_every e JOIN ch a ON a.i=e.lo JOIN ch b ON b.i=e.hi, sz, hh WHERE b.cs-a.cs>0)),
best AS (SELECT coalesce(min(p),1.0) p FROM v_priced)
{_verdict_sql("l_quantity", "Sequential Duplication", _flag("p"), "p", "best")}"""

    acf = o["pair_autocorrelation"].rsplit("\nSELECT c1,c2,n,", 1)[0]
    o["autocorrelation_verdict"] = f"""{acf}, v_g AS (SELECT * FROM s WHERE n>=10), v_one AS (SELECT {z_to_p('(r1*sqrt(n))')} p, r1 FROM v_g),
v_best AS (SELECT min(adj) p FROM ({_stepped("v_one", "p")})), v_size AS (SELECT count(*)>=500 big FROM sheet),
v_lags AS (SELECT unnest([1,2,3,4,5]) k, unnest([r1,r2,r3,r4,r5]) r, n FROM v_g),
v_sig AS (SELECT k, sum(CASE WHEN adj<0.05 THEN 1 ELSE 0 END) ns FROM ({_stepped(f"(SELECT k, {z_to_p('(r*sqrt(n))')} p FROM v_lags WHERE k>1)", "p")}) GROUP BY k),
v_pool AS (SELECT k, mean, {_t5("(mean/(sd/sqrt(6.0)))")} p FROM (SELECT k, avg(r) mean, stddev_samp(r) sd FROM v_lags GROUP BY k)),
v_adj AS ({_stepped("v_pool", "p")}),
v_high AS (SELECT bool_or(v_adj.k>1 AND v_adj.adj<{ALPHA_HIGH} AND NOT (big AND abs(mean)<0.25) AND coalesce(ns,0)>=2) higher, max(CASE WHEN v_adj.k=1 THEN mean END) m1
  FROM v_adj LEFT JOIN v_sig ON v_sig.k=v_adj.k CROSS JOIN v_size),
v_f AS (SELECT p, CASE WHEN big AND abs(m1)<0.25 THEN 'LOW' ELSE {_flag("p")} END base, p<{ALPHA_HIGH} OR higher lifted FROM v_best, v_high, v_size)
{_verdict_sql("orders", "Autocorrelation", "CASE WHEN base='HIGH' THEN base WHEN lifted THEN 'MODERATE' ELSE base END", "p", "v_f")}"""

    rho = o["rank_correlation"].rsplit("\nSELECT a,b,count(*) AS n", 1)[0]
    o["rank_correlation_verdict"] = f"""{rho}, v_r AS (SELECT a, b, count(*) n, greatest(least(corr(rx,ry),0.9999),-0.9999) r FROM k GROUP BY a, b),
v_z AS (SELECT a, b, n, 0.5*ln((1+r)/(1-r)) fz FROM v_r), v_t AS (SELECT sum(fz) s, count(*) c, min_by(n, a||'|'||b) n0 FROM v_z),
v_q AS (SELECT (fz-(s-fz)/(c-1))/(sqrt(c*1.0/(c-1))/sqrt(greatest(n0-3,1))) z FROM v_z, v_t),
v_p AS (SELECT CASE WHEN z>0 THEN 0.5*{z_to_p('z')} ELSE 1.0 END p FROM v_q), v_b AS (SELECT min(adj) p FROM ({_stepped("v_p", "p")}))
{_verdict_sql("orders", "Cross-Condition Rank Correlation", f"CASE WHEN p<{ALPHA_MODERATE} THEN 'MODERATE' ELSE 'LOW' END", "p", "v_b")}"""

    far = o["mahalanobis_rows"].rsplit("\nSELECT row_idx,n,", 1)[0]
    o["mahalanobis_verdict"] = f"""{far}, v_d AS (SELECT n, a*a+b*b+c*c+e*e d2 FROM z3),
v_t AS (SELECT max(n) n, count(*) FILTER (d2>13.276704135987622) x FROM v_d),
v_u AS (SELECT count(*) k FROM (SELECT q, row_number() OVER (ORDER BY q) r FROM (SELECT {chi2_sf('d2', 4)} q FROM v_d)), v_t WHERE q*n/r<0.001),
v_f AS (SELECT n, x, k, (x-n*0.01)/sqrt(n*0.01*0.99) z FROM v_t, v_u),
v_g AS (SELECT *, CASE WHEN z>0 THEN 0.5*{z_to_p('z')} ELSE 1.0 END p FROM v_f)
{_verdict_sql("orders", "Mahalanobis Row Outlier", f"CASE WHEN k=0 OR x*1.0/n<0.02 THEN 'LOW' ELSE {_flag('p')} END", "p", "v_g")}"""

    dec = o["decimal_precision"].rsplit("\nSELECT g.dp AS dp", 1)[0]
    terms = "exp(lgamma(tot+1)-lgamma(j+1)-lgamma(tot-j+1)+j*ln(q)+(tot-j)*ln(1-q))"
    o["decimal_precision_verdict"] = f"""{dec}, v_lv AS (SELECT g.dp dp, coalesce(c,0) c, CAST(tot AS BIGINT) tot, 0.9*pow(0.1,mx-g.dp) q, mx FROM g CROSS JOIN m LEFT JOIN d ON d.dp=g.dp),
v_tl AS (SELECT dp, sum({terms}) p FROM (SELECT *, unnest(range(0,c+1)) j FROM v_lv WHERE dp<mx AND (SELECT count(*) FROM d)>1) GROUP BY dp),
best AS (SELECT coalesce(min(adj),1.0) p FROM ({_stepped("v_tl", "p")}))
{_verdict_sql("events", "Decimal Precision Consistency", _flag("p"), "p", "best")}"""


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["benford_first"] = _benford("SELECT value x FROM events", 1, FIRST, 1, 8)
    o["benford_second"] = _benford("SELECT l_extendedprice x FROM lineitem", 2, SECOND, 0, 9)
    o["terminal_digit"] = f"""WITH {_terminal('user_id')} SELECT CAST(g AS VARCHAR) AS dataset_id, flag,
  CASE WHEN cause IS NULL THEN round(p,9) END AS p, CAST(n AS DOUBLE) AS n, round(chi,6) AS chi2, df, cause AS na_cause FROM flagged"""
    o["decimal_precision"] = f"""WITH {EV}, t AS (SELECT {digits_of('x')} t FROM ev),
d AS (SELECT length(split_part(t,'.',2)) dp, count(*) c FROM t WHERE t LIKE '%.%' GROUP BY 1),
m AS (SELECT max(dp) mx, sum(c) tot FROM d), g AS (SELECT unnest(range(1,(SELECT mx FROM m)+1)) dp)
SELECT g.dp AS dp, coalesce(c,0) AS observed, CAST(tot AS BIGINT) AS total,
  round(0.9*pow(0.1,mx-g.dp)*tot,6) AS expected FROM g CROSS JOIN m LEFT JOIN d ON d.dp=g.dp"""
    o["value_spike"] = _spike()
    o["value_collisions"] = f"""WITH {EV}, f AS (SELECT {KEY} k, count(*) c FROM ev GROUP BY 1),
t AS (SELECT {digits_of('x')} t FROM ev), p AS (SELECT CASE WHEN t LIKE '%.%' THEN length(split_part(t,'.',2)) ELSE 0 END dp, count(*) c FROM t GROUP BY 1),
md AS (SELECT dp FROM p ORDER BY c DESC, dp LIMIT 1)
SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, sum(c*(c-1)/2.0) AS colliding_pairs,
  sum(CASE WHEN c>=3 THEN 1 ELSE 0 END) AS over_represented, round(sum(c*c*1.0)/(sum(c)*sum(c)),12) AS hhi,
  (SELECT dp FROM md) AS modal_dp FROM f"""
    o["duplicate_rows"] = f"""WITH {LINES} SELECT min(row_idx) AS first_row, max(row_idx) AS last_row, count(*) AS n_copies
FROM lines GROUP BY floor(v0*10000.0+0.5),floor(v1*10000.0+0.5),floor(v2*10000.0+0.5),floor(v3*10000.0+0.5) HAVING count(*)>=2"""
    o["within_row_matches"] = f"""WITH {LINES}, b AS (SELECT row_idx, CAST(floor((row_number() OVER (ORDER BY (((0.0+v0)+v1)+v2+v3)/4,row_idx)-1)/30) AS BIGINT) bin FROM lines),
c AS (SELECT bin, cell.row_idx, col, x, {KEY} k FROM cell JOIN b ON b.row_idx=cell.row_idx),
pr AS (SELECT p.bin, p.col c1, q.col c2, count(*) nv, sum(CASE WHEN p.x=q.x THEN 1 ELSE 0 END) hits
  FROM c p JOIN c q ON p.row_idx=q.row_idx AND p.col<q.col GROUP BY 1,2,3),
n AS (SELECT bin,col,count(*) n FROM c GROUP BY 1,2), f AS (SELECT bin,col,k,count(*) f FROM c GROUP BY 1,2,3),
s AS (SELECT f.bin,f.col,k,f*1.0/n s FROM f JOIN n ON f.bin=n.bin AND f.col=n.col),
ov AS (SELECT p.bin,p.col c1,q.col c2,sum(p.s*q.s) pm FROM s p JOIN s q ON p.bin=q.bin AND p.k=q.k AND p.col<q.col GROUP BY 1,2,3),
br AS (SELECT bin,count(*) nr FROM b GROUP BY 1)
SELECT pr.bin AS bin, nr AS n_rows, CAST(sum(nv) AS BIGINT) AS n_pairs, CAST(sum(hits) AS BIGINT) AS matches,
  round(sum(CASE WHEN nr>=2 THEN nv*coalesce(pm,0) ELSE 0 END),6) AS expected
FROM pr JOIN br ON br.bin=pr.bin LEFT JOIN ov ON ov.bin=pr.bin AND ov.c1=pr.c1 AND ov.c2=pr.c2 GROUP BY pr.bin,nr"""
    o["column_concentration"] = f"""WITH {LINES}, f AS (SELECT col,{KEY} k,count(*) c FROM cell GROUP BY 1,2)
SELECT col, CAST(sum(c) AS BIGINT) AS n_col, round(sum(c*c*1.0)/(sum(c)*sum(c)),9) AS hhi, round(sum(c*c*1.0)/(sum(c)*sum(c)),9) AS row_hhi FROM f GROUP BY col"""
    o["sequential_duplication"] = f"""WITH RECURSIVE {LINES}, fc AS (SELECT 0 col, row_idx i, v0 x FROM lines), {FAR}, q AS (SELECT row_idx i, v0 x, lag(v0) OVER (ORDER BY row_idx) px FROM lines),
ch AS (SELECT i, x, sum(CASE WHEN px IS NOT NULL AND px<>x THEN 1 ELSE 0 END) OVER (ORDER BY i) cs FROM q),
m AS (SELECT a.i, b.i-a.i d FROM ch a JOIN ch b ON a.x=b.x AND b.i>a.i AND b.i<=a.i+200),
g AS (SELECT d, i, i-row_number() OVER (PARTITION BY d ORDER BY i) g FROM m),
r AS (SELECT d, min(i) lo, max(i) hi, count(*) h FROM g GROUP BY d,g HAVING count(*)>=3)
SELECT r.d AS d, lo, hi, h AS height, CAST(e.cs-s.cs AS BIGINT) AS changes
FROM (SELECT d,lo,hi,h FROM r UNION ALL SELECT d,lo,hi,hi-lo+1 FROM far) r JOIN ch s ON s.i=r.lo JOIN ch e ON e.i=r.hi WHERE e.cs-s.cs>0"""
    eq = lambda c: f"(a.{c}=b.{c})"
    mask = "+".join(f"(CASE WHEN {eq(f'v{k}')} THEN {2 ** k} ELSE 0 END)" for k in range(4))
    width = "+".join(f"(CASE WHEN {eq(f'v{k}')} THEN 1 ELSE 0 END)" for k in range(4))
    names = "||','||".join(f"CASE WHEN (mask//{2 ** k})%2=1 THEN '{k}' ELSE '' END" for k in range(4))
    o["block_copies"] = f"""WITH RECURSIVE {LINES}, fc AS (SELECT col, row_idx i, x FROM cell), {FAR},
fp AS (SELECT d, cut, lead(cut) OVER (PARTITION BY d ORDER BY cut)-1 t FROM (SELECT d,lo cut FROM far UNION SELECT d,hi+1 FROM far)),
fh AS (SELECT p.d, cut, t, string_agg(col,',' ORDER BY col) cols, count(*) w FROM fp p JOIN far ON p.d=far.d AND far.lo<=cut AND far.hi>=t
  WHERE t IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>=2),
fn AS (SELECT *, CASE WHEN lag(t) OVER o=cut-1 THEN 0 ELSE 1 END nw FROM fh WINDOW o AS (PARTITION BY d,cols ORDER BY cut)),
fb AS (SELECT d,cols,w,min(cut) lo,max(t) hi FROM (SELECT *, sum(nw) OVER (PARTITION BY d,cols ORDER BY cut) z FROM fn) GROUP BY d,cols,w,z),
two AS (SELECT a.row_idx i, b.row_idx-a.row_idx d, {mask} mask, {width} w
  FROM lines a JOIN lines b ON b.row_idx>a.row_idx AND b.row_idx<=a.row_idx+200 AND a.v3=b.v3 UNION ALL
  SELECT a.row_idx i, b.row_idx-a.row_idx d, {mask} mask, {width} w
  FROM lines a JOIN lines b ON b.row_idx>a.row_idx AND b.row_idx<=a.row_idx+200 AND a.v2=b.v2 AND a.v3<>b.v3 UNION ALL
  SELECT a.row_idx i, b.row_idx-a.row_idx d, {mask} mask, {width} w
  FROM lines a JOIN lines b ON b.row_idx>a.row_idx AND b.row_idx<=a.row_idx+200 AND a.v1=b.v1 AND a.v0=b.v0 AND a.v2<>b.v2 AND a.v3<>b.v3),
g AS (SELECT d, mask, w, i, i-row_number() OVER (PARTITION BY d,mask ORDER BY i) g FROM two WHERE w>=2),
r AS (SELECT d, mask, w, min(i) lo, max(i) hi, count(*) h FROM g GROUP BY d,mask,w,g)
SELECT d, trim(regexp_replace({names},',+',',','g'),',') AS cols, lo, hi, h AS height FROM r WHERE h>=2 AND w<4 AND h*w>=6
UNION ALL SELECT d, cols, lo, hi, hi-lo+1 FROM fb WHERE hi>lo AND w<4 AND (hi-lo+1)*w>=6"""
    o["column_streaks"] = f"""WITH {LINES}, e AS (SELECT p.row_idx i, p.col c1, q.col c2 FROM cell p JOIN cell q ON p.row_idx=q.row_idx AND p.col<q.col AND p.x=q.x),
g AS (SELECT c1,c2,i,i-row_number() OVER (PARTITION BY c1,c2 ORDER BY i) g FROM e)
SELECT c1||','||c2 AS cols, min(i) AS lo, max(i) AS hi, count(*) AS height FROM g GROUP BY c1,c2,g HAVING count(*)>=3"""
    o["partial_rows"] = f"""WITH {ORD}, f AS (SELECT count(*) c FROM sheet WHERE nv=4 GROUP BY v0,v1,v2,v3)
SELECT coalesce(sum(c*(c-1)/2.0),0.0) AS n_pairs, sum(CASE WHEN c>=2 THEN 1 ELSE 0 END) AS n_groups FROM f"""
    o["constant_offset"] = f"""WITH {LINES}, low AS (SELECT col FROM cell GROUP BY col HAVING min(x)>0),
p AS (SELECT p.row_idx i,p.col c1,q.col c2,p.x a,q.x b FROM cell p JOIN cell q ON p.row_idx=q.row_idx AND p.col<q.col),
k AS (SELECT 'additive' kind,c1,c2,i,floor((a-b)*10000.0+0.5) d FROM p UNION ALL
  SELECT 'multiplicative',c1,c2,i,floor((ln(a)-ln(b))*10000.0+0.5) FROM p WHERE c1 IN (SELECT col FROM low) AND c2 IN (SELECT col FROM low)),
s AS (SELECT *, lag(d) OVER (PARTITION BY kind,c1,c2 ORDER BY i) pd, lag(i) OVER (PARTITION BY kind,c1,c2 ORDER BY i) pi FROM k),
t AS (SELECT kind,c1,c2,count(*) n, sum(CASE WHEN pi=i-1 THEN 1 ELSE 0 END) steps, sum(CASE WHEN pi=i-1 AND pd=d AND d<>0 THEN 1 ELSE 0 END) blocks FROM s GROUP BY 1,2,3),
f AS (SELECT kind,c1,c2,sum(c*(c-1.0)) cc FROM (SELECT kind,c1,c2,d,count(*) c FROM k WHERE d<>0 GROUP BY 1,2,3,4) GROUP BY 1,2,3)
SELECT t.kind AS kind,t.c1 AS c1,t.c2 AS c2,n,CAST(steps AS BIGINT) AS steps,CAST(blocks AS BIGINT) AS blocks,round(steps*coalesce(cc,0)/(n*(n-1.0)),3) AS expected
FROM t LEFT JOIN f ON t.kind=f.kind AND t.c1=f.c1 AND t.c2=f.c2"""
    o["pair_autocorrelation"] = _autocorrelation()
    o["windowed_autocorrelation"] = f"""WITH {ORD}, n AS (SELECT c1,c2,count(*) n FROM pair GROUP BY 1,2),
w AS (SELECT pair.c1,pair.c2,CAST(pos/5 AS BIGINT)-o w0,pos,d,row_idx FROM pair, (VALUES (0),(1),(2)) t(o)),
v AS (SELECT w.c1,w.c2,w0 w,pos,d,row_idx FROM (SELECT c1,c2,CAST(floor(pos/5.0) AS BIGINT)-o w0,pos,d,row_idx FROM pair, (VALUES (0),(1),(2)) t(o)) w
  JOIN n ON w.c1=n.c1 AND w.c2=n.c2 WHERE w0>=0 AND w0*5+14>=pos AND w0*5+15<=n),
m AS (SELECT *, avg(d) OVER (PARTITION BY c1,c2,w) mu, lag(d) OVER (PARTITION BY c1,c2,w ORDER BY pos) pd FROM v)
SELECT c1,c2,w,round(sum(coalesce((d-mu)*(pd-mu),0))/sum((d-mu)*(d-mu)),7) AS r,min(row_idx) AS row_lo,max(row_idx) AS row_hi FROM m GROUP BY c1,c2,w"""
    o["runs_test"] = f"""WITH {ORD}, {_runs('SELECT c1,c2,row_idx o,sign(d) s FROM pair', 'c1,c2', ' WHERE np>0 AND nm>0 AND np+nm>=10')}
SELECT c1,c2,CAST(np AS BIGINT) AS n_pos,CAST(nm AS BIGINT) AS n_neg,CAST(runs AS BIGINT) AS runs,round(er,6) AS expected,round(z,6) AS z,round({z_to_p('z')},7) AS p FROM z"""
    o["row_mean_runs"] = f"""WITH {ORD}, y AS (SELECT cond,row_idx,m y,row_number() OVER (PARTITION BY cond ORDER BY row_idx)-1 x FROM rowstat),
f AS (SELECT cond,regr_slope(y,x) b,avg(y) my,avg(x) mx,count(*) n FROM y GROUP BY cond),
{_runs('SELECT y.cond,row_idx o,sign(y-(my+b*(x-mx))) s FROM y JOIN f ON y.cond=f.cond WHERE n>=10', 'cond', ' WHERE np>0 AND nm>0 AND np+nm>=8')}
SELECT cond,CAST(np AS BIGINT) AS n_pos,CAST(nm AS BIGINT) AS n_neg,CAST(runs AS BIGINT) AS runs,round(z,6) AS z,round({z_to_p('z')},7) AS p FROM z"""
    o["noise_scaling"] = f"""WITH {ORD}, p AS (SELECT row_idx,ln(m) lm,ln(v) lv,m FROM rowvar WHERE nv>=3 AND m>0 AND v>0),
f AS (SELECT count(*) n,regr_slope(lv,lm) slope,regr_sxx(lv,lm) sxx,regr_syy(lv,lm) syy,regr_sxy(lv,lm) sxy,log10(max(m))-log10(min(m)) reach FROM p),
b AS (SELECT lm,lv,least(floor((row_number() OVER (ORDER BY lm,row_idx)-1)/floor(n/least(10,floor(n/5.0)))),least(10,floor(n/5.0))-1) blk FROM p,f),
g AS (SELECT blk,count(*) n,regr_slope(lv,lm) s,greatest(regr_syy(lv,lm)-regr_sxy(lv,lm)*regr_sxy(lv,lm)/regr_sxx(lv,lm),0)/((count(*)-2)*regr_sxx(lv,lm)) sv FROM b GROUP BY blk HAVING count(*)>=4),
q AS (SELECT count(*) used,sum(s/sv)/sum(1/sv) ctr FROM g WHERE sv>0), qq AS (SELECT used,sum((s-ctr)*(s-ctr)/sv) q,stddev_samp(s) sds FROM g,q WHERE sv>0 GROUP BY used)
SELECT n,round(slope,6) AS slope,round(sqrt(greatest(syy-sxy*sxy/sxx,0)/((n-2)*sxx)),6) AS se,round(reach,6) AS mean_range,used AS blocks_used,round(q,3) AS q,
  round(CASE WHEN {chi2_sf('q', 9)}<0.05 THEN sds/sqrt(used) END,5) AS block_se FROM f,qq"""
    o["selective_noise"] = f"""WITH {ORD}, e AS (SELECT c.row_idx,c.cond,c.col,c.x-r.m e FROM cell c JOIN rowstat r ON c.row_idx=r.row_idx),
g AS (SELECT 'all' grp,row_idx,col,e FROM e UNION ALL SELECT cond,row_idx,col,e FROM e),
v AS (SELECT grp,col,count(*) n,var_samp(e) v FROM g GROUP BY 1,2 HAVING count(*)>=5),
s AS (SELECT grp,sum(n) n,count(*) k,max(v) mx,min(v) mn,sum((n-1)*v) ss,sum((n-1)*ln(v)) ln_,sum(1.0/(n-1)) inv FROM v GROUP BY grp)
SELECT grp,CAST(n AS BIGINT) AS n_cells,k,round(mx/mn,6) AS ratio,round(((n-k)*ln(ss/(n-k))-ln_)/(1+(inv-1.0/(n-k))/(3.0*(k-1))),5) AS bartlett FROM s"""
    o["column_levene"] = f"""WITH {ORD}, e AS (SELECT c.col,c.x-r.m e FROM cell c JOIN rowstat r ON c.row_idx=r.row_idx WHERE c.nv=4),
t AS (SELECT t,CASE WHEN col=t THEN 1 ELSE 0 END own,e FROM e,(VALUES (0),(1),(2),(3)) v(t)),
m AS (SELECT t,own,median(e) md,var_samp(e) v FROM t GROUP BY 1,2),
z AS (SELECT t.t,t.own,abs(e-md) z,v FROM t JOIN m ON t.t=m.t AND t.own=m.own),
s AS (SELECT t,own,count(*) n,avg(z) mz,var_pop(z) vz,max(v) v FROM z GROUP BY 1,2),
w AS (SELECT a.t,a.n n1,b.n n2,a.mz m1,b.mz m2,a.vz p1,b.vz p2,a.v v1,b.v v2 FROM s a JOIN s b ON a.t=b.t AND a.own=1 AND b.own=0),
g AS (SELECT *,(m1*n1+m2*n2)/(n1+n2) gm FROM w)
SELECT t AS col,n1+n2 AS n,round((n1*(m1-gm)*(m1-gm)+n2*(m2-gm)*(m2-gm))/((p1*n1+p2*n2)/(n1+n2-2)),5) AS f,
  CASE WHEN v1>v2 THEN 'noisier' WHEN v1<v2 THEN 'quieter' ELSE 'equal' END AS direction FROM g"""
    o["within_row_variance"] = f"""WITH {ORD}, s AS (SELECT m,sqrt(v) sd,row_number() OVER (ORDER BY m,row_idx)-1 o,count(*) OVER () n FROM rowvar WHERE nv>=3),
k AS (SELECT *,greatest(5,least(20,floor(n/10.0))) nb FROM s), b AS (SELECT *,CAST(least(floor(o/floor(n/nb)),nb-1) AS BIGINT) bin FROM k),
c AS (SELECT bin,count(*) n_bin,median(m) mm,median(sd) ms FROM b GROUP BY bin)
SELECT c.bin AS bin,n_bin,round(mm,4) AS mid_mean,round(ms,4) AS mid_sd,round(median(abs(sd-ms)),4) AS mad_sd FROM b JOIN c ON b.bin=c.bin GROUP BY c.bin,n_bin,mm,ms"""
    o["regional_noise"] = f"""WITH {ORD}, fit AS (SELECT regr_slope(ln(v),ln(m)) b,avg(ln(m)) mx,avg(ln(v)) my FROM rowvar WHERE nv>=2 AND m>0 AND v>0),
z AS (SELECT row_idx,row_number() OVER (ORDER BY row_idx)-1 pos,m,exp((my+b*(ln(m)-mx))/2) sg,v0,v1,v2,v3 FROM rowvar,fit WHERE nv=4),
e AS (SELECT row_idx,pos,0 col,(v0-m)/sg e FROM z UNION ALL SELECT row_idx,pos,1,(v1-m)/sg FROM z UNION ALL SELECT row_idx,pos,2,(v2-m)/sg FROM z UNION ALL SELECT row_idx,pos,3,(v3-m)/sg FROM z),
g AS (SELECT col,var_samp(e) gv,count(*) n FROM e GROUP BY col),
w AS (SELECT e.col,CAST(floor(pos/5.0) AS BIGINT)-o w,pos,row_idx,e FROM e,(VALUES (0),(1),(2)) t(o)),
v AS (SELECT w.col,w,var_samp(e) wv,max(gv) gv,min(row_idx) lo,max(row_idx) hi FROM w JOIN g ON g.col=w.col WHERE w>=0 AND w*5+14>=pos AND w*5+15<=n GROUP BY w.col,w)
SELECT w,col,lo AS row_lo,hi AS row_hi,round(greatest(wv/gv,gv/wv),5) AS ratio FROM v"""
    profile = """prof AS (SELECT p.row_idx,avg(abs(p.d)) y FROM pair p GROUP BY p.row_idx),
y AS (SELECT row_idx,y,row_number() OVER (ORDER BY row_idx)-1 x,count(*) OVER () n FROM prof)"""
    o["changepoint"] = f"""WITH {ORD}, {profile}, d AS (SELECT row_idx,x,sum(y-(SELECT avg(y) FROM prof)) OVER (ORDER BY x) cs FROM y),
b AS (SELECT * FROM d ORDER BY abs(cs) DESC,x LIMIT 1)
SELECT (SELECT count(*) FROM prof) AS n,round(abs(cs),2) AS max_cusum,row_idx AS row_at,round((SELECT stddev_samp(y) FROM prof),4) AS sd FROM b"""
    o["loess_cusum"] = f"""WITH {ORD}, {profile},
tg AS (SELECT x t,y ty,row_idx,n,CASE WHEN x<25 THEN 49-x WHEN x>=n-25 THEN 49-(n-1-x) ELSE 25 END h FROM y),
nb AS (SELECT t,ty,tg.row_idx,tg.n,a.x,a.y,pow(1-pow(abs(a.x-t)*1.0/h,3),3) w FROM tg JOIN y a ON a.x BETWEEN t-49 AND t+49 AND abs(a.x-t)<h
  AND (CASE WHEN t<25 THEN a.x<50 WHEN t>=tg.n-25 THEN a.x>=tg.n-50 ELSE true END)),
s AS (SELECT t,max(ty) ty,max(row_idx) row_idx,max(n) n,sum(w) w,sum(w*(x-t)) wx,sum(w*y) wy,sum(w*(x-t)*(x-t)) wxx,sum(w*(x-t)*y) wxy FROM nb GROUP BY t),
r AS (SELECT t,row_idx,n,ty-(wy-((w*wxy-wx*wy)/(w*wxx-wx*wx))*wx)/w e FROM s),
g AS (SELECT var_samp(e) gv FROM r), ww AS (SELECT CAST(floor(t/6.0) AS BIGINT)-o w,t,row_idx,n,e FROM r,(VALUES (0),(1),(2),(3)) q(o)),
v AS (SELECT w,var_samp(e) wv,min(row_idx) lo,max(row_idx) hi FROM ww WHERE w>=0 AND w*6+19>=t AND w*6+20<=n GROUP BY w)
SELECT w,lo AS row_lo,hi AS row_hi,round(greatest(wv/gv,gv/wv),5) AS ratio FROM v,g"""
    o["replicate_correlation"] = f"""WITH {ORD}, q AS (SELECT cond,c1,c2,a,b,row_number() OVER (PARTITION BY cond,c1,c2 ORDER BY a)-1 ia,
  row_number() OVER (PARTITION BY cond,c1,c2 ORDER BY b)-1 ib,count(*) OVER (PARTITION BY cond,c1,c2) n FROM pair),
bd AS (SELECT cond,c1,c2,n,max(CASE WHEN ia=CAST(floor(0.05*n) AS BIGINT) THEN a END) al,max(CASE WHEN ia=CAST(ceil(0.95*n)-1 AS BIGINT) THEN a END) ah,
  max(CASE WHEN ib=CAST(floor(0.05*n) AS BIGINT) THEN b END) bl,max(CASE WHEN ib=CAST(ceil(0.95*n)-1 AS BIGINT) THEN b END) bh FROM q GROUP BY 1,2,3,4),
r AS (SELECT q.cond,q.c1,q.c2,q.n,corr(least(greatest(a,al),ah),least(greatest(b,bl),bh)) r FROM q JOIN bd ON q.cond=bd.cond AND q.c1=bd.c1 AND q.c2=bd.c2 WHERE q.n>=6 GROUP BY 1,2,3,4),
o AS (SELECT *,(sum(r) OVER (PARTITION BY cond)-r)/(count(*) OVER (PARTITION BY cond)-1) oth,count(*) OVER (PARTITION BY cond) k FROM r)
SELECT cond,c1,c2,n,round(r,7) AS r,round(oth,7) AS others,round((0.5*ln((1+r)/(1-r))-0.5*ln((1+oth)/(1-oth)))/(sqrt(k*1.0/(k-1))/sqrt(n-3)),5) AS z FROM o"""
    o["excess_kurtosis"] = f"""WITH {ORD}, m AS (SELECT c1,c2,avg(d) mu,stddev_samp(d) sd,count(*) n FROM pair GROUP BY 1,2),
k AS (SELECT p.c1,p.c2,n,sum(pow((d-mu)/sd,4))/n-3 k FROM pair p JOIN m ON p.c1=m.c1 AND p.c2=m.c2 GROUP BY 1,2,3)
SELECT c1,c2,n,round(k,6) AS kurtosis,round(k/sqrt(24.0/n),5) AS z FROM k WHERE n>=20"""
    o["entropy"] = f"""WITH {EV}, t AS (SELECT cond,x,{digits_of('x')} t FROM ev),
p AS (SELECT cond,CASE WHEN t LIKE '%.%' THEN length(split_part(t,'.',2)) ELSE 0 END dp,count(*) c FROM t GROUP BY 1,2),
md AS (SELECT cond,dp FROM (SELECT *,row_number() OVER (PARTITION BY cond ORDER BY c DESC,dp) r FROM p) WHERE r=1),
f AS (SELECT t.cond,dp,floor(x*pow(10.0,dp)+0.5) k,count(*) c FROM t JOIN md ON t.cond=md.cond GROUP BY 1,2,3)
SELECT cond,dp AS prec,CAST(sum(c) AS BIGINT) AS n,count(*) AS n_distinct,round(log2(sum(c))-sum(c*log2(c))/sum(c),7) AS entropy FROM f GROUP BY cond,dp"""
    o["column_gof"] = f"""WITH {EMB}, m AS (SELECT cond,col,count(*) n,avg(x) mu,stddev_samp(x) sd,count(DISTINCT x) nd FROM cell GROUP BY 1,2),
mm AS (SELECT c.cond,c.col,sum(pow(x-mu,3))/max(n) m3,sum(pow(x-mu,4))/max(n) m4,sum(pow(x-mu,2))/max(n) m2 FROM cell c JOIN m ON c.cond=m.cond AND c.col=m.col GROUP BY 1,2),
s AS (SELECT c.cond,c.col,n,(x-mu)/sd z,row_number() OVER (PARTITION BY c.cond,c.col ORDER BY x) i FROM cell c JOIN m ON c.cond=m.cond AND c.col=m.col WHERE n>=30 AND nd>=10),
f AS (SELECT *,greatest(1e-6,least(1-1e-6,{normal_cdf('z')})) f FROM s),
a AS (SELECT cond,col,n,-n-sum((2*i-1)*ln(f)+(2*n+1-2*i)*ln(1-f))/n a2 FROM f GROUP BY 1,2,3)
SELECT a.cond AS cond,a.col AS col,n,round(m3/pow(m2,1.5),6) AS skew,round(m4/(m2*m2)-3,6) AS kurt,round(a2,5) AS a2 FROM a JOIN mm ON a.cond=mm.cond AND a.col=mm.col"""
    cov = ",".join(f"covar_samp(v{i},v{j}) s{i}{j}" for i in range(4) for j in range(i, 4))
    o["mahalanobis_rows"] = f"""WITH {ORD}, f AS (SELECT row_idx,v0,v1,v2,v3 FROM sheet WHERE nv=4),
s AS (SELECT count(*) n,avg(v0) m0,avg(v1) m1,avg(v2) m2,avg(v3) m3,{cov} FROM f),
l AS (SELECT *,sqrt(s00) l00,s01/sqrt(s00) l10,s02/sqrt(s00) l20,s03/sqrt(s00) l30 FROM s),
l2 AS (SELECT *,sqrt(s11-l10*l10) l11,(s12-l20*l10)/sqrt(s11-l10*l10) l21,(s13-l30*l10)/sqrt(s11-l10*l10) l31 FROM l),
l3 AS (SELECT *,sqrt(s22-l20*l20-l21*l21) l22,(s23-l30*l20-l31*l21)/sqrt(s22-l20*l20-l21*l21) l32 FROM l2),
l4c AS (SELECT *,sqrt(s33-l30*l30-l31*l31-l32*l32) l33 FROM l3),
z0 AS (SELECT row_idx,n,(v0-m0)/l00 a,v1-m1 d1,v2-m2 d2,v3-m3 d3,l10,l20,l30,l11,l21,l31,l22,l32,l33 FROM f,l4c),
z1 AS (SELECT *,(d1-l10*a)/l11 b FROM z0), z2 AS (SELECT *,(d2-l20*a-l21*b)/l22 c FROM z1), z3 AS (SELECT *,(d3-l30*a-l31*b-l32*c)/l33 e FROM z2)
SELECT row_idx,n,round(a*a+b*b+c*c+e*e,6) AS d2 FROM z3"""
    o["residual_spike"] = f"""WITH {ORD}, y AS (SELECT row_idx,cond,nv,m,CASE WHEN nv>=2 THEN (coalesce(abs(v0-m),0)+coalesce(abs(v1-m),0)+coalesce(abs(v2-m),0)+coalesce(abs(v3-m),0))/nv END mar,
  row_number() OVER (PARTITION BY cond ORDER BY row_idx)-1 pos FROM rowstat),
n AS (SELECT min(c) nr FROM (SELECT cond,count(*) c FROM y GROUP BY cond)),
z AS (SELECT cond,pos,mar,nr FROM y,n WHERE pos<nr), zz AS (SELECT z.cond,pos,nr,(mar-mu)/sd z FROM z JOIN (SELECT cond,avg(mar) mu,stddev_samp(mar) sd FROM z GROUP BY cond) q ON q.cond=z.cond),
k AS (SELECT *,row_number() OVER (PARTITION BY cond ORDER BY z DESC NULLS LAST,pos)-1 rk,greatest(5,floor(nr*0.10)) tk FROM zz), t AS (SELECT cond,pos FROM k WHERE rk<tk),
g AS (SELECT a.cond a,b.cond b FROM (SELECT DISTINCT cond FROM y) a,(SELECT DISTINCT cond FROM y) b WHERE a.cond<b.cond),
ov AS (SELECT p.cond a,q.cond b,count(*) o FROM t p JOIN t q ON p.pos=q.pos AND p.cond<q.cond GROUP BY 1,2)
SELECT g.a AS a,g.b AS b,nr AS n_rows,CAST(greatest(5,floor(nr*0.10)) AS BIGINT) AS top_k,coalesce(o,0) AS overlap,
  round(greatest(5,floor(nr*0.10))*greatest(5,floor(nr*0.10))/nr,6) AS expected FROM g CROSS JOIN n LEFT JOIN ov ON ov.a=g.a AND ov.b=g.b"""
    o["rank_correlation"] = f"""WITH {ORD}, y AS (SELECT cond,m,row_number() OVER (PARTITION BY cond ORDER BY row_idx) pos FROM rowstat),
p AS (SELECT a.cond a,b.cond b,a.m x,b.m y FROM y a JOIN y b ON a.pos=b.pos AND a.cond<b.cond),
k AS (SELECT a,b,rank() OVER (PARTITION BY a,b ORDER BY x)+(count(*) OVER (PARTITION BY a,b,x)-1)/2.0 rx,
  rank() OVER (PARTITION BY a,b ORDER BY y)+(count(*) OVER (PARTITION BY a,b,y)-1)/2.0 ry FROM p)
SELECT a,b,count(*) AS n,round(corr(rx,ry),8) AS rho FROM k GROUP BY a,b"""
    o["baseline_balance"] = f"""WITH {EMB}, g AS (SELECT col,cond,count(*) n,avg(x) m,var_pop(x) v FROM cell GROUP BY 1,2 HAVING count(*)>=3),
t AS (SELECT col,sum(n*m)/sum(n) gm,sum(n) n,count(*) k,sum(n*v) w FROM g GROUP BY col)
SELECT g.col AS feature,k,CAST(t.n AS BIGINT) AS n,round((sum(g.n*(m-gm)*(m-gm))/(k-1))/(max(w)/(t.n-k)),6) AS f FROM g JOIN t ON g.col=t.col GROUP BY g.col,k,t.n"""
    o["condition_consistency"] = f"""WITH {ORD}, q AS (SELECT cond,count(*) n,quantile_cont(x,0.05) a,quantile_cont(x,0.5) md,quantile_cont(x,0.95) b FROM cell GROUP BY cond),
ad AS (SELECT c.cond,quantile_cont(abs(x-md),0.5) mad FROM cell c JOIN q ON c.cond=q.cond GROUP BY c.cond),
e AS (SELECT c.cond,c.row_idx,c.col,c.x-r.m e FROM cell c JOIN rowstat r ON c.row_idx=r.row_idx WHERE c.nv>=2),
df AS (SELECT cond,sum(nv-1) dof FROM rowstat WHERE nv>=2 GROUP BY cond),
rs AS (SELECT e.cond,sqrt(sum(e*e)/max(dof)) sd,sum(pow(e,4))*count(*)/(sum(e*e)*sum(e*e))-3 k FROM e JOIN df ON df.cond=e.cond GROUP BY e.cond),
lg AS (SELECT cond,col,e,lag(e) OVER (PARTITION BY cond,col ORDER BY row_idx) p FROM e),
lc AS (SELECT cond,col,corr(p,e) r FROM lg WHERE p IS NOT NULL GROUP BY 1,2), lz AS (SELECT cond,avg(0.5*ln((1+r)/(1-r))) z FROM lc GROUP BY cond),
mv AS (SELECT cond,count(*) np,regr_slope(ln(v),ln(m)) s FROM rowvar WHERE nv>=3 AND m>0 AND v>0 GROUP BY cond)
SELECT q.cond AS cond,n,round(b-a,4) AS span,round(mad,4) AS mad,round(sd,4) AS resid_sd,round(k,6) AS resid_kurt,round(z,7) AS lag_z,np AS n_points,round(s,6) AS slope
FROM q JOIN ad ON ad.cond=q.cond JOIN rs ON rs.cond=q.cond JOIN lz ON lz.cond=q.cond JOIN mv ON mv.cond=q.cond"""
    miss = lambda k: f"(CASE WHEN v{k} IS NULL THEN 1 ELSE 0 END)"
    gap_pairs = " UNION ALL ".join(
        f"SELECT {i} c1,{j} c2,sum({miss(i)}*{miss(j)}) a,sum({miss(i)}*(1-{miss(j)})) b,sum((1-{miss(i)})*{miss(j)}) c,sum((1-{miss(i)})*(1-{miss(j)})) d FROM sheet"
        for i in range(4) for j in range(i + 1, 4))
    o["missing_pattern"] = f"""WITH {ORD}, g AS ({gap_pairs}) SELECT c1,c2,CAST(a AS BIGINT) AS both,CAST(b AS BIGINT) AS only1,CAST(c AS BIGINT) AS only2,CAST(d AS BIGINT) AS neither FROM g WHERE a+b>0 AND a+c>0"""
    gap_cond = " UNION ALL ".join(
        f"SELECT {i} col,cond,CAST(sum({miss(i)}) AS BIGINT) missing,CAST(sum(1-{miss(i)}) AS BIGINT) present FROM sheet GROUP BY cond" for i in range(4))
    o["missing_by_condition"] = f"WITH {ORD} {gap_cond}"
    spans = " UNION ALL ".join(
        f"SELECT row_idx i,{i} c1,{j} c2 FROM sheet WHERE " + " AND ".join(f"v{k} IS NULL" for k in range(i, j + 1))
        for i in range(4) for j in range(i + 1, 4))
    rate = ",".join(f"ln(greatest(avg({miss(k)}),1e-10)) q{k}" for k in range(4))
    logp = "+".join(f"(CASE WHEN {k} BETWEEN c1 AND c2 THEN q{k} ELSE 0 END)" for k in range(4))
    o["missing_blocks"] = f"""WITH {ORD}, h AS ({spans}), g AS (SELECT c1,c2,i,i-row_number() OVER (PARTITION BY c1,c2 ORDER BY i) g FROM h),
r AS (SELECT c1,c2,min(i) lo,max(i) hi,count(*) n FROM g GROUP BY c1,c2,g HAVING count(*)>=2), q AS (SELECT count(*) nr,{rate} FROM sheet)
SELECT c1,c2,lo,hi,n AS length,round(least(1.0,exp(n*({logp}))*((nr-n+1)*greatest(1,4-(c2-c1+1)+1))),9) AS p FROM r,q"""

    def vst(name: str, base: str, cell: str, points: str) -> str:
        return f"""SELECT '{name}' dataset_id,(SELECT avg(CASE WHEN x=floor(x) THEN 1.0 ELSE 0 END) FROM {cell}) ish,(SELECT avg(CASE WHEN x>0 THEN 1.0 ELSE 0 END) FROM {cell}) psh,
(SELECT avg(CASE WHEN x<0 THEN 1.0 ELSE 0 END) FROM {cell}) nsh,count(*) np,regr_slope(lv,lm) b,regr_sxx(lv,lm) sxx,regr_syy(lv,lm) syy,regr_sxy(lv,lm) sxy FROM ({points})"""

    def positive_points(cell: str) -> str:
        return (f"SELECT ln(m) lm,ln(v) lv FROM (SELECT row_idx,avg(x) m,var_samp(x) v FROM {cell} WHERE x>0 GROUP BY row_idx HAVING count(*)>=3) WHERE m>0 AND v>0")

    o["vst_choice"] = f"""WITH {ORD}, {EMB.replace('cell AS', 'ecell AS')}, {LINES.replace('cell AS', 'lcell AS')},
t AS ({vst('orders', '', 'cell', positive_points('cell'))} UNION ALL {vst('embeddings', '', 'ecell', positive_points('ecell'))} UNION ALL {vst('lines', '', 'lcell', positive_points('lcell'))}),
u AS (SELECT *,sqrt(greatest(syy-sxy*sxy/sxx,0)/(np-2)/sxx) se FROM t)
SELECT dataset_id,round(ish,6) AS integer_share,round(psh,6) AS positive_share,round(nsh,6) AS negative_share,np AS n_points,round(b,6) AS slope,round(se,6) AS slope_se,
 CASE WHEN ish>0.95 AND b-1.96*se>1 AND psh>0.5 AND nsh<0.1 THEN 'log' WHEN ish>0.95 AND nsh>=0.1 THEN 'raw' WHEN ish>0.95 THEN 'anscombe'
  WHEN b-1.96*se>1 AND psh>0.5 AND nsh<0.1 THEN 'log' ELSE 'raw' END AS transform FROM u"""
    o["group_aggregation"] = f"""WITH {_terminal('cond')}, a AS (SELECT count(*) k,min(p) mp,-2*sum(ln(greatest(p,1e-300))) x FROM flagged WHERE cause IS NULL),
b AS (SELECT k,mp,1-pow(1-mp,k) sp,{chi2_sf('x', 10)} fp FROM a)
SELECT 'events' AS dataset_id,CASE WHEN least(sp,fp)<0.001 THEN 'HIGH' WHEN least(sp,fp)<0.01 THEN 'MODERATE' ELSE 'LOW' END AS flag,
 round(least(sp,fp),8) AS p,round(sp,8) AS sidak_p,round(fp,8) AS fisher_p FROM b"""
    o["severity"] = f"""WITH {_terminal('user_id')} SELECT CAST(g AS VARCHAR) AS dataset_id,CASE WHEN flag='HIGH' THEN 1 ELSE 0 END AS n_high,
 CASE WHEN flag='MODERATE' THEN 1 ELSE 0 END AS n_moderate,CASE WHEN flag IN ('HIGH','MODERATE') THEN 1 ELSE 0 END AS n_mechanisms,
 CASE WHEN flag='HIGH' THEN 2 WHEN flag='MODERATE' THEN 1 ELSE 0 END AS severity FROM flagged"""
    o["coverage"] = f"""WITH {_terminal('user_id')}, dec AS (SELECT user_id,sum(CASE WHEN x<>floor(x) THEN 1 ELSE 0 END) nd FROM ev GROUP BY 1),
f AS (SELECT flagged.g,(CASE WHEN flag='N/A' THEN 0 ELSE 1 END)+(CASE WHEN nd>=30 THEN 1 ELSE 0 END) ran FROM flagged JOIN dec ON dec.user_id=flagged.g)
SELECT CAST(g AS VARCHAR) AS dataset_id,ran,2-ran AS notApplicable,2 AS total FROM f"""
    o["dataset_gates"] = f"""WITH {EV}, s AS (SELECT user_id u,count(*) n,count(DISTINCT cond) nc,sum(CASE WHEN x<>floor(x) THEN 1 ELSE 0 END) nd FROM ev GROUP BY 1),
lg AS (SELECT user_id u,log10(abs(x)) l,row_number() OVER (PARTITION BY user_id ORDER BY abs(x))-1 i,count(*) OVER (PARTITION BY user_id) m FROM ev WHERE x<>0),
sp AS (SELECT u,CASE WHEN max(m)<10 THEN max(l)-min(l) ELSE max(CASE WHEN i=CAST(floor(m*0.95) AS BIGINT) THEN l END)-max(CASE WHEN i=CAST(floor(m*0.05) AS BIGINT) THEN l END) END span FROM lg GROUP BY u)
SELECT CAST(s.u AS VARCHAR) AS dataset_id,n AS n_rows,n AS n_values,nc AS n_conditions,CAST(nd AS BIGINT) AS n_decimal,round(span,6) AS span,
 1+(CASE WHEN n>=4 THEN 1 ELSE 0 END)+(CASE WHEN nc>=2 AND n>=10 THEN 1 ELSE 0 END)+(CASE WHEN n>=100 AND span>=1.5 THEN 1 ELSE 0 END)+(CASE WHEN n>=100 AND span>=1.0 THEN 1 ELSE 0 END)
 +(CASE WHEN n>=50 THEN 1 ELSE 0 END)+(CASE WHEN nd>=30 THEN 1 ELSE 0 END)+(CASE WHEN n>=100 THEN 1 ELSE 0 END)+(CASE WHEN n>=20 THEN 1 ELSE 0 END)+(CASE WHEN n>=30 THEN 1 ELSE 0 END)
 +(CASE WHEN n>=50 THEN 1 ELSE 0 END)+2*(CASE WHEN nc>=2 AND n>=10 THEN 1 ELSE 0 END)+(CASE WHEN nc>=2 AND n>=60 THEN 1 ELSE 0 END) AS n_tests FROM s JOIN sp ON sp.u=s.u"""
    o["mixed_gates"] = _mixed_gates()
    hints = " ".join(f"WHEN assay='{a}' AND ({c}) THEN '{{}}'" for a, _, _, c in datasets.HINTS)
    o["dataset_report"] = f"""WITH {EV}, {ORD}, c AS (SELECT CAST(user_id AS VARCHAR) ds, x FROM ev UNION ALL SELECT 'orders', x FROM cell),
r AS (SELECT CAST(user_id AS VARCHAR) ds, count(*) n_rows, 1 n_cols, 0 n_missing FROM ev GROUP BY 1 UNION ALL SELECT 'orders', count(*), 4, sum(4-nv) FROM sheet),
v AS (SELECT ds, avg(CASE WHEN x=floor(x) THEN 1.0 ELSE 0.0 END) integer_share, min(x) min_value, max(x) max_value FROM c GROUP BY ds),
lg AS (SELECT ds, log10(abs(x)) l, row_number() OVER (PARTITION BY ds ORDER BY abs(x))-1 i, count(*) OVER (PARTITION BY ds) m FROM c WHERE x<>0),
sp AS (SELECT ds, CASE WHEN max(m)<10 THEN max(l)-min(l) ELSE max(CASE WHEN i=CAST(floor(m*0.95) AS BIGINT) THEN l END)
  -max(CASE WHEN i=CAST(floor(m*0.05) AS BIGINT) THEN l END) END span FROM lg GROUP BY ds),
s AS (SELECT r.*, integer_share, min_value, max_value, span,
  ['qpcr','cell_count','elisa','plate_reader','genomics'][CASE WHEN r.ds='orders' THEN 3 ELSE TRY_CAST(r.ds AS BIGINT)%5+1 END] assay
  FROM r JOIN v ON r.ds=v.ds LEFT JOIN sp ON r.ds=sp.ds)
SELECT ds AS dataset_id, n_rows, n_cols, round(n_missing/(n_rows*1.0*n_cols),9) AS missing_share, n_missing/(n_rows*1.0*n_cols)>0.5 AS mostly_missing,
  CASE {hints.format(*[k for _, k, _, _ in datasets.HINTS])} END AS hint_level, CASE {hints.format(*[n for _, _, n, _ in datasets.HINTS])} END AS hint FROM s"""
    streaks = o["column_streaks"].rsplit("\nSELECT c1||", 1)[0]
    o["streak_places"] = f"""{streaks}
SELECT chr(CAST(65+c1 AS INTEGER))||(min(i)+2)||':'||chr(CAST(65+c2 AS INTEGER))||(max(i)+2) AS place, count(*) AS height FROM g GROUP BY c1,c2,g HAVING count(*)>=3"""
    o["grouping_status"] = f"""WITH {ORD}, g AS (SELECT cond,count(*) n FROM sheet GROUP BY cond)
SELECT 'orders' AS dataset_id,count(*) AS n_groups,min(n) AS smallest,max(n) AS largest,median(n) AS median_size,count(*)>=2 AND min(n)>=3 AS usable,
 NOT (count(*)>=2 AND min(n)>=3) OR median(n)<=4 AS pending FROM g"""
    o["differences"] = f"""WITH {ORD} SELECT c1,c2,count(*) AS n,round(avg(d),5) AS mean_d,round(stddev_samp(d),5) AS sd_d FROM pair GROUP BY c1,c2"""
    _verdicts(o)
    return o


ORACLES = _oracles()
