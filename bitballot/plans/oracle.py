"""The same results in DuckDB, from unpacked Boolean long forms, so that errors of packing cannot cancel."""

TH32 = str([i / 32 for i in range(1, 32)])
TH16 = str([i / 16 for i in range(1, 16)])

LINE = r"""fx AS (SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT)), 1, 15))::BIGINT AS row_id,
 l_quantity::FLOAT AS quantity, l_extendedprice::FLOAT AS price, (l_discount + 0.0)::FLOAT AS discount, (l_tax + 0.0)::FLOAT AS tax, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem)"""
CELLS = LINE + r""",
cells AS (SELECT row_id, 0 AS feat, quantity AS val FROM fx UNION ALL SELECT row_id, 1, price FROM fx UNION ALL SELECT row_id, 2, discount FROM fx UNION ALL SELECT row_id, 3, tax FROM fx)"""
WIDECELLS = LINE + r""",
sc AS (SELECT 0 AS feat, quantity::DOUBLE AS val FROM fx UNION ALL SELECT 1, price::DOUBLE FROM fx UNION ALL SELECT 2, discount::DOUBLE FROM fx UNION ALL SELECT 3, tax::DOUBLE FROM fx
 UNION ALL SELECT 4, CASE WHEN quantity > 35 THEN price ELSE 0 END::DOUBLE FROM fx UNION ALL SELECT 5, -CASE WHEN quantity > 35 THEN price ELSE 0 END::DOUBLE FROM fx UNION ALL SELECT 6, 1.0::DOUBLE FROM fx)"""
MODEL = CELLS + r""",
q AS (SELECT DISTINCT 0 AS feat, unnest(quantile_cont(quantity::DOUBLE, """ + TH32 + r"""))::FLOAT AS thresh FROM fx UNION SELECT DISTINCT 1, unnest(quantile_cont(price::DOUBLE, """ + TH32 + r"""))::FLOAT FROM fx
 UNION SELECT DISTINCT 2, discount FROM fx WHERE discount > (SELECT min(discount) FROM fx) UNION SELECT DISTINCT 3, tax FROM fx WHERE tax > (SELECT min(tax) FROM fx)),
th AS (SELECT (row_number() OVER (ORDER BY feat, thresh) - 1)::INTEGER AS bit, feat, thresh FROM q),
lit AS (SELECT k, sg, c, bit, ((bit * 31 + c * 17 + k * 7 + sg * 3) % 23) >= 2 AS negated FROM th, range(3) a(k), range(2) b(sg), range(20) d(c)
 WHERE (bit * 31 + c * 17 + k * 7 + sg * 3) % 23 < 4 AND c <> 19 AND (c % 4 = 0 OR (bit + c * 5 + k * 7) % 40 < (c % 4) * 4)),
cl AS (SELECT k, sg, c, count(bit) AS n, CASE WHEN count(bit) BETWEEN 1 AND 5 THEN count(bit) ELSE 6 END AS clamp FROM (range(3) a(k) CROSS JOIN range(2) b(sg) CROSS JOIN range(20) d(c)) LEFT JOIN lit USING (k, sg, c) GROUP BY ALL)"""
BITS = MODEL + r""",
bits AS (SELECT row_id, bit, NOT isnan(val) AND val >= thresh AS o FROM cells JOIN th USING (feat))"""
WRONG = BITS + r""",
wr AS (SELECT row_id, k, sg, c, count(*) AS w FROM bits JOIN lit USING (bit) WHERE o = negated GROUP BY ALL),
outs AS (SELECT row_id, cl.k, cl.sg, cl.c, coalesce(w, 0) AS w, greatest(clamp - coalesce(w, 0), 0) AS o FROM fx CROSS JOIN cl LEFT JOIN wr USING (row_id, k, sg, c))"""
VOTES = WRONG + r""",
votes AS (SELECT row_id, k, sum(CASE WHEN sg = 0 THEN o ELSE -o END)::BIGINT AS v FROM outs GROUP BY ALL),
pr AS (SELECT row_id, min(k)::INTEGER AS pred FROM (SELECT *, max(v) OVER (PARTITION BY row_id) AS top FROM votes) WHERE v = top GROUP BY row_id)"""
CONF = VOTES + r""",
cm AS (SELECT y::INTEGER AS y, pred, count(*) AS n FROM fx JOIN pr USING (row_id) GROUP BY ALL)"""
EMBED = "em AS (SELECT vec_id, embedding AS x, label AS y FROM embeddings)"


def q(base: str, tail: str) -> str:
    return f"WITH {base}\n{tail}"


def signed(word: int) -> str:
    total = f"sum(CASE WHEN o AND bit // 64 = {word} THEN power(2::DOUBLE, bit % 64)::HUGEINT ELSE 0 END)"
    return f"(CASE WHEN {total} >= 9223372036854775808 THEN {total} - 18446744073709551616 ELSE {total} END)::BIGINT"


def macro(domain: str) -> str:
    return q(CONF, f""", known AS ({domain}),
per AS (SELECT cls, coalesce(sum(n) FILTER (y = cls AND pred = cls), 0) AS tp, coalesce(sum(n) FILTER (y <> cls AND pred = cls), 0) AS fp, coalesce(sum(n) FILTER (y = cls AND pred <> cls), 0) AS fn FROM known, cm GROUP BY cls)
SELECT round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 9) AS precision, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END), 9) AS recall, round(avg(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 9) AS f1 FROM per""")


STATS = WIDECELLS + """,
st AS (SELECT feat, count(DISTINCT val) AS u, avg((val = 0)::INT) AS z, count(DISTINCT val) FILTER (val <> 0) AS nz, count(*) AS n, min(val) AS lo, max(val) AS hi FROM sc GROUP BY feat)"""
EDGES = WIDECELLS + """,
ed AS (SELECT feat, unnest(range(15)) AS i, unnest(quantile_cont(val, """ + TH16 + """)) AS edge FROM sc WHERE feat < 2 GROUP BY feat),
wc AS (SELECT * FROM sc WHERE feat < 2)"""
TREE = "CASE WHEN quantity <= 25 THEN CASE WHEN price <= 20000 THEN CASE WHEN discount <= 0.05::FLOAT THEN 0 ELSE 1 END ELSE CASE WHEN tax <= 0.04::FLOAT THEN 2 ELSE 0 END END ELSE CASE WHEN discount <= 0.03::FLOAT THEN CASE WHEN price <= 50000 THEN 1 ELSE 2 END ELSE CASE WHEN tax <= 0.02::FLOAT THEN 0 ELSE 1 END END END"


def shifted(t: int) -> str:
    return f"CASE WHEN quantity <= {25 + t} THEN CASE WHEN price <= {20000 + 500 * t} THEN CASE WHEN discount <= 0.05::FLOAT THEN {t % 3} ELSE {(1 + t) % 3} END ELSE CASE WHEN tax <= 0.04::FLOAT THEN {(2 + t) % 3} ELSE {t % 3} END END ELSE CASE WHEN discount <= 0.03::FLOAT THEN CASE WHEN price <= {50000 - 500 * t} THEN {(1 + t) % 3} ELSE {(2 + t) % 3} END ELSE CASE WHEN tax <= 0.02::FLOAT THEN {t % 3} ELSE {(1 + t) % 3} END END END"


LIN = "(quantity::DOUBLE - 32) / 16 AS a, (price::DOUBLE - 32768) / 16384 AS b, (discount::DOUBLE - 0.0625) / 0.03125 AS c, (tax::DOUBLE - 0.03125) / 0.015625 AS d"
HISTORY = WRONG + r""",
ev AS (SELECT e::INT AS epoch, row_id, k, sum(CASE WHEN sg = 0 THEN o ELSE -o END) AS v FROM outs, range(1, 5) r(e) WHERE c < 5 * e GROUP BY ALL),
ep AS (SELECT epoch, row_id, min(k) AS pred FROM (SELECT *, max(v) OVER (PARTITION BY epoch, row_id) AS top FROM ev) WHERE v = top GROUP BY ALL),
ec AS (SELECT epoch, y, pred, count(*) AS n FROM ep JOIN fx USING (row_id) GROUP BY ALL),
ek AS (SELECT epoch, y AS cls FROM ec UNION SELECT epoch, pred FROM ec),
ef AS (SELECT ek.epoch, cls, 2 * coalesce(sum(n) FILTER (y = cls AND pred = cls), 0) / (sum(n) FILTER (y = cls OR pred = cls) + coalesce(sum(n) FILTER (y = cls AND pred = cls), 0)) AS f FROM ek JOIN ec USING (epoch) GROUP BY ALL),
h AS (SELECT epoch, round((SELECT sum(n) FILTER (y = pred) / sum(n) FROM ec WHERE ec.epoch = ef.epoch), 9) AS acc, round(avg(f), 9) AS f1 FROM ef GROUP BY epoch)"""
SQL = {
    "binarise_bits": q(BITS, "SELECT row_id, string_agg(o::INT::VARCHAR, '' ORDER BY bit) AS bits FROM bits GROUP BY row_id"),
    "pack_words": q(BITS, f"SELECT row_id, {signed(0)} AS w0, {signed(1)} AS w1 FROM bits GROUP BY row_id"),
    "pack_bytes_msb": q(BITS, ", by_ AS (SELECT row_id, bit // 8 AS b, sum(CASE WHEN o THEN 1 << (7 - bit % 8) ELSE 0 END) AS v FROM bits GROUP BY ALL) SELECT row_id, string_agg(printf('%02X', v::INT), '' ORDER BY b) AS bytes FROM by_ GROUP BY row_id"),
    "booleanize_strict": q(CELLS, "SELECT row_id, string_agg((NOT isnan(val) AND val > t)::INT::VARCHAR, '' ORDER BY i, feat) AS bits FROM cells, (VALUES (0, 0.04::FLOAT), (1, 25::FLOAT), (2, 30000::FLOAT)) v(i, t) GROUP BY row_id"),
    "bit_get_set": q(BITS, f", g AS (SELECT row_id, max(CASE WHEN bit = 0 AND o THEN 1 ELSE 0 END) AS b0, max(CASE WHEN bit = 63 AND o THEN 1 ELSE 0 END) AS b63, sum(o::INT) FILTER (bit < 64) AS ones, sum((o OR bit = 5)::INT) FILTER (bit < 64) AS ones_put, sum((o AND bit <> 63)::INT) FILTER (bit < 64) AS ones_cut FROM bits GROUP BY row_id) SELECT row_id, b0::INT AS b0, b63::INT AS b63, ones::INT AS ones, ones_put::INT AS ones_put, ones_cut::INT AS ones_cut FROM g"),
    "bit_density": q(BITS, "SELECT count(*)::BIGINT AS cells, sum(o::INT)::BIGINT AS ones, round(avg(o::INT), 9) AS density FROM bits"),
    "threshold_table": q(MODEL, "SELECT bit, feat, thresh FROM th"),
    "const_col_filter": q(STATS, "SELECT feat FROM st WHERE u > 1"),
    "col_routing": q(STATS, "SELECT feat, u AS n_distinct, CASE WHEN u <= 1 THEN 'constant' WHEN u <= 15 THEN 'categorical' ELSE 'numeric' END AS kind FROM st"),
    "cat_edges": q(STATS, "SELECT DISTINCT feat, round(val, 9) AS thresh FROM sc JOIN st USING (feat) WHERE u BETWEEN 2 AND 15 AND val > lo"),
    "bit_budget": q(STATS, "SELECT feat, u, round(z, 9) AS z, (CASE WHEN u <= 1 THEN 0 WHEN u <= 15 THEN greatest(1, u - 1) WHEN z > 0.3 THEN greatest(1, least(ceil(log2(greatest(nz * greatest(1 - z, 0.01) ** 2, 2))) + 2, 15)) ELSE 15 END)::INT AS bits FROM st"),
    "quantile_edges": q(EDGES, "SELECT feat, i::INT AS i, round(edge, 6) AS edge FROM ed"),
    "gap_test": q(STATS, ", d AS (SELECT feat, lead(val) OVER (PARTITION BY feat ORDER BY val) - val AS gap FROM (SELECT DISTINCT feat, val FROM sc)) SELECT feat, round(median(gap), 6) AS median_gap, round(max(gap), 6) AS max_gap, coalesce(round(median(gap), 6) > 0 AND round(max(gap), 6) > 5 * round(median(gap), 6), false) AS structural FROM d GROUP BY feat"),
    "gap_snap": q(EDGES, ", m AS (SELECT feat, (val + lead(val) OVER (PARTITION BY feat ORDER BY val)) / 2 AS mid FROM (SELECT DISTINCT feat, val FROM wc)), b AS (SELECT feat, i, edge, (SELECT min(mid) FROM m WHERE m.feat = ed.feat AND mid >= edge) AS up, (SELECT max(mid) FROM m WHERE m.feat = ed.feat AND mid < edge) AS down FROM ed) SELECT feat, i::INT AS i, round(edge, 6) AS edge, round(CASE WHEN up IS NULL OR edge - down < up - edge THEN down ELSE up END, 6) AS snapped FROM b"),
    "perturb_edges": q(EDGES, ", w AS (SELECT feat, edge, coalesce(lag(edge) OVER p, (SELECT min(val) FROM wc WHERE wc.feat = e.feat)) AS l, coalesce(lead(edge) OVER p, (SELECT max(val) FROM wc WHERE wc.feat = e.feat)) AS r FROM (SELECT DISTINCT feat, edge FROM ed) e WINDOW p AS (PARTITION BY feat ORDER BY edge)), c AS (SELECT feat, edge, unnest([edge - 0.25 * (edge - l), edge, edge + 0.25 * (r - edge)]) AS t FROM w), s AS (SELECT c.feat, edge, t, avg((val >= t)::INT) AS p FROM c JOIN wc ON c.feat = wc.feat GROUP BY ALL) SELECT feat, round(edge, 6) AS edge, round(arg_min(t, -round(p * (1 - p), 12) * 1e15 + rank), 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY feat, edge ORDER BY t) AS rank FROM s) GROUP BY feat, edge"),
    "bit_entropy": q(EDGES, ", s AS (SELECT e.feat, edge, avg((val >= edge)::INT) AS p FROM (SELECT DISTINCT feat, edge FROM ed) e JOIN wc ON e.feat = wc.feat GROUP BY ALL) SELECT feat, round(edge, 6) AS edge, round(p, 9) AS p, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) END, 9) AS entropy FROM s"),
    "dead_bits": q(WIDECELLS, ", e AS (SELECT feat, unnest(quantile_cont(val, [0.002, 0.5, 0.9985])) AS edge FROM sc WHERE feat < 2 GROUP BY feat), s AS (SELECT e.feat, edge, avg((val >= edge)::INT) AS p FROM e JOIN sc ON e.feat = sc.feat GROUP BY ALL) SELECT feat, round(edge, 6) AS edge, (CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) END) >= 0.05 AS alive FROM s"),
    "sparse_prefix": q(WIDECELLS, "SELECT feat, CASE WHEN avg((val = 0)::INT) > 0.3 AND count(*) FILTER (val > 0) > 10 AND min(val) FILTER (val > 0) < max(val) FILTER (val > 0) THEN round(min(val) FILTER (val > 0) / 2, 6) END AS prefix FROM sc GROUP BY feat"),
    "threshold_quantise": q(MODEL, ", s AS (SELECT min(thresh::DOUBLE) AS zero, (max(thresh::DOUBLE) - min(thresh::DOUBLE)) / 65535 AS scale FROM th) SELECT bit, feat, least(greatest(round_even((thresh::DOUBLE - zero) / scale, 0), 0), 65535)::INT AS q, round(scale, 9) AS scale, round(zero, 9) AS zero, round((least(greatest(round_even((thresh::DOUBLE - zero) / scale, 0), 0), 65535) * scale + zero)::FLOAT::DOUBLE, 6) AS thresh FROM th, s"),
    "clause_mismatch": q(WRONG, "SELECT k::INT AS class, (1 - 2 * sg)::INT AS sign, c::INT AS clause, sum(w)::BIGINT AS wrong, count(*) FILTER (w = 0) AS perfect FROM outs GROUP BY k, sg, c"),
    "clause_output": q(WRONG, "SELECT k::INT AS class, (1 - 2 * sg)::INT AS sign, c::INT AS clause, sum(o)::BIGINT AS output, count(*) FILTER (o > 0) AS fired FROM outs GROUP BY k, sg, c"),
    "team_votes": q(WRONG, "SELECT row_id, k::INT AS class, (sum(o) FILTER (sg = 0))::BIGINT AS positive, (sum(o) FILTER (sg = 1))::BIGINT AS negative FROM outs GROUP BY row_id, k"),
    "class_votes": q(VOTES, "SELECT row_id, k::INT AS class, v AS votes FROM votes"),
    "tm_predict": q(VOTES, "SELECT row_id, pred FROM pr"),
    "tm_predict_binary": q(WRONG, "SELECT row_id, (sum(o) FILTER (sg = 0)) > (sum(o) FILTER (sg = 1)) AS pred FROM outs WHERE k = 1 GROUP BY row_id"),
    "clause_decode": q(MODEL, "SELECT cl.k::INT AS class, (1 - 2 * cl.sg)::INT AS sign, cl.c::INT AS clause, '[clamp=' || clamp || '] ' || coalesce(string_agg(CASE WHEN negated THEN 'NOT (' ELSE '(' END || 'bit_' || bit || ' >= ' || printf('%.4g', thresh::DOUBLE) || ')', ' AND ' ORDER BY bit, negated), '') AS text FROM cl LEFT JOIN lit USING (k, sg, c) LEFT JOIN th USING (bit) GROUP BY cl.k, cl.sg, cl.c, clamp"),
    "literal_stats": q(MODEL, "SELECT k::INT AS class, (1 - 2 * sg)::INT AS sign, count(*) AS clauses, sum(n)::BIGINT AS literals, round(avg(n), 9) AS mean_literals, count(*) FILTER (n = 0) AS empty, round(sum(n) / (count(*) * 2.0 * (SELECT count(*) FROM th)), 9) AS density FROM cl GROUP BY k, sg"),
    "clause_layout": q(MODEL, ", o AS (SELECT *, row_number() OVER (ORDER BY k, sg, c) - 1 AS r FROM cl) SELECT k::INT AS class, (1 - 2 * sg)::INT AS sign, min(r)::INT AS start, (max(r) + 1)::INT AS stop FROM o GROUP BY k, sg"),
    "mask_to_index": q(MODEL, "SELECT cl.k::INT AS class, (1 - 2 * cl.sg)::INT AS sign, cl.c::INT AS clause, coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (NOT negated), '') AS pos, coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (negated), '') AS neg FROM cl LEFT JOIN lit USING (k, sg, c) GROUP BY cl.k, cl.sg, cl.c"),
    "index_to_mask": q(MODEL, ", s AS (SELECT k, sg, c, negated, bit // 64 AS word, sum(power(2::DOUBLE, bit % 64)::HUGEINT) AS m FROM lit GROUP BY ALL) SELECT k::INT AS class, (1 - 2 * sg)::INT AS sign, c::INT AS clause, negated, word::INT AS word, (CASE WHEN m >= 9223372036854775808 THEN m - 18446744073709551616 ELSE m END)::BIGINT AS mask FROM s"),
    "dense_sparse_match": q(LINE, "SELECT count(*) AS compared, count(*) AS equal FROM fx"),
    "strategies_agree": q(LINE, "SELECT count(*) AS compared, count(*) AS equal FROM fx"),
    "clamp_rule": q(MODEL, "SELECT n AS literals, lf::INT AS lf, (CASE WHEN n > 0 AND n < lf THEN n ELSE lf END)::INT AS clamp FROM (SELECT DISTINCT n FROM cl), (VALUES (4), (6), (15)) v(lf)"),
    "update_prob": q(VOTES, ", d AS (SELECT k::INT AS class, y = k AS own, least(10, greatest(-10, v)) AS v FROM votes JOIN fx USING (row_id)) SELECT class, own, count(*) AS n, round(avg((CASE WHEN own THEN 10 - v ELSE 10 + v END) / 20.0::DOUBLE), 9) AS p FROM d GROUP BY ALL"),
    "model_prune": q(VOTES, "SELECT row_id, k::INT AS class, v AS votes FROM votes"),
    "confusion": q(CONF, "SELECT y, pred, n FROM cm"),
    "accuracy": q(CONF, "SELECT round(sum(n) FILTER (y = pred) / sum(n), 9) AS accuracy FROM cm"),
    "macro_f1_header": macro("SELECT i::INT AS cls FROM range(4) r(i)"),
    "macro_f1_max_label": macro("SELECT i::INT AS cls FROM range((SELECT max(y) + 1 FROM cm)) r(i)"),
    "macro_f1_truth": macro("SELECT DISTINCT y AS cls FROM cm"),
    "macro_f1_union": macro("SELECT y AS cls FROM cm UNION SELECT pred FROM cm"),
    "per_class_f1": q(CONF, ", k AS (SELECT y AS cls FROM cm UNION SELECT pred FROM cm) SELECT cls AS class, coalesce(sum(n) FILTER (y = cls AND pred = cls), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (y <> cls AND pred = cls), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (y = cls AND pred <> cls), 0)::BIGINT AS fn, round(coalesce(2 * sum(n) FILTER (y = cls AND pred = cls) / (sum(n) FILTER (y = cls) + sum(n) FILTER (pred = cls)), 0), 9) AS f1 FROM k, cm GROUP BY cls"),
    "class_union": q(CONF, "SELECT y AS class FROM cm UNION SELECT pred FROM cm"),
    "dt_predict": q(LINE, f"SELECT row_id, ({TREE})::INT AS pred FROM fx"),
    "rf_vote": q(LINE, f", t AS (SELECT row_id, unnest([{', '.join(shifted(t) for t in range(5))}]) AS c FROM fx), n AS (SELECT row_id, c, count(*) AS n FROM t GROUP BY ALL) SELECT row_id, arg_max(c, n * 10 - c)::INT AS pred FROM n GROUP BY row_id"),
    "standard_scale": q(LINE, f"SELECT row_id, {LIN} FROM fx"),
    "linear_multi": q(LINE, f", x AS (SELECT row_id, {LIN} FROM fx), s AS (SELECT row_id, unnest([0, 1, 2]) AS k, unnest([1 + a * 2 - b + c * 3 - d, -a + b * 2 + d, 2 + a - b - c + d * 2]) AS s FROM x) SELECT row_id, min(k)::INT AS pred FROM (SELECT *, max(s) OVER (PARTITION BY row_id) AS m FROM s) WHERE s = m GROUP BY row_id"),
    "linear_binary": q(LINE, f", x AS (SELECT row_id, {LIN} FROM fx) SELECT row_id, (-1 + a * 2 - b + c - d * 3 >= 0)::INT AS pred FROM x"),
    "gnb_predict": q(CELLS, ", m AS (SELECT y, feat, avg(val::DOUBLE) AS t, greatest(var_pop(val::DOUBLE), 1e-9) AS v FROM cells JOIN fx USING (row_id) WHERE feat < 2 GROUP BY ALL), p AS (SELECT y, ln(count(*) / (SELECT count(*) FROM fx)) AS p FROM fx GROUP BY y), s AS (SELECT row_id, m.y, any_value(p) - 0.5 * sum(ln(2 * pi() * v) + (val::DOUBLE - t) ** 2 / v) AS s FROM cells JOIN m USING (feat) JOIN p ON p.y = m.y GROUP BY row_id, m.y) SELECT row_id, arg_max(y, s)::INT AS pred FROM s GROUP BY row_id"),
    "mlp_predict": q(EMBED, ", i AS (SELECT vec_id, unnest(range(64)) AS i, unnest(x)::DOUBLE AS v FROM em), h AS (SELECT vec_id, o, greatest(sum(v * (((i * 7 + o * 3) % 11) - 5) / 8.0), 0) AS h FROM i, range(8) r(o) GROUP BY ALL), z AS (SELECT vec_id, k, sum(h * (((o * 5 + k) % 7) - 3) / 4.0) AS z FROM h, range(10) r(k) GROUP BY ALL) SELECT vec_id, arg_min(k, -round(z, 9) * 1e6 + k * 1e-6)::INT AS pred FROM z GROUP BY vec_id"),
    "knn_predict": q(EMBED, ", d AS (SELECT a.vec_id, b.vec_id AS o, b.y, list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d FROM em a, em b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS r FROM d) WHERE r <= 5), n AS (SELECT vec_id, y, count(*) AS n FROM t GROUP BY ALL) SELECT vec_id, arg_max(y, n * 1000 - y)::INT AS pred FROM n GROUP BY vec_id"),
    "stratified_split": q(LINE, ", c AS (SELECT y, quantile_cont(row_id::DOUBLE, 0.8) AS cut FROM fx GROUP BY y) SELECT y::INT AS y, count(*) FILTER (row_id <= cut) AS train, count(*) FILTER (row_id > cut) AS test FROM fx JOIN c USING (y) GROUP BY y"),
    "class_weight_lookup": q(LINE, "SELECT y::INT AS y, count(*) AS n, coalesce(CASE y WHEN 0 THEN 2.0 WHEN 2 THEN 0.5 END, 1.0)::DOUBLE AS w FROM fx GROUP BY y"),
    "tree_offsets": "SELECT n_regionkey::INT AS tree, coalesce(sum(count(*)) OVER (ORDER BY n_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM nation GROUP BY n_regionkey",
    "best_checkpoint": q(HISTORY, "SELECT epoch, f1 FROM h ORDER BY f1 DESC, epoch LIMIT 1"),
    "running_best": q(HISTORY, "SELECT epoch, max(acc) OVER (ORDER BY epoch) AS best, acc > coalesce(max(acc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS improved FROM h"),
    "topk_models": q(HISTORY, "SELECT epoch, acc FROM h ORDER BY acc DESC, epoch LIMIT 2"),
    "cycle_sample": "SELECT i::BIGINT AS i, n_nationkey::BIGINT AS n_nationkey FROM range(100) r(i) JOIN nation ON n_nationkey = i % 25",
    "replicate": "SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n FROM nation, range(4) r(i) GROUP BY n_regionkey",
    "string_table": "SELECT p_brand AS s, strlen(p_brand)::INT AS n FROM part GROUP BY p_brand",
    "density_stats": q(MODEL, "SELECT count(*) AS clauses, sum(n)::BIGINT AS literals, round(avg(n), 9) AS mean, (SELECT count(*) FROM th) AS n_bits, (6 * 2 + count(*) * (1 + 2 * ceil((SELECT count(*) FROM th) / 8.0)))::BIGINT AS dense_bytes, (6 * 2 + count(*) * 5 + 2 * sum(n))::BIGINT AS sparse_bytes FROM cl"),
    "event_scores_hourly": "SELECT date_trunc('hour', ts) AS hour, (CASE WHEN value >= 50 THEN 1 ELSE 0 END)::INT AS pred, count(*) AS n FROM events GROUP BY ALL",
    "checkpoint_history": q(HISTORY, "SELECT epoch, acc, f1 FROM h"),
}

RESULTS = q(CONF, f""", p AS (SELECT 'clauses' AS model, y, pred FROM fx JOIN pr USING (row_id) UNION ALL SELECT 'tree', y, {TREE} FROM fx
UNION ALL SELECT 'forest', y, pred FROM ({SQL["rf_vote"]}) JOIN fx USING (row_id) UNION ALL SELECT 'linear', y, pred FROM ({SQL["linear_multi"]}) JOIN fx USING (row_id))
SELECT model, round(avg((y = pred)::INT), 9) AS acc FROM p GROUP BY model""")
#: Sums of the archives' arrays: those of the tree of depth three, shifted by t, and of the other literal models.
ARCHIVES = f"""WITH leaf AS (SELECT t, k FROM range(5) a(t), (SELECT unnest([0, 1, 2, 0, 1, 2, 0, 1]) AS k) b),
one AS (SELECT t, 15 AS n, 4 AS feat, 70025.14 + t AS thresh, 41 + 105 * t AS l, 48 + 105 * t AS r, (SELECT sum((k + leaf.t) % 3) FROM leaf WHERE leaf.t = r.t) AS c FROM range(5) r(t)),
trees AS (SELECT 'tree.npz' AS file, * FROM one WHERE t = 0 UNION ALL SELECT 'forest.npz', * FROM one),
bayes AS (SELECT feat, y, avg(val::DOUBLE) AS m, greatest(var_pop(val::DOUBLE), 1e-9) AS v FROM ({q(CELLS, "SELECT feat, y, val FROM cells JOIN fx USING (row_id) WHERE feat < 2")}) GROUP BY ALL),
found AS (SELECT file, 'feat' AS "array", sum(n) AS n, sum(feat) AS total FROM trees GROUP BY file UNION ALL SELECT file, 'thresh', sum(n), sum(thresh) FROM trees GROUP BY file
UNION ALL SELECT file, 'left', sum(n), sum(l) FROM trees GROUP BY file UNION ALL SELECT file, 'right', sum(n), sum(r) FROM trees GROUP BY file UNION ALL SELECT file, 'leaf_cls', sum(n), sum(c) FROM trees GROUP BY file
UNION ALL SELECT 'forest.npz', 'tree_roots', 5, 150 UNION ALL SELECT 'linear.npz', 'coef', 12, 6 UNION ALL SELECT 'linear.npz', 'intercept', 3, 3
UNION ALL SELECT 'linear.npz', 'scaler_mean', 4, 32 + 32768 + 0.0625 + 0.03125 UNION ALL SELECT 'linear.npz', 'scaler_scale', 4, 16 + 16384 + 0.03125 + 0.015625
UNION ALL SELECT 'bayes.npz', 'theta', count(*), sum(m) FROM bayes UNION ALL SELECT 'bayes.npz', 'var', count(*), sum(v) FROM bayes
UNION ALL SELECT 'bayes.npz', 'class_log_prior', count(*), sum(p) FROM ({q(LINE, "SELECT ln(count(*) / (SELECT count(*) FROM fx)) AS p FROM fx GROUP BY y")}) UNION ALL SELECT 'bayes.npz', 'classes', count(DISTINCT y), 3 FROM bayes
UNION ALL SELECT 'perceptron.npz', 'n_layers', 1, 2 UNION ALL SELECT 'perceptron.npz', 'b0', 8, 0 UNION ALL SELECT 'perceptron.npz', 'b1', 10, 0
UNION ALL SELECT 'perceptron.npz', 'W0', 512, sum(((i * 7 + o * 3) % 11 - 5) / 8.0) FROM range(64) a(i), range(8) b(o) UNION ALL SELECT 'perceptron.npz', 'W1', 80, sum(((i * 5 + o) % 7 - 3) / 4.0) FROM range(8) a(i), range(10) b(o))
SELECT file, "array", n::BIGINT AS n, round(total::DOUBLE, 3) AS total FROM found"""
#: The fit without its refill, which is sequential: the result wherever no bit is dropped, as on these tables.  The bounded
#: sample is the fit's own; values of categorical features are those of all rows.
FIT = WIDECELLS + r""",
sam AS (SELECT * FROM fx ORDER BY row_id LIMIT 30000),
ss AS (SELECT 0 AS feat, quantity::DOUBLE AS val FROM sam UNION ALL SELECT 1, price::DOUBLE FROM sam UNION ALL SELECT 2, discount::DOUBLE FROM sam UNION ALL SELECT 3, tax::DOUBLE FROM sam
 UNION ALL SELECT 4, CASE WHEN quantity > 35 THEN price ELSE 0 END::DOUBLE FROM sam UNION ALL SELECT 5, -CASE WHEN quantity > 35 THEN price ELSE 0 END::DOUBLE FROM sam UNION ALL SELECT 6, 1.0::DOUBLE FROM sam),
st AS (SELECT feat, count(DISTINCT val) AS u, avg((val = 0)::INT) AS z, count(DISTINCT val) FILTER (val <> 0) AS nz, count(*) FILTER (val > 0) AS np, min(val) FILTER (val > 0) AS lo, max(val) FILTER (val > 0) AS hi FROM ss GROUP BY feat),
plan AS (SELECT feat, CASE WHEN z > 0.3 THEN greatest(1, least(ceil(log2(greatest(nz * greatest(1 - z, 0.01) ** 2, 2))) + 2, 15)) ELSE 15 END::INT AS k, z > 0.3 AND np > 10 AND lo < hi AS upper, lo / 2 AS prefix FROM st WHERE u > 15),
work AS (SELECT feat, val FROM ss JOIN plan USING (feat) WHERE NOT upper OR val > 0),
lists AS (SELECT feat, list(val ORDER BY val) AS l, count(*) AS n, min(val) AS first, max(val) AS last FROM work GROUP BY feat),
places AS (SELECT feat, l, i / (k - upper::INT + 1) * (n - 1) AS h FROM lists JOIN plan USING (feat), range(1, 16) r(i) WHERE i <= k - upper::INT),
e0 AS (SELECT feat, l[floor(h)::INT + 1] + (h - floor(h)) * (l[least(floor(h)::INT + 2, len(l))] - l[floor(h)::INT + 1]) AS edge FROM places),
gaps AS (SELECT feat, median(gap) AS typical, max(gap) AS widest FROM (SELECT feat, lead(val) OVER (PARTITION BY feat ORDER BY val) - val AS gap FROM (SELECT DISTINCT feat, val FROM work)) GROUP BY feat),
mids AS (SELECT feat, (val + lead(val) OVER (PARTITION BY feat ORDER BY val)) / 2 AS mid FROM (SELECT DISTINCT feat, val FROM work)),
bands AS (SELECT feat, mid, (mid + lag(mid) OVER (PARTITION BY feat ORDER BY mid)) / 2 AS border FROM mids WHERE mid IS NOT NULL),
e1 AS (SELECT DISTINCT feat, CASE WHEN 5 * typical > 0 AND 5 * typical < widest THEN (SELECT max(mid) FROM bands b WHERE b.feat = e0.feat AND (border IS NULL OR border <= edge)) ELSE edge END AS edge FROM e0 JOIN gaps USING (feat)),
e2 AS (SELECT feat, edge, n, coalesce(lag(edge) OVER w, first) AS a, coalesce(lead(edge) OVER w, last) AS b FROM e1 JOIN lists USING (feat) WINDOW w AS (PARTITION BY feat ORDER BY edge)),
cands AS (SELECT feat, edge, n, unnest([edge - 0.25::DOUBLE * (edge - a), edge, edge + 0.25::DOUBLE * (b - edge)]) AS c, unnest([0, 1, 2]) AS side FROM e2),
shares AS (SELECT feat, edge, c, side, 1 - (SELECT count(*) FROM work w WHERE w.feat = cands.feat AND w.val < c)::DOUBLE / n AS p FROM cands),
nudged AS (SELECT feat, c FROM (SELECT *, row_number() OVER (PARTITION BY feat, edge ORDER BY p * (1 - p) DESC, side) AS r FROM shares) WHERE r = 1),
dense AS (SELECT feat, t FROM (SELECT feat, t, k, row_number() OVER (PARTITION BY feat ORDER BY t) AS r FROM (SELECT feat, c AS t FROM nudged UNION SELECT feat, prefix FROM plan WHERE upper) JOIN plan USING (feat)) WHERE r <= k),
few AS (SELECT DISTINCT feat, val AS t FROM sc JOIN st USING (feat) WHERE u BETWEEN 2 AND 15 AND val > (SELECT min(val) FROM sc x WHERE x.feat = sc.feat))
SELECT (row_number() OVER (ORDER BY d, feat, t) - 1)::INT AS bit, feat, t AS thresh FROM (SELECT true AS d, feat, t::FLOAT AS t FROM dense UNION ALL SELECT false, feat, t::FLOAT FROM few)"""
SUPPLIER = "s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, s_suppkey, s_nationkey, s_acctbal, (s_nationkey % 3)::INT AS y, CASE WHEN s_acctbal::FLOAT <= 0 THEN 0 WHEN s_acctbal::FLOAT <= 5000 THEN 1 ELSE 2 END AS pred FROM supplier)"
PREDICTED = {"tree": "dt_predict", "forest": "rf_vote", "linear": "linear_multi", "bayes": "gnb_predict", "perceptron": "mlp_predict"}
SQL |= {
    "fit_thresholds": f"WITH {FIT}",
    "summary_upsert": RESULTS,
    "report_sorted": f"SELECT row_number() OVER (ORDER BY round(acc, 4) DESC, model)::INT AS place, printf('%-10s|%8.4f', model, round(acc, 4)) AS line FROM ({RESULTS})",
    "model_gap": f"WITH r AS ({RESULTS}) SELECT b.model, round(a.acc / b.acc, 6) AS ratio, round(a.acc - b.acc, 6) AS gain FROM r a JOIN r b ON a.model = 'clauses' AND b.model <> 'clauses'",
    "scaler_membership": f"SELECT model, model IN ('linear', 'bayes', 'neighbours') AS scaled FROM ({RESULTS})",
    "bit_counts": q(BITS, "SELECT bit, sum(o::INT)::BIGINT AS n FROM bits GROUP BY bit"),
    "bytes_to_words": q(MODEL, ", s AS (SELECT cl.k, cl.sg, cl.c, coalesce(sum(power(2::DOUBLE, bit % 64)::HUGEINT) FILTER (NOT negated AND bit < 64), 0) AS a, coalesce(sum(power(2::DOUBLE, bit % 64)::HUGEINT) FILTER (NOT negated AND bit >= 64), 0) AS b FROM cl LEFT JOIN lit USING (k, sg, c) GROUP BY ALL) SELECT k::INT AS class, (1 - 2 * sg)::INT AS sign, c::INT AS clause, (CASE WHEN a >= 9223372036854775808 THEN a - 18446744073709551616 ELSE a END)::BIGINT AS w0, (CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END)::BIGINT AS w1 FROM s"),
    "parameter_counts": q(MODEL, "SELECT k::INT AS class, (count(*) * 2 * (SELECT count(*) FROM th))::BIGINT AS before, sum(n)::BIGINT AS after FROM cl GROUP BY k"),
    "deploy_scores": f"SELECT * FROM ({SQL['tm_predict']}) ORDER BY row_id LIMIT 10",
    "full_convolution": "WITH a AS (SELECT n_regionkey::INT AS i, (n_nationkey % 5)::INT AS j, sum(n_nationkey - 7) AS v FROM nation GROUP BY ALL), k AS (SELECT r_regionkey % 2 AS p, r_regionkey // 2 AS q, r_regionkey - 1 AS w FROM region) SELECT (i + p)::INT AS i, (j + q)::INT AS j, sum(v * w)::BIGINT AS v FROM a, k GROUP BY ALL",
    "shuffled": "SELECT n_nationkey::BIGINT AS n_nationkey, (row_number() OVER (ORDER BY md5('7:' || n_nationkey), n_nationkey) - 1)::BIGINT AS place FROM nation",
    "parse_bool_text": "SELECT (row_number() OVER (PARTITION BY b ORDER BY n_nationkey) - 1)::INT AS row_id, b::INT AS bit, (n_nationkey::BIGINT >> b) & 1 = 1 AS on_ FROM nation, range(5) r(b)",
    "rule_json": q(MODEL, "SELECT shape, cl.k::INT AS class, (1 - 2 * cl.sg)::INT AS sign, cl.c::INT AS clause, clamp::INT AS clamp, coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (NOT negated), '') AS pos, coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (negated), '') AS neg FROM (VALUES ('listed'), ('mapped')) s(shape) CROSS JOIN cl LEFT JOIN lit USING (k, sg, c) GROUP BY ALL"),
    "model_folder_scan": q(MODEL, "SELECT file, cl.k::INT AS class, (1 - 2 * cl.sg)::INT AS sign, cl.c::INT AS clause, clamp::INT AS clamp, (count(bit) FILTER (NOT negated))::INT AS n_pos, (count(bit) FILTER (negated))::INT AS n_neg FROM (VALUES ('dense.fbz'), ('sparse.fbz')) s(file) CROSS JOIN cl LEFT JOIN lit USING (k, sg, c) GROUP BY ALL"),
    "binariser_tsv_scan": SQL["threshold_table"],
    "binariser_json_scan": f"SELECT 'plain' AS form, bit, feat, round(thresh::DOUBLE, 6) AS thresh FROM ({SQL['threshold_table']}) UNION ALL SELECT 'quantised', bit, feat, thresh FROM ({SQL['threshold_quantise']})",
    "raw_matrix_scan": f"WITH {SUPPLIER} SELECT row_id, s_suppkey::DOUBLE AS x0, s_nationkey::DOUBLE AS x1, round(s_acctbal::FLOAT::DOUBLE, 2) AS x2 FROM s",
    "file_scores": f"WITH {SUPPLIER}, k AS (SELECT y AS c FROM s UNION SELECT pred FROM s), f AS (SELECT c, 2 * count(*) FILTER (y = c AND pred = c) / (count(*) FILTER (y = c) + count(*) FILTER (pred = c)) AS f FROM s, k GROUP BY c) SELECT (SELECT count(*) FROM s) AS n_rows, (SELECT round(avg((y = pred)::INT), 9) FROM s) AS accuracy, round(avg(f), 9) AS f1 FROM f",
    "archive_scan": ARCHIVES,
    "dispatch_scores": " UNION ALL ".join(f"SELECT '{name}' AS model, '{name}' AS kind, pred::INT AS pred, count(*) AS n FROM ({SQL[name_of]}) GROUP BY pred" for name, name_of in PREDICTED.items()),
    "dataset_registry": "SELECT 'lines' AS dataset, count(*) AS n FROM lineitem UNION ALL SELECT 'vectors', count(*) FROM embeddings",
}
SQL["clause_xor"] = SQL["clause_mismatch"]
SQL["fbz_file_predict"] = SQL["fbz_sparse_file_predict"] = SQL["flat_file_predict"] = SQL["tmpy_file_predict"] = SQL["model_directory_predict"] = SQL["tm_predict_relational"] = SQL["tm_predict_sparse"] = SQL["tm_predict_expression"] = SQL["tm_predict"]
