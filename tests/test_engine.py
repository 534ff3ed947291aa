"""Edge cases of the engine against small NumPy and Python forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitballot.functions import bits as B
from bitballot.operators import baselines, clauses, fit, metrics, train
from bitballot.operators.clauses import ClauseModel
from bitballot.plans import fixtures
from bitballot.sources import formats, readers
from bitballot.streaming import score

SF = "/root/testdata/sf0.001"


def some_model(n, seed, classes=3, clauses_=5, overlap=True):
    rng = np.random.RandomState(seed)
    rows = []
    for k in range(classes):
        for sign in (1, -1):
            for c in range(clauses_):
                p, q = (sorted(np.flatnonzero(rng.rand(n) < min(0.5, 6 / n)).tolist()) for _ in range(2))
                if c == 0:
                    p, q = [], []
                if not overlap:
                    q = [b for b in q if b not in p]
                rows.append((k, sign, c, int(rng.randint(1, 9)), p, q))
    return ClauseModel.of(rng.randint(0, 4, n), rng.randn(n).round(2), rows, classes, ["f0", "é"], [f"c{k}" for k in range(classes)])


def plain_votes(m, x):
    out = np.zeros((len(x), m.classes), int)
    for i, row in enumerate(x):
        bits = [bool(row[f] >= t) for f, t in zip(m.feat, m.thresh)]
        for k, sign, _, clamp, p, q in m.rows():
            wrong = sum(not bits[b] for b in p) + sum(bits[b] for b in q)
            out[i, k] += sign * max(clamp - wrong, 0)
    return out


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 351])
def test_all_ways_to_score_agree(spark, n):
    m = some_model(n, n)
    x = np.random.RandomState(0).randn(20, 4).astype(np.float32)
    x[0, :], x[1, 1], x[2, 2], x[3, 3] = np.nan, np.inf, -np.inf, -0.0
    want = plain_votes(m, x)
    assert (m.votes(m.pack(x)) == want).all()
    small, bias = m.pruned()
    assert (small.votes(small.pack(x)) + bias == want).all()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a float, b float, c float, d float")
    cols = list("abcd")
    ways = [clauses.votes_relational, clauses.votes_sparse] + ([clauses.votes_expression] if n <= 65 else [])
    for way in ways:
        got = {(r["row_id"], r["class"]): r["votes"] for r in way(df, cols, m).collect()}
        assert got == {(i, k): want[i, k] for i in range(20) for k in range(3)}, way.__name__
    got = {r.row_id: r.pred for r in clauses.predict(df, cols, m).collect()}
    assert got == {i: int(v.argmax()) for i, v in enumerate(want)}


def test_fixture_model_goldens(spark):
    df = fixtures.line(spark, SF)
    m = fixtures.fixture_model(df)
    counts = dict(clauses.predict(df, list(fixtures.FEATURES), m).groupBy("pred").count().collect())
    assert len(m.feat) == 80 and counts == {0: 3087, 1: 1524, 2: 1389}


@pytest.mark.parametrize("n", [1, 8, 64, 65, 351])
def test_files_round_trip(n, tmp_path):
    m = some_model(n, 5)
    for sparse in (False, True):
        back = formats.decode(formats.encode(m, sparse))
        assert back.rows() == m.rows() and (back.thresh == m.thresh).all() and back.feature_names == m.feature_names and back.class_names == m.class_names
    assert formats.decode_tmpy(formats.encode_tmpy(m)).rows() == m.rows()
    apart = some_model(n, 5, overlap=False)
    assert formats.decode_flat(formats.encode_flat(apart)).rows() == apart.rows()


def test_bad_files_are_refused():
    good = formats.encode(some_model(9, 1))
    for data in (b"", good[:-3], b"XXXX" + good[4:], good[:4] + b"\x07" + good[5:]):
        with pytest.raises(Exception):  # noqa: B017
            formats.decode(data)
    with pytest.raises(ValueError):
        ClauseModel.of([0], [0.0], [(0, 1, 0, 1, [1], [])], 1)


def test_rule_json_shapes_agree():
    a = '{"classes": ["x", 2], "class_rules": {"x": {"positive_clauses": [{"include": [0], "exclude": [1]}]}, "2": {"negative_clauses": [{"clamp": 4, "include": [2]}]}}, "config": {"LF": 7}}'
    b = '{"classes": {"x": {"positive": [{"include": [0], "include_inverted": [1]}]}, "2": {"negative": [{"clamp": 4, "include": [2]}]}}, "LF": 7}'
    z = np.zeros(3)
    assert formats.rules_json(a, z, z).rows() == formats.rules_json(b, z, z).rows() == [(0, 1, 0, 7, [0], [1]), (1, -1, 0, 4, [2], [])]


def test_readers(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(6, 2)
    readers.write_bytes(spark, str(tmp_path / "m.bin"), readers.matrix_bytes(x))
    got = readers.matrix(spark, str(tmp_path / "m.bin"), 4)
    assert got.rdd.getNumPartitions() == 2 and [list(r.x) for r in got.orderBy("row_id").collect()] == x.tolist()
    (tmp_path / "y.txt").write_text("1\n0\n2\n")
    assert [(r.row_id, r.y) for r in readers.labels(spark, str(tmp_path / "y.txt")).orderBy("row_id").collect()] == [(0, 1), (1, 0), (2, 2)]
    (tmp_path / "b.txt").write_text("1 0\ntrue false\n")
    assert sorted(tuple(r) for r in readers.bool_rows(spark, str(tmp_path / "b.txt")).collect()) == [(0, 0, True), (0, 1, False), (1, 0, True), (1, 1, False)]
    (tmp_path / "b.tsv").write_text("0\t1.5\n3\t-2\n")
    assert [tuple(r) for r in readers.binariser_tsv(spark, str(tmp_path / "b.tsv")).orderBy("bit").collect()] == [(0, 0, 1.5), (1, 3, -2.0)]
    for quantise in (False, True):
        (tmp_path / "b.json").write_text(formats.binariser_json([0, 3], [1.5, -2.0], 4, 15, quantise))
        assert [tuple(r) for r in readers.binariser_json(spark, str(tmp_path / "b.json")).orderBy("bit").collect()] == [(0, 0, 1.5), (1, 3, -2.0)]
        feat, thresh = formats.read_binariser_json((tmp_path / "b.json").read_text())
        assert feat.tolist() == [0, 3] and thresh.tolist() == [1.5, -2.0]
    np.savez(tmp_path / "t.npz", X_te=x)
    assert (readers.npz(spark, str(tmp_path / "t.npz"))["X_te"] == x).all()
    m = some_model(20, 2)
    (tmp_path / "a.fbz").write_bytes(formats.encode(m))
    assert readers.models(spark, str(tmp_path)).count() == len(m.cls) and readers.model(spark, str(tmp_path / "a.fbz")).rows() == m.rows()


def test_bits(spark):
    row = spark.range(1).select(B.at_least(F.lit(float("nan")), F.lit(1.0)).alias("nan"), B.at_least(F.lit(None).cast("double"), F.lit(1.0)).alias("null"), B.at_least(F.lit(-0.0), F.lit(0.0)).alias("zero"), B.get(B.put(F.lit(0).cast("long"), 63, True), 63).alias("top")).first()
    assert tuple(row) == (False, False, True, 1)


def test_fit_columns(spark):
    values = [0.0] * 60 + [float(i) for i in range(1, 41)]
    c = fit.Column(values)
    assert c.budget(15) == min(15, math.ceil(math.log2(max(2.0, 40 * 0.4**2))) + 2)
    e = c.edges(15)
    assert e[0] == 0.5 and len(e) <= c.budget(15) and (np.diff(e) > 0).all()
    assert fit.Column([-v for v in values]).edges(15).size  # no positive value: the whole column is used
    df = spark.createDataFrame([(0, 1.0)] * 5 + [(1, v) for v in (1.0, 2.0, 2.0)] + [(2, float(i * i)) for i in range(100)], "feat int, val double")
    rows = fit.fit(df, 15).orderBy("bit").collect()
    assert [(r.feat, r.thresh) for r in rows[:1]] == [(1, 2.0)] and {r.feat for r in rows} == {1, 2} and [r.bit for r in rows] == list(range(len(rows)))


def test_metrics_domains(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 1), (3, 3)], "y int, pred int")
    c = metrics.confusion(df)
    f1 = lambda **d: metrics.macro(c, **d).first()["f1"]
    per = {0: 2 / 3, 1: 0.5, 3: 2 / 3}
    assert math.isclose(f1(domain="union"), sum(per.values()) / 3)
    assert math.isclose(f1(domain="max_label"), sum(per.values()) / 4)
    assert math.isclose(f1(domain="header", classes=6), sum(per.values()) / 6)
    assert math.isclose(f1(domain="train", train=df.where("y < 2")), (per[0] + per[1]) / 2)
    assert metrics.accuracy(df.where("y > 9")).first()[0] == 0.0 and metrics.macro(metrics.confusion(df.where("y > 9"))).first()["f1"] == 0.0


def test_trees_and_forest_tables(spark):
    from bitballot.plans.files import shifted_tree

    x = np.array([[25.0, 20000.0, 0.05, 0.04], [np.nan, 1, 1, 1], [26, 1, 0.03, 0.0]], np.float32)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a float, b float, c float, d float")
    tree = shifted_tree(0)
    by_plan = [r.pred for r in baselines.predict_tree(df, tree, list("abcd")).orderBy("row_id").collect()]
    assert by_plan == baselines.walk(x, tree).tolist()
    table = baselines.forest_table([tree, shifted_tree(1)], spark)
    assert table.count() == 30 and table.where("tree = 1 and feat >= 0").agg(F.min("left")).first()[0] == 16


def test_training_learns(spark):
    rng = np.random.RandomState(4)
    bits = rng.rand(120, 10) < 0.5
    y = (bits[:, 0] & bits[:, 3]).astype(int)
    rows = [(i, [int(sum(1 << j for j in range(10) if b[j]))], int(k)) for i, (b, k) in enumerate(zip(bits, y))]
    df = spark.createDataFrame(rows, "row_id long, words array<long>, y int")
    got = train.train(df, 10, [0, 1], clauses=10, T=5, S=5, epochs=5).where("epoch = 5").collect()
    m = ClauseModel.of(np.arange(10), np.full(10, 0.5), [(r["class"], r["sign"], r["clause"], r["clamp"], r["include"], r["include_negated"]) for r in got], 2)
    assert (m.votes(m.pack(bits.astype(np.float32))).argmax(axis=1) == y).mean() > 0.9
    again = train.train(df, 10, [0, 1], clauses=10, T=5, S=5, epochs=5).where("epoch = 5").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_stream_equals_batch(spark, tmp_path):
    df = fixtures.line(spark, SF).limit(200)
    m = fixtures.fixture_model(fixtures.line(spark, SF))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = score.read(spark, str(tmp_path / "in"), df.schema)
    q = score.write(score.scored(stream, list(fixtures.FEATURES), m), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    batch = clauses.predict(spark.read.parquet(str(tmp_path / "in")), list(fixtures.FEATURES), m)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_quantiles_and_fixture_thresholds_are_of_all_rows(spark):
    rng = np.random.RandomState(3)
    price = np.concatenate([rng.rand(35_000) * 9e4, [1e7, 1e7]]).astype(np.float32)
    quantity = rng.randint(1, 51, len(price)).astype(np.float32)
    tax = np.where(np.arange(len(price)) == len(price) - 1, 0.5, 0.25).astype(np.float32)
    df = spark.createDataFrame([(i, float(a), float(b), 0.0, float(t)) for i, (a, b, t) in enumerate(zip(quantity, price, tax))], "row_id long, quantity float, price float, discount float, tax float")
    cuts = np.arange(1, 32) / 32
    want = [(f, float(v)) for f, x in enumerate((quantity, price)) for v in np.unique(np.quantile(x.astype(np.float64), cuts).astype(np.float32))]
    got = [(r.feat, r.thresh) for r in fixtures.fixture_thresholds(df).orderBy("bit").collect()]
    assert got == [*want, (3, 0.5)]
    odd = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 4.0)] + [(1, 7.0)] * 4 + [(2, v) for v in (-1.0, 5.0, math.inf)] + [(3, None)], "feat int, val double")
    assert sorted(map(tuple, fit.quantiles(odd, [0.0, 0.25, 1.0]).collect())) == [(0, 0, 1.0), (0, 1, 1.5), (0, 2, 4.0), (1, 0, 7.0), (1, 1, 7.0), (1, 2, 7.0), (2, 0, -1.0), (2, 1, 2.0), (2, 2, math.inf)]


def test_categorical_values_are_of_the_whole_table(spark):
    every = spark.createDataFrame([(0, float(v)) for v in (1, 2, 2, 3, 9)] + [(1, float(i)) for i in range(100)] + [(2, 5.0)] * 3, "feat int, val double")
    some = every.where("val <> 9 or feat <> 0")
    got = [(r.bit, r.feat, r.thresh) for r in fit.fit(some, 15, every).orderBy("bit").collect()]
    assert got[:3] == [(0, 0, 2.0), (1, 0, 3.0), (2, 0, 9.0)] and {f for _, f, _ in got} == {0, 1}
    assert got[3:] == [(b + 1, f, t) for b, f, t in map(tuple, fit.fit(some, 15).orderBy("bit").collect()) if f == 1]


def test_fitting_steps_read_all_rows(spark, tmp_path):
    from bitballot.plans import queries

    n = 30_500
    rows = spark.range(n).selectExpr("id as l_orderkey", "1 as l_linenumber", "id as l_partkey", "id as l_suppkey", "cast(id % 50 as double) as l_quantity", "cast(id as double) as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax", "'A' as l_returnflag")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    of = lambda name: {r["feat"]: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert of("col_routing")[1]["n_distinct"] == of("bit_budget")[1]["u"] == n
    gap = of("gap_test")
    assert (gap[1]["median_gap"], gap[1]["max_gap"], gap[1]["structural"], gap[6]["median_gap"]) == (1.0, 1.0, False, None)
    edges = [(r.i, r.edge) for r in queries.quantile_edges(spark, str(tmp_path)).where("feat = 1").orderBy("i").collect()]
    assert edges == [(i, round((i + 1) / 16 * (n - 1), 6)) for i in range(15)]
    assert {r.snapped % 1 for r in queries.gap_snap(spark, str(tmp_path)).where("feat = 1").collect()} == {0.5}


def test_training_reads_a_named_number_of_rows(spark, monkeypatch):
    from bitballot.plans import queries

    seen = []
    monkeypatch.setattr(train, "train", lambda rows, *a, **k: seen.append(rows) or rows)
    queries.train_model(spark, SF)
    assert queries.TRAIN_ROWS == 20_000 and seen[0].count() == 6_000


def test_sparse_scoring_makes_no_rows_of_literals(spark):
    from bitballot.plans import queries

    got = queries.tm_predict_sparse(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Join", "Generate"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.tm_predict(spark, SF).collect()))


def test_sparse_scoring_of_odd_models(spark):
    every = list(range(700))
    thresh = np.full(700, 0.1)
    many = [(0, 1, 0, 900, every, every), (0, -1, 0, 255, every[:300], []), (2, 1, 0, 5, [], every[:3]), (2, 1, 1, 4, [], [])]  # class 1 has no clause
    m = ClauseModel.of(np.arange(700) % 2, thresh, many, 3)
    x = [(0, 0.1, 1.0), (1, float(np.float32(0.1)), -1.0), (2, None, 1.0), (None, math.nan, 0.0)]  # 0.1 is below its float
    df = spark.createDataFrame(x, "key long, x0 double, x1 double")
    want = []
    for key, a, b in x:
        on = [v is not None and v >= float(np.float32(0.1)) for v in (a, b)]
        want.append((key, [200 - max(0, 255 - 150 * on.count(False)), 0, max(0, 5 - 2 * on[0] - on[1]) + 4]))
    got = clauses.scored_sparse(df, ["x0", "x1"], m, "key").collect()
    assert sorted((str(r.key), list(r.votes)) for r in got) == sorted((str(k), v) for k, v in want)
    assert all(r.pred == int(np.argmax(r.votes)) for r in got)
    assert {(r.key, r["class"]): r.votes for r in clauses.votes_sparse(df, ["x0", "x1"], m, "key").collect()} == {(k, i): v[i] for k, v in want for i in range(3)}
    none = ClauseModel.of([], [], [(1, 1, 0, 3, [], [])], 2)
    assert [list(r.votes) for r in clauses.scored_sparse(df, [], none, "key").collect()] == [[0, 3]] * 4
    assert {tuple(r.votes) for r in clauses.scored_sparse(df, [], ClauseModel.of([], [], [], 2), "key").collect()} == {(0, 0)}
