"""Files, archives, drivers and models by kind against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitballot.operators import baselines, clauses, fit, models, train
from bitballot.operators.clauses import ClauseModel
from bitballot.plans.files import LINEAR, SCALER, perceptron, shifted_tree
from bitballot.sources import catalogue, formats, readers

COLUMNS = list("abcd")


@pytest.fixture(scope="module")
def frame(spark):
    x = np.random.RandomState(2).rand(200, 4).astype(np.float32) * np.float32([50, 90_000, 0.1, 0.08])
    return spark.createDataFrame([(i, *map(float, r), int(i % 3)) for i, r in enumerate(x)], "row_id long, a float, b float, c float, d float, y int").persist()


def told(df):
    return sorted((r[0], r.pred) for r in df.collect())


def test_every_kind_scores_from_a_table_and_an_archive(spark, frame, tmp_path):
    bayes = baselines.gnb_fit(frame, COLUMNS)
    vectors = frame.select(F.col("row_id").alias("vec_id"), F.array(*[F.col(c) / m for c, m in zip(COLUMNS, (50, 90_000, 0.1, 0.08))]).alias("x"), "y")
    layers = [(np.arange(8).reshape(4, 2) - 3.5, np.ones(2)), (np.eye(2, 3), np.zeros(3))]
    found = {
        "tree": (models.exported("tree", shifted_tree(0)), baselines.predict_tree(frame, shifted_tree(0), COLUMNS)),
        "forest": (models.exported("forest", [shifted_tree(t) for t in range(5)]), baselines.predict_forest(frame, [shifted_tree(t) for t in range(5)], COLUMNS)),
        "linear": (models.exported("linear", *LINEAR, scaler=SCALER), baselines.predict_linear(frame, baselines.scaled(COLUMNS, *SCALER), *LINEAR)),
        "bayes": (models.exported("bayes", bayes, COLUMNS), baselines.predict_gnb(frame, bayes, COLUMNS)),
        "perceptron": (models.exported("perceptron", layers), baselines.predict_mlp(vectors, "x", layers)),
        "neighbours": (models.exported("neighbours", vectors.where("vec_id < 150"), 3), baselines.predict_knn(vectors, vectors.where("vec_id < 150"), 3)),
    }
    for name, (arrays, _) in found.items():
        readers.write_archive(spark, str(tmp_path / f"{name}.npz"), arrays)
    models.model_table(spark, {k: a for k, (a, _) in found.items()}).write.parquet(str(tmp_path / "table"))
    back = models.from_table(spark.read.parquet(str(tmp_path / "table")))
    cells = readers.archive_tables(spark, str(tmp_path), leave_out=("tree.npz",))
    assert {r[0] for r in cells.select("file").distinct().collect()} == {f"{n}.npz" for n in found if n != "tree"}
    assert cells.where("file = 'linear.npz' and array = 'coef' and i = 1 and j = 1").first().value == 2.0
    for name, (arrays, want) in found.items():
        whole = vectors.withColumnRenamed("vec_id", "row_id") if name in ("perceptron", "neighbours") else frame
        columns = ["x"] if name in ("perceptron", "neighbours") else COLUMNS
        assert models.kind_of(arrays) == models.kind_of(back[name]) == name
        assert told(models.score(whole, arrays, columns)) == told(models.score(whole, back[name], columns)) == told(want), name
        assert models.parameters(back[name]) == models.parameters(readers.npz(spark, str(tmp_path / f"{name}.npz")))
    assert models.kind_of({"other": 1}) is None and "scaler_mean" not in models.exported("tree", shifted_tree(0), scaler=SCALER)
    with pytest.raises(ValueError):
        models.exported("boosted")
    with pytest.raises(ValueError):
        models.export_neighbours(vectors, 3, limit=10)


@pytest.mark.parametrize("block", [7, 1000])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.RandomState(3)
    x = rng.randint(0, 4, (120, 3)).astype(float)  # many ties
    y = rng.randint(0, 3, 120)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "vec_id long, x array<double>, y int")
    want = {}
    for i in range(40):
        d = ((x[40:] - x[i]) ** 2).sum(axis=1)
        near = y[40:][np.lexsort((np.arange(80), d))[:5]]
        n = np.bincount(near, minlength=3)
        want[i] = int(np.argmax(n))
    got = baselines.predict_knn(df.where("vec_id < 40"), df.where("vec_id >= 40"), 5, block)
    assert {r.vec_id: r.pred for r in got.collect()} == want


def test_order_statistic(spark):
    rng = np.random.RandomState(1)
    ids = [int(v) for v in rng.randint(0, 1 << 60, 3000, dtype=np.int64)] + [5] * 40
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(ids)], "y int, row_id long")
    got = {r.y: r.cut for r in train.order_statistic(df, "y", "row_id", 0.8).collect()}
    for k in range(3):
        v = sorted(v for i, v in enumerate(ids) if i % 3 == k)
        assert got[k] == v[int(0.8 * (len(v) - 1))]
    assert train.order_statistic(df.limit(0), "y", "row_id", 0.8).count() == 0


def test_binariser(spark, frame):
    b = fit.Binariser(COLUMNS, 7)
    out = b.fit_transform(frame, frame)
    assert b.n_bits == len(b.feat) and 0 < b.n_bits <= 28 and out.columns == [*frame.columns, "w0"]
    x = np.array([[r[c] for c in COLUMNS] for r in frame.orderBy("row_id").collect()], np.float32)
    want = ClauseModel.of(b.feat, b.thresh, [], 1).pack(x).view(np.int64)[:, 0].tolist()
    assert [r.w0 for r in out.orderBy("row_id").collect()] == want


def test_packed_takes_odd_values(spark):
    m = ClauseModel.of([0, 1, 0, 0], [1.0, 0.0, 1.0, -2.0], [(0, 1, 0, 2, [0], [1])], 1)
    rows = [(0, float("nan"), None), (1, 1.0, -0.0), (2, float("inf"), float("-inf")), (3, -2.0, 5.0)]
    df = spark.createDataFrame(rows, "row_id long, a float, b float")
    got = [r.w0 for r in clauses.packed(df, ["a", "b"], m).orderBy("row_id").collect()]
    assert got == [0, 0b1111, 0b1101, 0b1010]


def test_fit_loop_keeps_the_best_checkpoint(spark):
    rng = np.random.RandomState(4)
    bits = rng.rand(150, 10) < 0.5
    y = (bits[:, 0] & bits[:, 3]).astype(int)
    names = [f"f{i}" for i in range(10)]
    rows = spark.createDataFrame([(i, [int(sum(1 << j for j in range(10) if b[j]))], int(k)) for i, (b, k) in enumerate(zip(bits, y))], "row_id long, words array<long>, y int")
    test = spark.createDataFrame([(*map(float, b), int(k)) for b, k in zip(bits, y)], ", ".join(f"{n} float" for n in names) + ", y int")
    told_, best, kept = train.fit_loop(rows, test, names, np.arange(10), np.full(10, 0.5), [0, 1], keep=2, clauses=10, T=5, S=5, epochs=4)
    history = sorted((r.epoch, r.acc, r.f1) for r in told_.collect())
    assert [h[0] for h in history] == [1, 2, 3, 4] and len(kept) == 2
    votes = best.votes(best.pack(bits.astype(np.float32))).argmax(axis=1)
    top = max(history, key=lambda h: (h[2], -h[0]))
    assert abs((votes == y).mean() - top[1]) < 1e-12 and train.best_checkpoint(told_).first()[0] == top[0]
    assert set(kept) == {e for e, _, _ in sorted(history, key=lambda h: (-h[1], h[0]))[:2]}


def test_registry_passes_over_missing_files(spark, tmp_path):
    for name in ("x.parquet", "y.parquet", "scaler.npz", "_SUCCESS"):
        (tmp_path / name).write_bytes(b"abc")
    files = catalogue.listing(spark, str(tmp_path), leave_out=("scaler.npz",))
    assert [tuple(r) for r in files.collect()] == [("x.parquet", 3), ("y.parquet", 3)]
    assert catalogue.listing(spark, str(tmp_path / "none")).count() == 0
    known = catalogue.registry(spark, [("X", "x"), ("Y", "y"), ("Z", "z")])
    assert sorted(r.dataset for r in catalogue.present(known, files).collect()) == ["X", "Y"]
    assert [r.dataset for r in catalogue.present(known, files, only=["Y", "Z"]).collect()] == ["Y"]


def test_matched_wants_the_same_rows(spark):
    a, b = spark.createDataFrame([(0, 1), (1, 0)], "row_id long, pred int"), spark.createDataFrame([(0, 1), (1, 1)], "row_id long, y int")
    assert sorted(tuple(r) for r in readers.matched(a, b).collect()) == [(0, 1, 1), (1, 0, 1)]
    with pytest.raises(Exception, match="different rows"):
        readers.matched(a, b.limit(1)).collect()


def test_files_written_as_streams(spark, tmp_path):
    df = spark.range(70_000).selectExpr("id", "cast(id as float) x", "cast(id % 7 as int) y").orderBy("id")
    readers.write_matrix(spark, df, ["x"], str(tmp_path / "m.bin"))
    readers.write_labels(spark, df, "y", str(tmp_path / "y.txt"))
    got = readers.matrix(spark, str(tmp_path / "m.bin"), 30_000).join(readers.labels(spark, str(tmp_path / "y.txt")), "row_id")
    assert got.where("x[0] = row_id and y = row_id % 7").count() == 70_000
    rules = ClauseModel.of([0, 1], [0.0, 1.0], [(0, 1, 0, 3, [0], [1]), (1, -1, 0, 2, [], [0])], 2, class_names=["p", "q"])
    for listed in (True, False):
        assert formats.rules_json(formats.to_rules_json(rules, listed), [0, 1], [0.0, 1.0]).rows() == rules.rows()
    catalogue.save_model(spark, rules, str(tmp_path / "model"))
    back = catalogue.load_model(spark, str(tmp_path / "model"))
    assert back.rows() == rules.rows() and back.class_names == ["p", "q"] and back.classes == 2
    with pytest.raises(ValueError):
        formats.packed_strings(["s"] * 65_536)
    assert perceptron()[0][0].shape == (64, 8)


def test_bytes_bits_and_packed_files(spark, tmp_path):
    import gzip

    from bitballot.functions import bits as B
    from bitballot.operators import metrics

    data = bytes(range(200, 211))
    df = spark.createDataFrame([(bytearray(data), 3.0, 0.5)], "d binary, a float, b float")
    got = df.select(*[w.alias(f"w{i}") for i, w in enumerate(B.words_of_bytes(F.col("d"), 2))]).first()
    assert list(got) == np.frombuffer(data + bytes(5), "<i8").tolist()
    on = [F.lit(c == "1") for c in "1000000111"]
    assert bytes(df.select(B.packed_bytes(on)).first()[0]) == bytes([0b10000001, 0b11000000])
    assert list(df.select(*B.booleanize([F.col("a"), F.col("b")], [0.5, 3.0])).first()) == [True, False, False, False]
    m = ClauseModel.of([0, 1], [0.0, 1.0], [(0, 1, 0, 3, [0], [1])], 1)
    readers.write_bytes(spark, str(tmp_path / "m.fbz.gz"), gzip.compress(formats.encode(m), 9))
    assert readers.model(spark, str(tmp_path / "m.fbz.gz")).rows() == m.rows()
    told_ = metrics.timed(lambda: None, 10)
    assert set(told_) == {"seconds", "us_per_row", "rows_per_s"} and told_["seconds"] >= 0
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan"))], "row_id long, feat int, val float")
    assert sorted(tuple(r) for r in clauses.bit_cells(cells, m.threshold_table(spark)).collect()) == [(0, 0, True), (0, 1, False)]


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "y.txt").write_text("\n".join(str(i * 7 % 1000) for i in range(3000)) + "\n")
    (tmp_path / "e.txt").write_text("1\r\n\r\n3")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path / "y.txt"))
        assert lines.rdd.getNumPartitions() > 5
        assert [(r.row_id, r.value) for r in lines.orderBy("row_id").collect()] == [(i, str(i * 7 % 1000)) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in readers.numbered_lines(spark, str(tmp_path / "e.txt")).orderBy("row_id").collect()] == ["1", "", "3"]
    x = np.arange(30_000, dtype=np.float32).reshape(10_000, 3)
    whole = readers.matrix_content(spark.createDataFrame([(bytearray(readers.matrix_bytes(x)),)], "content binary"))
    assert [list(r.x) for r in whole.orderBy("row_id").collect()] == x.tolist()
