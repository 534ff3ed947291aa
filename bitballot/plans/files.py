"""Queries that write the file formats and read them back: models, matrices, labels, rules, archives and listings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.operators import baselines, clauses, metrics, models
from bitballot.plans import fixtures as fx
from bitballot.sources import catalogue, formats, readers
from bitballot.sources.scratch import Folder

COLUMNS = list(fx.FEATURES)
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def fixture(spark, sf_dir):
    df = fx.line(spark, sf_dir)
    return df, fx.fixture_model(df)


def predicted_from(spark, sf_dir, write, layout: str) -> DataFrame:
    """Predictions of the model that is read back from a file."""
    df, m = fixture(spark, sf_dir)
    path = Folder(spark).path("model.bin")
    readers.write_bytes(spark, path, write(m))
    return clauses.predict(df, COLUMNS, readers.model(spark, path, layout)).select("row_id", "pred")


@query
def fbz_file_predict(spark, sf_dir):
    return predicted_from(spark, sf_dir, formats.encode, "fbz")


@query
def fbz_sparse_file_predict(spark, sf_dir):
    return predicted_from(spark, sf_dir, lambda m: formats.encode(m, sparse=True), "fbz")


@query
def flat_file_predict(spark, sf_dir):
    return predicted_from(spark, sf_dir, formats.encode_flat, "flat")


@query
def tmpy_file_predict(spark, sf_dir):
    return predicted_from(spark, sf_dir, formats.encode_tmpy, "tmpy")


@query
def model_directory_predict(spark, sf_dir):
    """Predictions of the model from a directory of Parquet tables."""
    df, m = fixture(spark, sf_dir)
    path = Folder(spark).path("model")
    catalogue.save_model(spark, m, path)
    return clauses.predict(df, COLUMNS, catalogue.load_model(spark, path)).select("row_id", "pred")


@query
def model_folder_scan(spark, sf_dir):
    """The clauses of all model files of a folder, decoded on the executors."""
    _, m = fixture(spark, sf_dir)
    folder = Folder(spark)
    for name, sparse in (("dense", False), ("sparse", True)):
        readers.write_bytes(spark, folder.path(f"{name}.fbz"), formats.encode(m, sparse))
    readers.write_bytes(spark, folder.path("notes.txt"), b"no model")
    found = readers.models(spark, folder.root)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "class", "sign", "clause", "clamp", F.size("pos").alias("n_pos"), F.size("neg").alias("n_neg"))


@query
def rule_json(spark, sf_dir):
    """The clauses of rule files in both JSON shapes."""
    _, m = fixture(spark, sf_dir)
    folder, out = Folder(spark), []
    for shape in ("listed", "mapped"):
        path = folder.path(f"{shape}.json")
        readers.write_bytes(spark, path, formats.to_rules_json(m, shape == "listed").encode())
        back = formats.rules_json(spark.read.text(path, wholetext=True).first()[0], m.feat, m.thresh)
        out += [(shape, k, s, c, w, ",".join(map(str, p)), ",".join(map(str, n))) for k, s, c, w, p, n in back.rows()]
    return spark.createDataFrame(out, "shape string, class int, sign int, clause int, clamp int, pos string, neg string")


@query
def binariser_tsv_scan(spark, sf_dir):
    _, m = fixture(spark, sf_dir)
    path = Folder(spark).path("binariser.tsv")
    readers.write_bytes(spark, path, "".join(f"{f}\t{np.float32(t)!s}\n" for f, t in zip(m.feat, m.thresh)).encode())
    return readers.binariser_tsv(spark, path)


@query
def binariser_json_scan(spark, sf_dir):
    """Thresholds of plain and of quantised binariser files."""
    _, m = fixture(spark, sf_dir)
    folder, out = Folder(spark), []
    for form in ("plain", "quantised"):
        path = folder.path(f"{form}.json")
        readers.write_bytes(spark, path, formats.binariser_json(m.feat, m.thresh, len(COLUMNS), 32, form == "quantised").encode())
        out.append(readers.binariser_json(spark, path).select(F.lit(form).alias("form"), "bit", "feat", F.round(F.col("thresh").cast("double"), 6).alias("thresh")))
    return out[0].unionByName(out[1])


@query
def parse_bool_text(spark, sf_dir):
    """The five low bits of each nation's key, written as 0, 1, true and FALSE, and read back."""
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    words = (("0", "1"), ("false", "true"), ("FALSE", "TRUE"))
    lines = [" ".join(words[(k + b) % 3][k >> b & 1] for b in range(5)) for k in keys]
    path = Folder(spark).path("bits.txt")
    readers.write_bytes(spark, path, "\n".join([*lines, ""]).encode())
    return readers.bool_rows(spark, path).select(F.col("row_id").cast("int").alias("row_id"), "bit", F.col("on").alias("on_"))


def supplier_files(spark, sf_dir) -> tuple[str, str]:
    """A matrix of keys, nations and balances, and a file of labels, by key."""
    folder = Folder(spark)
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey", "cast(s_suppkey as float) k", "cast(s_nationkey as float) n", "cast(s_acctbal as float) b", "cast(s_nationkey % 3 as int) y").orderBy("s_suppkey")
    readers.write_matrix(spark, d, ["k", "n", "b"], folder.path("x.bin"))
    readers.write_labels(spark, d, "y", folder.path("y.txt"))
    return folder.path("x.bin"), folder.path("y.txt")


@query
def raw_matrix_scan(spark, sf_dir):
    x, _ = supplier_files(spark, sf_dir)
    return readers.matrix(spark, x).select("row_id", *[F.round(F.col("x")[i].cast("double"), 2).alias(f"x{i}") for i in range(3)])


@query
def file_scores(spark, sf_dir):
    """Rows, accuracy and macro F1 of a tree over a matrix file, against a file of labels of the same rows."""
    x, y = supplier_files(spark, sf_dir)
    tree = {0: (0, 0.0, 1, 2, 0), 1: (-1, 0.0, -1, -1, 0), 2: (0, 5000.0, 3, 4, 0), 3: (-1, 0.0, -1, -1, 1), 4: (-1, 0.0, -1, -1, 2)}
    found = baselines.predict_tree(readers.matrix(spark, x).select("row_id", F.col("x")[2].alias("b")), tree, ["b"])
    c = metrics.confusion(readers.matched(found, readers.labels(spark, y)))
    told = c.agg(F.sum("n").alias("n_rows")).crossJoin(metrics.macro(c).select("f1"))  # one row each
    right = c.agg((F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return told.crossJoin(right).select("n_rows", F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


def shifted_tree(t: int) -> dict[int, tuple]:
    """A tree of depth three: node -> (feature, threshold, left, right, class)."""
    leaf = lambda k: (-1, 0.0, -1, -1, (k + t) % 3)
    return {0: (0, 25.0 + t, 1, 2, 0), 1: (1, 20000.0 + 500 * t, 3, 4, 0), 2: (2, 0.03, 5, 6, 0), 3: (2, 0.05, 7, 8, 0), 4: (3, 0.04, 9, 10, 0), 5: (1, 50000.0 - 500 * t, 11, 12, 0), 6: (3, 0.02, 13, 14, 0), 7: leaf(0), 8: leaf(1), 9: leaf(2), 10: leaf(0), 11: leaf(1), 12: leaf(2), 13: leaf(0), 14: leaf(1)}


SCALER = ([32.0, 32768.0, 0.0625, 0.03125], [16.0, 16384.0, 0.03125, 0.015625])
LINEAR = ([[2, -1, 3, -1], [-1, 2, 0, 1], [1, -1, -1, 2]], [1, 0, 2])


def perceptron():
    i, o = np.arange(64)[:, None], np.arange(8)
    w1 = ((i * 7 + o * 3) % 11 - 5) / 8
    w2 = ((np.arange(8)[:, None] * 5 + np.arange(10)) % 7 - 3) / 4
    return [(w1, np.zeros(8)), (w2, np.zeros(10))]


def archives(spark, sf_dir) -> dict[str, models.Arrays]:
    df = fx.line(spark, sf_dir)
    return {
        "tree": models.exported("tree", shifted_tree(0), scaler=SCALER),
        "forest": models.exported("forest", [shifted_tree(t) for t in range(5)]),
        "linear": models.exported("linear", *LINEAR, scaler=SCALER),
        "bayes": models.exported("bayes", baselines.gnb_fit(df, COLUMNS[:2]), COLUMNS[:2]),
        "perceptron": models.exported("perceptron", perceptron()),
    }


@query
def archive_scan(spark, sf_dir):
    """Cells and sums of the arrays of every model's archive in a folder; the archive of the test set is passed over."""
    folder = Folder(spark)
    for name, arrays in (archives(spark, sf_dir) | {"testset": {"X_te": np.zeros((2, 2))}}).items():
        readers.write_archive(spark, folder.path(f"{name}.npz"), arrays)
    found = readers.archive_tables(spark, folder.root, leave_out=("testset.npz",))
    return found.groupBy("file", "array").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query
def dispatch_scores(spark, sf_dir):
    """Predicted classes of every baseline from a table of models, scored by the kind that its arrays tell."""
    df = fx.line(spark, sf_dir)
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"))
    path = Folder(spark).path("models")
    models.model_table(spark, archives(spark, sf_dir)).write.parquet(path)
    out = None
    for name, arrays in sorted(models.from_table(spark.read.parquet(path)).items()):
        kind = models.kind_of(arrays)
        found = models.score(embeddings, arrays, ["x"]) if kind == "perceptron" else models.score(df, arrays, COLUMNS[:2] if kind == "bayes" else COLUMNS)
        told = found.groupBy("pred").agg(F.count("*").alias("n")).select(F.lit(name).alias("model"), F.lit(kind).alias("kind"), "pred", "n")
        out = told if out is None else out.unionByName(told)
    return out


@query
def dataset_registry(spark, sf_dir):
    """Rows of the data sets that are known and there; one that has no file is passed over."""
    known = catalogue.registry(spark, [("lines", "lineitem"), ("vectors", "embeddings"), ("stream", "events"), ("lost", "no_such_table")])
    found = catalogue.present(known, catalogue.listing(spark, sf_dir, ".parquet"), only=["lines", "vectors", "lost"]).orderBy("dataset").collect()  # a row a data set
    out = spark.createDataFrame([], "dataset string, n long")
    for r in found:
        out = out.unionByName(spark.read.parquet(f"{sf_dir}/{r.name}").agg(F.count("*").alias("n")).select(F.lit(r.dataset).alias("dataset"), "n"))
    return out
