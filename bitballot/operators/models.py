"""Baseline models as named arrays: exporters, detection of the kind, and scoring by kind.

The names of the arrays are fixed by the archives; a kind is told by the arrays that only it has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitballot.operators import baselines

Arrays = dict[str, np.ndarray]
#: An array of each kind that no kind below it has.
TOLD_BY = {"forest": "tree_roots", "tree": "leaf_cls", "linear": "coef", "bayes": "theta", "perceptron": "n_layers", "neighbours": "X_train"}
#: The kinds that score scaled features.
SCALED = ("linear", "bayes", "neighbours")
#: The least variance of a Gaussian.
LEAST = 1e-9


def kind_of(arrays) -> str | None:
    """The kind of a model by its arrays; None if it is none of them."""
    return next((kind for kind, name in TOLD_BY.items() if name in arrays), None)


def node_arrays(trees: list[dict[int, tuple]]) -> Arrays:
    """The nodes of trees in a row; the children of a tree's nodes shifted by the nodes before it, those of leaves -1."""
    rows, roots = [], []
    for nodes in trees:
        at = {node: len(rows) + i for i, node in enumerate(sorted(nodes))}
        roots.append(len(rows))
        rows += [(f, t, at.get(a, -1), at.get(b, -1), c) for f, t, a, b, c in (nodes[n] for n in sorted(nodes))]
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (("feat", np.int32), ("thresh", np.float32), ("left", np.int32), ("right", np.int32), ("leaf_cls", np.int32))
    return {name: np.array(c, kind) for (name, kind), c in zip(kinds, columns)} | {"tree_roots": np.array(roots, np.int32)}


def export_tree(nodes: dict[int, tuple]) -> Arrays:
    return {name: a for name, a in node_arrays([nodes]).items() if name != "tree_roots"}


def export_forest(trees: list[dict[int, tuple]]) -> Arrays:
    return node_arrays(trees)


def export_linear(coef, intercept) -> Arrays:
    return {"coef": np.atleast_2d(np.asarray(coef, np.float64)), "intercept": np.atleast_1d(np.asarray(intercept, np.float64))}


def export_bayes(model: DataFrame, columns: list[str]) -> Arrays:
    """Of ``baselines.gnb_fit``, a row a class."""
    rows = model.orderBy("class").collect()
    total = sum(r["n"] for r in rows)
    of = lambda what: np.array([[r[f"{what}_{c}"] for c in columns] for r in rows], np.float64)
    return {"theta": of("mean"), "var": np.maximum(of("var"), LEAST), "class_log_prior": np.log([r["n"] / total for r in rows]), "classes": np.array([r["class"] for r in rows], np.int32)}


def export_perceptron(layers) -> Arrays:
    return {"n_layers": np.array([len(layers)], np.int32)} | {f"{name}{i}": np.asarray(a, np.float64) for i, layer in enumerate(layers) for name, a in zip("Wb", layer)}


def export_neighbours(train: DataFrame, k: int, limit: int = 100_000) -> Arrays:
    """An archive holds its training rows, so they are few; more than ``limit`` are refused, and belong in a table."""
    rows = train.select("vec_id", "x", "y").orderBy("vec_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} training rows for an archive")
    return {"X_train": np.array([r.x for r in rows], np.float32), "y_train": np.array([r.y for r in rows], np.int32), "k": np.array([k], np.int32), "n_cls": np.array([1 + max((r.y for r in rows), default=-1)], np.int32)}


def export_scaler(mean, scale) -> Arrays:
    return {"scaler_mean": np.asarray(mean, np.float64), "scaler_scale": np.asarray(scale, np.float64)}


#: Exporter of each kind; those in SCALED take a scaler's arrays beside their own.
EXPORTERS: dict[str, Callable[..., Arrays]] = {"tree": export_tree, "forest": export_forest, "linear": export_linear, "bayes": export_bayes, "perceptron": export_perceptron, "neighbours": export_neighbours}


def exported(kind: str, *model, scaler: tuple | None = None) -> Arrays:
    """The arrays of a model; a scaler only goes with the kinds that need one."""
    if kind not in EXPORTERS:
        raise ValueError(f"no exporter for {kind}")
    return EXPORTERS[kind](*model) | (export_scaler(*scaler) if scaler and kind in SCALED else {})


def model_table(spark: SparkSession, models: dict[str, Arrays]) -> DataFrame:
    """model, array, i, j, value: the arrays of small models as a table (a vector has j = 0), for Parquet."""
    rows = [(name, array, i, j, float(v)) for name, arrays in sorted(models.items()) for array, a in sorted(arrays.items()) for (i, j), v in np.ndenumerate(np.atleast_1d(a).reshape(len(np.atleast_1d(a)), -1))]
    return spark.createDataFrame(rows, "model string, array string, i int, j int, value double")


def from_table(table: DataFrame) -> dict[str, Arrays]:
    """The models of a ``model_table``; all arrays in double precision, those of one column as vectors."""
    out: dict[str, dict[str, list]] = {}
    for r in table.orderBy("model", "array", "i", "j").collect():  # small models
        out.setdefault(r["model"], {}).setdefault(r["array"], []).append((r["i"], r["value"]))
    return {m: {a: np.array([v for _, v in cells]).reshape(len({i for i, _ in cells}), -1) for a, cells in arrays.items()} for m, arrays in out.items()}


def parameters(arrays: Arrays) -> int:
    """Numbers that a model holds."""
    return sum(int(np.size(a)) for a in arrays.values())


def trees_of(arrays: Arrays) -> list[dict[int, tuple]]:
    flat = {k: np.ravel(arrays[k]) for k in ("feat", "thresh", "left", "right", "leaf_cls")}
    roots = [int(r) for r in np.ravel(arrays.get("tree_roots", [0]))]
    out = []
    for start, end in zip(roots, [*roots[1:], len(flat["feat"])]):
        step = lambda v, start=start: int(v) - start if v >= 0 else -1
        out.append({i - start: (int(flat["feat"][i]), float(flat["thresh"][i]), step(flat["left"][i]), step(flat["right"][i]), int(flat["leaf_cls"][i])) for i in range(start, end)})
    return out


def features(columns: list[str], arrays: Arrays) -> list[Column]:
    if "scaler_mean" not in arrays:
        return [F.col(c).cast("double") for c in columns]
    return baselines.scaled(columns, np.ravel(arrays["scaler_mean"]).tolist(), np.ravel(arrays["scaler_scale"]).tolist())


def score(df: DataFrame, arrays: Arrays, columns: list[str], key: str = "row_id") -> DataFrame:
    """key, pred by the kind of the arrays: scalar columns, or for perceptrons and neighbours one array column."""
    kind = kind_of(arrays)
    if kind in ("tree", "forest"):
        trees = trees_of(arrays)
        found = baselines.predict_tree(df, trees[0], columns, (key,)) if kind == "tree" else baselines.predict_forest(df, trees, columns, (key,))
    elif kind == "linear":
        found = baselines.predict_linear(df, features(columns, arrays), np.atleast_2d(arrays["coef"]).tolist(), np.ravel(arrays["intercept"]).tolist(), (key,))
    elif kind == "bayes":
        names = [f"x{i}" for i in range(len(columns))]
        fields = [F.col(key), *[x.alias(n) for n, x in zip(names, features(columns, arrays))]]
        rows = [(int(c), float(np.exp(p)), *map(float, m), *map(float, v)) for c, p, m, v in zip(np.ravel(arrays["classes"]), np.ravel(arrays["class_log_prior"]), np.atleast_2d(arrays["theta"]), np.atleast_2d(arrays["var"]))]
        schema = ", ".join(["class int", "n double", *[f"mean_{n} double" for n in names], *[f"var_{n} double" for n in names]])
        found = baselines.predict_gnb(df.select(*fields), df.sparkSession.createDataFrame(rows, schema), names, (key,))
    elif kind == "perceptron":
        layers = [(np.atleast_2d(arrays[f"W{i}"]), np.ravel(arrays[f"b{i}"])) for i in range(int(np.ravel(arrays["n_layers"])[0]))]
        found = baselines.predict_mlp(df, columns[0], layers, (key,))
    elif kind == "neighbours":
        x, y = np.atleast_2d(arrays["X_train"]), np.ravel(arrays["y_train"])
        train = df.sparkSession.createDataFrame([(i, list(map(float, v)), int(c)) for i, (v, c) in enumerate(zip(x, y))], "vec_id long, x array<double>, y int")
        found = baselines.predict_knn(df.select(F.col(key).alias("vec_id"), F.col(columns[0]).cast("array<double>").alias("x")), train, int(np.ravel(arrays["k"])[0])).withColumnRenamed("vec_id", key)
    else:
        raise ValueError("arrays of no known kind")
    return found.select(key, "pred")
