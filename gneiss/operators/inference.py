"""Models applied in bulk. Keys and batches are ordinary columns; a model is loaded once for each worker."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.profile import LoadTimer

#: REST statuses after which a call is repeated, and how often.
RETRY_STATUS, RETRIES = (429, 503), 5

KINDS = {
    "regress": "float",
    "classify": "array<struct<label:string,score:float>>",
    "multi": "struct<classify:array<struct<label:string,score:float>>,regress:float>",
}


@dataclass(frozen=True)
class Signature:
    """What a model takes and gives: input names, and output names with their kinds (see KINDS, or a type)."""

    method: str
    inputs: tuple[str, ...]
    outputs: dict[str, str] = field(default_factory=dict)

    def __hash__(self):
        return hash((self.method, self.inputs, tuple(self.outputs.items())))


@dataclass(frozen=True)
class ModelSpec:
    """A model: a loader run on the workers, its signatures, and I11's batch limits.

    load(path) gives a function from a dict of arrays to a dict of arrays, first dimension the batch.
    """

    path: str
    signatures: tuple[Signature, ...]
    load: Callable[[str], Callable] | None = None
    client: Callable | None = None
    max_batch: int = 1000
    min_batch: int = 1

    def remote(self) -> bool:
        return self.client is not None


def validate(spec: ModelSpec) -> str:
    """The operation of a model's signatures: classify, regress, predict or multi."""
    if not spec.signatures:
        raise ValueError("a model needs a signature")
    inputs = {s.inputs for s in spec.signatures}
    if len(inputs) != 1:
        raise ValueError("all signatures must take the same input")
    for s in spec.signatures:
        if s.method not in ("classify", "regress", "predict"):
            raise ValueError(f"{s.method}: no such operation")
        if len(s.inputs) != 1 and s.method != "predict":
            raise ValueError("a signature takes one input")
        if s.method == "classify" and not (1 <= len(s.outputs) <= 2 and set(s.outputs) <= {"classes", "scores"}):
            raise ValueError("classify gives classes, scores, or both")
        if s.method == "regress" and len(s.outputs) != 1:
            raise ValueError("regress gives one output")
    if len(spec.signatures) == 1:
        return spec.signatures[0].method
    if any(s.method == "predict" for s in spec.signatures):
        raise ValueError("several signatures can only classify and regress")
    return "multi"


_loaded: dict = {}
LOADS = LoadTimer()  # L8: of this worker


def _token(spec: ModelSpec, override=None) -> tuple:
    """What tells a model apart on the workers, where functions are new objects in every task; made on the driver."""
    from pyspark import cloudpickle

    return spec.path, hashlib.sha256(cloudpickle.dumps(override or spec.load)).hexdigest()


def _model(spec: ModelSpec, override, token: tuple):
    if token not in _loaded:
        _loaded[token] = LOADS(override or spec.load, spec.path)
    return _loaded[token]


def _load_distribution() -> tuple:
    return LOADS.distribution()  # of the module that the worker has, not of a copy in a closure


def load_seconds(df: DataFrame, spec: ModelSpec, override=None) -> DataFrame:
    """(loads, min, max, sum): the seconds that the workers of df's partitions took to load a model."""

    token = _token(spec, override)

    def run(batches):
        for _ in batches:
            pass
        _model(spec, override, token)
        low, high, n, total = _load_distribution()
        yield pd.DataFrame({"pid": [os.getpid()], "n": [n], "low": [low], "high": [high], "total": [total]})

    workers = df.mapInPandas(run, "pid long, n long, low double, high double, total double").groupBy("pid").agg(F.max_by(F.struct("n", "low", "high", "total"), "n").alias("w"))
    return workers.agg(F.sum("w.n").alias("loads"), F.min("w.low").alias("min"), F.max("w.high").alias("max"), F.sum("w.total").alias("sum"))


def classified(out: dict, n: int) -> list:
    """Rows of {label, score} from classes and scores, each n x classes."""
    if not out:
        raise ValueError("classify gave neither classes nor scores")
    for name, a in out.items():
        if np.ndim(a) != 2 or len(a) != n:
            raise ValueError(f"{name} must be a batch of {n} by classes, not of shape {np.shape(a)}")
    classes, scores = out.get("classes"), out.get("scores")
    if scores is not None and np.asarray(scores).dtype.kind != "f":
        raise ValueError("scores must be floating")
    if classes is not None and scores is not None and np.shape(classes) != np.shape(scores):
        raise ValueError("classes and scores differ in shape")
    width = np.shape(classes if classes is not None else scores)[1]
    text = lambda x: x.decode() if isinstance(x, bytes) else str(x)
    return [
        [{"label": text(classes[i][j]) if classes is not None else None, "score": float(scores[i][j]) if scores is not None else None} for j in range(width)]
        for i in range(n)
    ]


def regressed(out, n: int) -> list:
    """One number a row, from shape [n] or [n, 1]."""
    a = np.asarray(out)
    if a.shape not in ((n,), (n, 1)):
        raise ValueError(f"regress must give {n} values, not shape {a.shape}")
    return a.reshape(n).astype(np.float32).tolist()


def predicted(out: dict, n: int) -> list[dict]:
    """I8: arbitrary outputs split by row."""
    for name, a in out.items():
        if not np.ndim(a) or len(a) != n:
            raise ValueError(f"{name}: first dimension {len(a) if np.ndim(a) else 0} is not the batch's {n}")
    return [{k: (v[i].tolist() if hasattr(v[i], "tolist") else v[i]) for k, v in out.items()} for i in range(n)]


def _apply(spec: ModelSpec, kind: str, batch: dict, n: int, override, token: tuple) -> list:
    run = _model(spec, override, token)
    if kind == "multi":  # I7: one result for each signature
        parts = {}
        for s in spec.signatures:
            out = run(batch, s)
            parts[s.method] = classified(out, n) if s.method == "classify" else regressed(next(iter(out.values())), n)
        return [{"classify": parts.get("classify", [None] * n)[i], "regress": parts.get("regress", [None] * n)[i]} for i in range(n)]
    out = run(batch, spec.signatures[0])
    if kind == "classify":
        return classified(out, n)
    if kind == "regress":
        return regressed(next(iter(out.values())), n)
    return predicted(out, n)


def result_type(spec: ModelSpec) -> str:
    kind = validate(spec)
    if kind == "predict":
        return "struct<" + ",".join(f"{k}:{t}" for k, t in spec.signatures[0].outputs.items()) + ">"
    return KINDS[kind]


def instance(features: dict) -> dict:
    """Features as JSON values: single values unwrapped, names ending in _bytes in base64, unset ones left out."""
    out = {}
    for name, v in features.items():
        if v is None:
            continue
        values = list(v) if isinstance(v, (list, tuple, np.ndarray)) else [v]
        if name.endswith("_bytes"):
            values = [{"b64": base64.b64encode(x if isinstance(x, bytes) else str(x).encode()).decode()} for x in values]
        else:
            values = [x.decode() if isinstance(x, bytes) else x.item() if hasattr(x, "item") else x for x in values]
        out[name] = values[0] if len(values) == 1 else values
    return out


class RemoteError(Exception):
    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}")
        self.status = status


def call_with_retries(call, *args, wait: float = 1.0, sleep=time.sleep):
    """Exponential backoff on 429 and 503, RETRIES times; other errors go up at once."""
    for attempt in range(RETRIES + 1):
        try:
            return call(*args)
        except RemoteError as e:
            if e.status not in RETRY_STATUS or attempt == RETRIES:
                raise
            sleep(wait * 2**attempt * (0.5 + random.random() / 2))


def rest_client(endpoint: str, headers: dict[str, str] | None = None, timeout: float = 60) -> Callable:
    """A client for remote_model() that posts instances to {endpoint}/projects/{project}/models/{model}:predict.

    The answer's "predictions" are returned; its "error", or a status that is none of success, is a RemoteError.
    """

    def call(project: str, model: str, instances: list[dict]) -> list[dict]:
        url = f"{endpoint.rstrip('/')}/projects/{project}/models/{model}:predict"
        body = json.dumps({"instances": instances}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                got = json.load(answer)
        except urllib.error.HTTPError as e:
            raise RemoteError(e.code, e.read().decode("utf-8", "replace")) from e
        if "error" in got:
            raise RemoteError(200, str(got["error"]))
        return got["predictions"]

    return call


def remote_model(project: str, model: str, client) -> Callable[[str], Callable]:
    """A loader for ModelSpec that calls client(project, model, instances), which gives a list of output dicts."""
    if not project or not model:
        raise ValueError("a remote model needs a project and a name")

    def load(path):
        def run(batch, signature):
            n = len(next(iter(batch.values())))
            rows = [instance({k: v[i] for k, v in batch.items()}) for i in range(n)]
            got = call_with_retries(client, project, model, rows)
            return {k: np.array([g[k] for g in got], dtype=object if got and isinstance(got[0][k], (list, str)) else None) for k in (got[0] if got else {})}

        return run

    return load


def _cuts(n: int, spec: ModelSpec) -> list[tuple[int, int]]:
    """N rows in batches of max_batch at most, as few as can be and of even sizes: so the smallest one is as large as it can be."""
    parts = -(-n // spec.max_batch)
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def handler(spec: ModelSpec, override=None) -> Callable[..., Column]:
    """I4: a function from input columns (in the order of the signature's inputs) to the prediction column."""
    kind, names, token = validate(spec), spec.signatures[0].inputs, _token(spec, override)

    @F.pandas_udf(result_type(spec))
    def predict(*columns: pd.Series) -> pd.Series:
        out: list = []
        for a, b in _cuts(len(columns[0]), spec):
            out += _apply(spec, kind, {n: c.iloc[a:b].to_numpy() for n, c in zip(names, columns)}, b - a, override, token)
        if kind in ("predict", "multi"):
            return pd.DataFrame(out, columns=list(spec.signatures[0].outputs) if kind == "predict" else ["classify", "regress"])
        return pd.Series(out)

    if kind in ("predict", "multi"):
        fn = predict.func

        def frame(*columns: pd.Series) -> pd.DataFrame:
            return fn(*columns)

        return F.pandas_udf(frame, result_type(spec))
    return predict


def run_inference(df: DataFrame, inputs: list[str], spec: ModelSpec, output: str = "prediction", override=None) -> DataFrame:
    """Df with predictions; whatever key it has stays as it is. A model that asks for a smallest batch gets rows of several
    Arrow batches of a task together (I11)."""
    if spec.min_batch > 1:
        return _in_full_batches(df, inputs, spec, output, override)
    return df.withColumn(output, handler(spec, override)(*inputs))


def _in_full_batches(df: DataFrame, inputs: list[str], spec: ModelSpec, output: str, override) -> DataFrame:
    """Batches of max_batch go as soon as enough rows are held back that any number of them and later ones can be cut evenly
    without falling below min_batch."""
    if spec.min_batch > spec.max_batch:
        raise ValueError("the smallest batch is larger than the largest")
    kind, names, token = validate(spec), spec.signatures[0].inputs, _token(spec, override)
    spare = spec.max_batch - spec.min_batch
    back = spec.min_batch * max(1, -(-(spec.min_batch - 1) // spare)) if spare else spec.min_batch  # from here on parts of k and k + 1 meet
    result = df.select(F.lit(None).cast(result_type(spec)).alias("r")).schema["r"].dataType
    columns = [c for c in df.columns if c != output]
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField(output, result)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow, held, n = to_arrow_type(result), [], 0

        def predicted_rows(table: pa.Table):
            for a, b in _cuts(table.num_rows, spec):
                part = table.slice(a, b - a).combine_chunks()
                rows = _apply(spec, kind, {name: part[c].to_pandas().to_numpy() for name, c in zip(names, inputs)}, b - a, override, token)
                if kind == "predict":
                    rows = [dict(zip(spec.signatures[0].outputs, r)) if isinstance(r, (list, tuple)) else r for r in rows]
                yield from part.append_column(output, pa.array(rows, arrow)).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            full = max(0, n - back) // spec.max_batch * spec.max_batch
            if full:
                table = pa.Table.from_batches(held)
                yield from predicted_rows(table.slice(0, full))
                held, n = table.slice(full).to_batches(), n - full
        if n:
            yield from predicted_rows(pa.Table.from_batches(held))

    return df.select(*columns).mapInArrow(run, schema)


def run_inference_per_model(df: DataFrame, inputs: list[str], specs: list[ModelSpec], output: str = "predictions", override=None) -> DataFrame:
    """Df with a struct m0, m1, .. of all models' predictions, in the order of the specs."""
    return df.withColumn(output, F.struct(*[handler(s, override)(*inputs).alias(f"m{i}") for i, s in enumerate(specs)]))


def run_inference_on_batches(df: DataFrame, examples: str, spec: ModelSpec, output: str = "predictions", override=None) -> DataFrame:
    """Df with a list of predictions for its list of examples, order kept; empty lists stay empty, nulls null.

    The lists are flattened inside each Arrow batch, so models see full batches and nothing is shuffled.
    """
    kind, name, token = validate(spec), spec.signatures[0].inputs[0], _token(spec, override)

    @F.pandas_udf(f"array<{result_type(spec)}>")
    def predict(lists: pd.Series) -> pd.Series:
        flat = [x for l in lists if l is not None for x in l]
        out: list = []
        for a, b in _cuts(len(flat), spec):
            part = np.empty(b - a, dtype=object)
            part[:] = flat[a:b]
            out += _apply(spec, kind, {name: part}, len(part), override, token)
        it = iter(out)
        return pd.Series([None if l is None else [next(it) for _ in l] for l in lists])

    return df.withColumn(output, predict(F.col(examples)))


def run_inference_per_model_on_batches(df: DataFrame, examples: str, specs: list[ModelSpec], output: str = "predictions", override=None) -> DataFrame:
    """A list of structs m0, m1, .. for each list of examples."""
    for i, s in enumerate(specs):
        df = run_inference_on_batches(df, examples, s, f"_m{i}", override)
    names = [f"_m{i}" for i in range(len(specs))]
    zipped = F.arrays_zip(*names)
    return df.withColumn(output, F.transform(zipped, lambda x: F.struct(*[x[n].alias(n[1:]) for n in names]))).drop(*names)


def linear(weights: list[float], bias: float = 0.0, name: str = "output") -> Callable[[str], Callable]:
    """A loader of a linear model over one input of vectors, or over as many scalar inputs as it has weights."""

    def load(path):
        w = np.array(weights, np.float64)

        def run(batch, signature):
            cols = list(batch.values())
            x = np.stack([np.asarray(c, np.float64) for c in cols], 1) if len(cols) > 1 or np.ndim(cols[0][0]) == 0 else np.stack([np.asarray(r, np.float64) for r in cols[0]])
            y = x @ w + bias
            if signature.method == "classify":
                return {"classes": np.array([["neg", "pos"]] * len(y)), "scores": np.stack([1 / (1 + np.exp(y)), 1 / (1 + np.exp(-y))], 1)}
            return {name: y}

        return run

    return load


def placement_bytes(size: int | None, workers: int = 100) -> int:
    """Memory that a model's copies take together; 1 GiB for a model of unknown size."""
    return (size or 1 << 30) * workers
