"""Slices, statistics predicates, and bulk inference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import inference as I
from gneiss.operators import slicing, stats


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "de", [1, 2], 30.0), (2, "fr", [2], 40.0), (3, None, [], 50.0), (4, "de", None, 5.0)], "id int, country string, tags array<int>, age double")


def test_slice_sql(people):
    run = lambda s: {r.row: [[tuple(p) for p in x] for x in r.slices] for r in slicing.slices_sql(people, "id", s).collect()}
    assert run("SELECT STRUCT(example.country)") == {1: [[("country", "de")]], 2: [[("country", "fr")]], 3: [[("country", None)]], 4: [[("country", "de")]]}
    got = run("SELECT STRUCT(example.country, tags) FROM example.tags WHERE tags > 1")
    assert got == {1: [[("country", "de"), ("tags", "2")]], 2: [[("country", "fr"), ("tags", "2")]], 3: [], 4: []}
    cross = run("SELECT STRUCT(a AS x, b AS y) FROM example.tags AS a, example.tags AS b")
    assert len(cross[1]) == 4 and len(cross[2]) == 1
    for bad in ("SELECT 1", "SELECT STRUCT(x) FROM other.f"):
        with pytest.raises(ValueError):
            slicing.slices_sql(people, "id", bad)


def test_slice_keys(people):
    count = lambda specs: {r.slice: r.n for r in slicing.slice_counts(people, specs).collect()}
    assert count([([], {})]) == {"": 4} == {r.slice: r.n for r in slicing.overall(people).collect()}
    assert count([(["country"], {})]) == {"country:de": 2, "country:fr": 1}
    assert count([(["tags", "country"], {})]) == {"tags:1,country:de": 1, "tags:2,country:de": 1, "tags:2,country:fr": 1}
    assert count([(["country"], {"age": "30"})]) == {"country:de,age:30": 1}
    assert count([([], {"tags": "2"})]) == {"tags:2": 2}
    assert len(slicing.all_slices(people, ["a", "b"])) == 4


def test_predicates(spark):
    s = stats.column_statistics(spark.range(10).selectExpr("cast(id as double) a", "id * 2.0 b"), ["a", "b"])
    assert [r.feature_id for r in slicing.unary_predicate(s, "feature.max > 10").collect()] == ["b"]
    got = slicing.binary_predicate(s, s, ["feature_id"], "feature_base.sum = feature_test.sum and feature_base.max < 10").collect()
    assert [r.feature_id for r in got] == ["a"]


def spec(method, load, inputs=("x",), outputs=None, more=(), **o):
    sigs = (I.Signature(method, inputs, outputs or {"output": "double"}), *more)
    return I.ModelSpec(f"m-{method}-{id(load)}", sigs, load, **o)


def test_regress_and_models(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "k int, x array<double>")
    one, two = spec("regress", I.linear([2.0, 1.0])), spec("regress", I.linear([0.0, 0.0], 7.0), max_batch=3)
    assert [r.prediction for r in I.run_inference(df, ["x"], one).orderBy("k").collect()] == [2 * i + 1 for i in range(10)]
    got = I.run_inference_per_model(df, ["x"], [one, two]).orderBy("k").collect()
    assert [tuple(r.predictions) for r in got] == [(2 * i + 1, 7) for i in range(10)]
    other = I.run_inference(df, ["x"], one, override=I.linear([1.0, 0.0])).orderBy("k").collect()
    assert [r.prediction for r in other] == list(range(10))


def test_classify_predict_multi(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "k int, x array<double>")
    c = spec("classify", I.linear([1.0]), outputs={"classes": "string", "scores": "float"})
    got = I.run_inference(df, ["x"], c).orderBy("k").collect()
    assert [x.label for x in got[0].prediction] == ["neg", "pos"] and got[0].prediction[1].score > 0.7
    p = spec("predict", I.linear([3.0], name="y"), outputs={"y": "double"})
    assert [r.prediction.y for r in I.run_inference(df, ["x"], p).orderBy("k").collect()] == [3.0, -3.0]
    m = spec("regress", I.linear([1.0]), more=(I.Signature("classify", ("x",), {"scores": "float"}),))
    r = I.run_inference(df, ["x"], m).orderBy("k").first().prediction
    assert r.regress == 1.0 and len(r.classify) == 2


def test_batches(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", []), ("c", None), ("d", [4.0])], "k string, x array<double>")
    one, two = spec("regress", I.linear([2.0]), max_batch=2), spec("regress", I.linear([0.0], 1.0))
    got = {r.k: r.predictions for r in I.run_inference_on_batches(df, "x", one).collect()}
    assert got == {"a": [2.0, 4.0, 6.0], "b": [], "c": None, "d": [8.0]}
    got = {r.k: r.predictions for r in I.run_inference_per_model_on_batches(df.where("x is not null"), "x", [one, two]).collect()}
    assert [tuple(x) for x in got["a"]] == [(2.0, 1.0), (4.0, 1.0), (6.0, 1.0)] and got["b"] == []


def test_validation():
    s = I.Signature
    for bad in (
        (), (s("rank", ("x",)),), (s("regress", ("a", "b"), {"o": "float"}),), (s("classify", ("x",), {}),), (s("regress", ("x",), {"a": "f", "b": "f"}),),
        (s("regress", ("x",), {"o": "f"}), s("predict", ("x",), {"o": "f"})), (s("regress", ("x",), {"o": "f"}), s("classify", ("y",), {"scores": "f"})),
    ):
        with pytest.raises(ValueError):
            I.validate(I.ModelSpec("m", bad, I.linear([1.0])))
    for f, arg in ((I.classified, {}), (I.classified, {"scores": np.zeros(3)}), (I.classified, {"scores": np.zeros((3, 2), int)}), (I.regressed, np.zeros((3, 2))), (I.predicted, {"y": np.zeros(2)})):
        with pytest.raises(ValueError):
            f(arg, 3)
    assert I.regressed(np.zeros((3, 1)), 3) == [0.0] * 3
    assert I.placement_bytes(None) == 100 << 30


def test_remote(spark):
    assert I.instance({"a": [1], "b": [1, 2], "c": None, "d_bytes": [b"hi"], "e": [b"t"]}) == {"a": 1, "b": [1, 2], "d_bytes": {"b64": "aGk="}, "e": "t"}
    waits, calls = [], []

    def flaky(status):
        def call():
            calls.append(1)
            if len(calls) < 3:
                raise I.RemoteError(status)
            return "ok"

        return call

    assert I.call_with_retries(flaky(503), sleep=waits.append) == "ok" and len(waits) == 2 and waits[1] > waits[0]
    calls.clear()
    with pytest.raises(I.RemoteError):
        I.call_with_retries(flaky(500), sleep=waits.append)
    with pytest.raises(ValueError):
        I.remote_model("", "m", None)

    def client(project, model, instances):
        return [{"y": float(i["x"]) * 10} for i in instances]

    remote = I.ModelSpec("r", (I.Signature("predict", ("x",), {"y": "double"}),), I.remote_model("p", "m", client), client)
    assert remote.remote()
    got = I.run_inference(spark.createDataFrame([(1.0,), (2.5,)], "x double"), ["x"], remote).collect()
    assert sorted(r.prediction.y for r in got) == [10.0, 25.0]


def test_slices_stay_with_their_rows(spark):
    """Null and repeated ids keep their own slices; several features are un-nested within the row."""
    rows = [(None, [1, 5], ["a"], 1), (None, [7], ["b", "c"], 1), (3, None, ["d"], 1), (3, [9], [], 0)]
    df = spark.createDataFrame(rows, "id long, q array<int>, w array<string>, ok int")
    got = slicing.slices_sql(df, "id", "SELECT STRUCT(q AS q, word AS w) FROM example.q, example.w AS word WHERE q > 4")
    plain = sorted(((r.row, [[(p.key, p.value) for p in s] for s in r.slices]) for r in got.collect()), key=repr)
    assert plain == sorted([(None, [[("q", "5"), ("w", "a")]]), (None, [[("q", "7"), ("w", "b")], [("q", "7"), ("w", "c")]]), (3, []), (3, [])], key=repr)
    whole = slicing.slices_sql(df, "id", "SELECT STRUCT(ok AS ok) WHERE example.ok = 1".replace("ok AS", "example.ok AS"))
    assert sorted(len(r.slices) for r in whole.collect()) == [0, 1, 1, 1]


def test_rest_client():
    """Instances posted as JSON, statuses as errors, and calls repeated where the service turns them away."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers["X-Key"]))
            status = 503 if len(seen) == 1 else 404 if "missing" in self.path else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"error": "no"} if "broken" in self.path else {"predictions": [{"y": 2 * i["x"]} for i in body["instances"]]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        call = I.rest_client(f"http://127.0.0.1:{server.server_port}/v1/", {"X-Key": "k"})
        assert I.call_with_retries(call, "p", "m", [{"x": 4}], sleep=lambda s: None) == [{"y": 8}]
        assert seen[0] == ("/v1/projects/p/models/m:predict", {"instances": [{"x": 4}]}, "k") and len(seen) == 2
        for name in ("missing", "broken"):
            with pytest.raises(I.RemoteError):
                I.call_with_retries(call, "p", name, [{"x": 1}], sleep=lambda s: None)
    finally:
        server.shutdown()


def test_batches_are_even():
    spec = I.ModelSpec("m", (), max_batch=10, min_batch=5)
    assert I._cuts(0, spec) == [] and I._cuts(10, spec) == [(0, 10)] and I._cuts(21, spec) == [(0, 7), (7, 14), (14, 21)]


@pytest.mark.parametrize("n,low,high", [(1, 5, 10), (9, 5, 10), (23, 5, 10), (1003, 64, 100), (1000, 100, 100), (0, 2, 3)])
def test_batch_limits_over_arrow_batches(spark, n, low, high):
    def load(path):
        return lambda batch, signature: {"n": [len(batch["x"])] * len(batch["x"]), "x": batch["x"]}

    spec = I.ModelSpec("sized", (I.Signature("predict", ("x",), {"n": "bigint", "x": "bigint"}),), load, max_batch=high, min_batch=low)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = I.run_inference(spark.range(0, n, 1, 1).withColumn("k", F.concat(F.lit("k"), "id")), ["id"], spec).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.id, r.k, r.prediction.x) for r in got] == [(i, f"k{i}", i) for i in range(n)]
    assert all(r.prediction.n <= high and (r.prediction.n >= low or n < low) for r in got)
    with pytest.raises(ValueError):
        I.run_inference(spark.range(1), ["id"], I.ModelSpec("sized", spec.signatures, load, max_batch=2, min_batch=3))
