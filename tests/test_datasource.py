"""Record files by format: planning, pruning, pushdown, and a sink that commits."""

import os
import subprocess
import sys
import textwrap

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.sources import datasource, examples, wire

ROWS = [
    (1, "a", [1.5, 2.5], [b"x"], None),
    (2, None, None, [], [7]),
    (3, "ccc", [], None, [1, 2, 3]),
    (None, "ü", [0.25], [b"", b"yy"], []),
]
SCHEMA = "id long, name string, f array<float>, b array<binary>, i array<long>"


@pytest.fixture(scope="module")
def formats(spark):
    datasource.register(spark)
    return spark


@pytest.fixture
def folder(formats, tmp_path):
    path = str(tmp_path / "records")
    formats.createDataFrame(ROWS, SCHEMA).repartition(2).write.format("record_examples").mode("append").save(path)
    return path


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_round_trip_and_pruning(formats, folder):
    read = formats.read.format("record_examples")
    assert rows(read.schema(SCHEMA).load(folder)) == sorted(repr(tuple(r)) for r in formats.createDataFrame(ROWS, SCHEMA).collect())
    assert rows(read.schema("i array<long>, missing string").load(folder)) == sorted(repr((r[4], None)) for r in ROWS)
    names = [f for f in os.listdir(folder) if not f.startswith(".")]
    assert len(names) == 2 and all(n.startswith("part-") for n in names)
    again = examples.decode_examples(formats.read.format("record_bytes").load(folder), "record", {"id": "INT", "b": "BYTES"})
    assert again.where("id is null").count() == 1


def test_inferred_schema(formats, folder):
    got = formats.read.format("record_examples").load(folder)
    assert got.schema.simpleString() == "struct<b:array<binary>,f:array<float>,i:array<bigint>,id:array<bigint>,name:array<binary>>"
    assert sorted(r.id[0] for r in got.where("id is not null").collect()) == [1, 2, 3]


def test_own_columns(formats, folder):
    got = formats.read.format("record_examples").schema("id long, _file string, _pos long, _record binary").load(folder).collect()
    assert len(got) == 4 and {r._pos for r in got} <= {0, 1, 2, 3} and len({r._file for r in got}) == 2
    assert all(wire.parse_example(r._record)["id"][1] in ([r.id], None) for r in got)
    one = got[0]._file
    some = datasource.read(formats, "examples", folder, "id long, _file string", [("_file", "=", one)])
    assert sorted(repr(r.id) for r in some.collect()) == sorted(repr(r.id) for r in got if r._file == one)
    assert some.rdd.getNumPartitions() == 1


@pytest.mark.parametrize(
    "sql,where",
    [
        ("id = 2", [("id", "=", 2)]), ("id > 1", [("id", ">", 1)]), ("id >= 1 and id < 3", [("id", ">=", 1), ("id", "<", 3)]), ("id <= 2", [("id", "<=", 2)]),
        ("id in (1, 3, 9)", [("id", "in", [1, 3, 9])]), ("name = 'ü'", [("name", "=", "ü")]), ("id is null", [("id", "is null")]), ("f is not null", [("f", "is not null")]),
        ("b is null and id > 0", [("b", "is null"), ("id", ">", 0)]), ("id != 1", [("id", "!=", 1)]), ("name > 'a'", [("name", ">", "a")]), ("false", [("id", "in", [])]),
    ],
)
def test_conditions(formats, folder, sql, where):
    df = datasource.read(formats, "examples", folder, SCHEMA, where)
    whole = datasource.read(formats, "examples", folder, SCHEMA)
    want = rows(formats.createDataFrame(ROWS, SCHEMA).where(sql))
    assert rows(df) == want and rows(whole.where(sql)) == want and whole.count() == 4


def test_conditions_that_cannot_be_given(formats, folder):
    for bad in (("f", "=", 1.0), ("none", "=", 1), ("id", "like", 1)):
        with pytest.raises(Exception, match=bad[0] if bad[1] == "=" else "like"):
            datasource.read(formats, "examples", folder, SCHEMA, [bad]).collect()


def test_decoding_stops_at_filters(formats, folder):
    """A column that can't be decoded does no harm where its records are filtered out."""
    read = lambda where: datasource.read(formats, "examples", folder, "id long, i long", where).collect()
    assert [tuple(r) for r in read([("id", "=", 2)])] == [(2, 7)]
    with pytest.raises(Exception, match="several values"):
        read([])


def test_sequences_and_bytes(formats, tmp_path):
    path = str(tmp_path / "s")
    schema = f"conv array<long>, `{examples.SEQUENCE}` struct<role:array<array<binary>>,n:array<array<long>>>"
    data = [([1], ([[b"u"], [b"a", b"b"]], [[1], []])), (None, (None, [[2, 3]])), ([], ([], None))]
    df = formats.createDataFrame(data, schema)
    df.write.format("record_sequences").mode("append").option("compression", "gzip").save(path)
    assert all(f.endswith(".rec.gz") for f in os.listdir(path) if f.startswith("part"))
    assert rows(formats.read.format("record_sequences").schema(schema).load(path)) == rows(df)
    inferred = formats.read.format("record_sequences").load(f"{path}/part-*")
    assert rows(inferred.select("conv", f"{examples.SEQUENCE}.role")) == rows(df.select("conv", f"{examples.SEQUENCE}.role"))
    raw = str(tmp_path / "r")
    formats.createDataFrame([(b"",), (b"abc",)], "record binary").write.format("record_bytes").mode("append").save(raw)
    got = formats.read.format("record_bytes").schema("_pos long, record binary").load(raw).collect()
    assert sorted(r.record for r in got) == [b"", b"abc"]


def test_small_files_are_packed_and_large_ones_stand_apart(formats, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(1000):
        (folder / f"s{i:04d}.rec").write_bytes(wire.frame([f"{i}".encode()]))
    (folder / "large.rec").write_bytes(wire.frame([b"x" * 1000] * 3000))
    (folder / "_hidden").write_bytes(b"no records")
    read = formats.read.format("record_bytes").option("partitionBytes", 200_000).option("openBytes", 1000).schema("_file string, record binary")
    df = read.load(str(folder))
    assert df.count() == 4000
    parts = datasource.planned(datasource.list_files(str(folder)), 200_000, 1000)
    sizes = sorted(sum(1000 + os.path.getsize(f) for f in p) for p in parts)
    assert [p for p in parts if any("large" in f for f in p)] == [[str(folder / "large.rec")]]
    assert 4 < len(parts) < 30 and sizes[-2] <= 1.1 * sizes[0]
    assert df.rdd.getNumPartitions() == len(parts)
    assert read.load(f"{folder}/s00[0-1]?.rec").count() == 20
    assert read.load(f"{folder}/none-*").count() == 0


def test_overwrite_and_append(formats, tmp_path):
    path = str(tmp_path / "w")
    df = formats.range(10).select("id")
    read = lambda: sorted(r.id for r in formats.read.format("record_examples").schema("id long").load(path).collect())
    df.write.format("record_examples").mode("append").save(path)
    df.write.format("record_examples").mode("append").save(path)
    assert read() == sorted([*range(10)] * 2)
    df.limit(3).write.format("record_examples").mode("overwrite").save(path)
    assert read() == [0, 1, 2]
    assert not [f for f in os.listdir(path) if f.startswith("_temporary")]


def test_what_cannot_be_written(formats, tmp_path):
    for df in (formats.range(1).select(F.struct("id").alias("s")), formats.range(1).select(F.array(F.array("id")).alias("s")), formats.range(1).select(F.current_date().alias("s"))):
        with pytest.raises(Exception, match="s"):
            df.write.format("record_examples").mode("append").save(str(tmp_path / "x"))
    with pytest.raises(Exception, match="record binary"):
        formats.range(1).write.format("record_bytes").mode("append").save(str(tmp_path / "x"))


def test_commit_takes_only_named_files(tmp_path):
    """Two attempts of one task, of which one is committed; an abort leaves nothing."""
    schema = T.StructType([T.StructField("id", T.LongType())])
    make = lambda: datasource.Writer("examples", schema, {"path": str(tmp_path)}, False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3])], ["id"])
    w = make()

    def fails():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(fails())
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    assert lost.file != kept.file
    w.commit([kept, None, datasource.Written(None, 0)])
    files = [f for f in os.listdir(tmp_path)]
    assert len(files) == 1 and len(wire.unframe((tmp_path / files[0]).read_bytes())) == 3
    v = make()
    v.write(iter([batch]))
    v.abort([])
    assert os.listdir(tmp_path) == files


def test_a_task_that_fails_once_leaves_no_second_copy(tmp_path):
    """In a session of its own whose tasks may fail: each task fails halfway in its first attempt."""
    script = f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from gneiss.sources import datasource
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "100").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        datasource.register(spark)
        whole = datasource.Writer._records
        def failing(self, batch):
            task = TaskContext.get()
            if task.attemptNumber() == 0 and batch.column(0)[-1].as_py() % 500 > 300:
                raise RuntimeError("lost halfway")
            return whole(self, batch)
        class Fails(datasource.Writer):
            _records = failing
        class Source(datasource.Examples):
            @classmethod
            def name(cls):
                return "failing"
            def writer(self, schema, overwrite):
                return Fails(self.form, schema, dict(self.options), overwrite)
        spark.dataSource.register(Source)
        spark.range(0, 2000, 1, 4).write.format("failing").mode("append").save({str(tmp_path / "out")!r})
        got = sorted(r.id for r in spark.read.format("record_examples").schema("id long").load({str(tmp_path / "out")!r}).collect())
        assert got == list(range(2000)), len(got)
        print("whole")
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=240, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))})
    assert "whole" in done.stdout, done.stderr[-3000:]
    assert len(os.listdir(tmp_path / "out")) == 4
