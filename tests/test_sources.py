"""CSV, record files, codecs, Parquet and in-memory datasets."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.plans.features import Feature, FeatureSchema
from gneiss.sources import csv, examples, records, tables, wire

INT, MIN, MAX = "INT", -(2**63), 2**63 - 1


def decoded(spark, lines, form, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    out = csv.decode(df, "line", form, keep=["i"], **options).orderBy("i")
    plain = lambda v: v.decode() if isinstance(v, (bytes, bytearray)) else v
    return [tuple([plain(y) for y in v] if v is not None else None for v in r[1:]) for r in out.collect()]


def types(spark, lines, form):
    return list(csv.infer_types(spark.createDataFrame([(x,) for x in lines], "line string"), "line", form).values())


def form(n, **o):
    return csv.CsvFormat(tuple(f"f{i}" for i in range(1, n + 1)), **o)


M = dict(multivalent=("f1",), secondary="|")


@pytest.mark.parametrize(
    "lines,options,kinds,rows",
    [
        ([",,", "1,,hello", ",12.34,"], {}, ["INT", "FLOAT", "BYTES"], [(None, None, None), ([1], None, ["hello"]), (None, [np.float32(12.34)], None)]),
        ([f"{MIN},{MAX},{MIN - 1},{MAX + 1}"], {}, ["INT", "INT", "BYTES", "BYTES"], [([MIN], [MAX], [str(MIN - 1)], [str(MAX + 1)])]),
        (["", "1,2"], {}, ["INT", "INT"], [([1], [2])]),
        (["", "1,2"], dict(skip_blank_lines=False), ["INT", "INT"], [(None, None), ([1], [2])]),
        ([], {}, ["UNKNOWN", "UNKNOWN"], []),
        (["", ""], dict(skip_blank_lines=False), ["UNKNOWN"], [(None,), (None,)]),
        (["12|14"], M, ["INT"], [([12, 14],)]),
        (["|,test"], M, ["UNKNOWN", "BYTES"], [(None, ["test"])]),
        (["|,test", "a|b,test"], M, ["BYTES", "BYTES"], [(["", ""], ["test"]), (["a", "b"], ["test"])]),
        (["1|2.3,test"], M, ["FLOAT", "BYTES"], [([1.0, np.float32(2.3)], ["test"])]),
        (["1|abc,test", "2|2,test"], M, ["BYTES", "BYTES"], [(["1", "abc"], ["test"]), (["2", "2"], ["test"])]),
        (['1,"ab,cd,ef"', '5,"wx""xy,yz"', '9,""'], {}, ["INT", "BYTES"], [([1], ["ab,cd,ef"]), ([5], ['wx"xy,yz']), ([9], None)]),
        (["1 \"ab\""], dict(delimiter=" "), ["INT", "BYTES"], [([1], ["ab"])]),
        ([" 1 ,1_000,nan,1d"], {}, ["INT", "INT", "FLOAT", "BYTES"], None),
        (["+5,-.5e3,1_0.5,Infinity"], {}, ["INT", "FLOAT", "FLOAT", "FLOAT"], [([5], [-500.0], [10.5], [float("inf")])]),
        (["é,☃"], {}, ["BYTES", "BYTES"], [(["é"], ["☃"])]),
        (["007,1__0,-0"], {}, ["INT", "BYTES", "INT"], [([7], ["1__0"], [0])]),
    ],
)
def test_csv(spark, lines, options, kinds, rows):
    f = form(len(kinds), **options)
    assert types(spark, lines, f) == kinds
    if rows is not None:
        assert decoded(spark, lines, f) == rows


def test_csv_errors_and_schema(spark):
    with pytest.raises(Exception, match="should have 2 cells"):
        decoded(spark, ["1,2,3"], form(2))
    with pytest.raises(Exception, match="should have 2 cells"):
        types(spark, ["1"], form(2))
    with pytest.raises(ValueError):
        form(2, multivalent=("f1",))
    with pytest.raises(ValueError):
        decoded(spark, ["1"], form(1), raw_record="f1")
    schema = FeatureSchema((Feature("f2", "FLOAT"),))
    assert decoded(spark, ["1,2,x"], form(3), schema=schema) == [([2.0],)]
    assert csv.spark_schema(("f1", "f2"), schema, "raw").simpleString() == "struct<f2:array<float>,raw:array<binary>>"
    for bad in (FeatureSchema((Feature("no", "INT"),)), FeatureSchema((Feature("f1", "STRUCT"),))):
        with pytest.raises(ValueError):
            csv.types_from_schema(("f1", "f2"), bad)
    got = decoded(spark, ["", "1"], form(1, skip_blank_lines=False), schema=FeatureSchema((Feature("f1", "INT"),)), raw_record="raw")
    assert got == [(None, [""]), ([1], ["1"])]


def test_csv_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text("h1,h2\nx,y\n" + "".join(f"{i},{k}\n" for k in range(3)))
    df = csv.read(spark, str(tmp_path), form(2), skip_header_lines=2)
    assert sorted((r.f1[0], r.f2[0]) for r in df.collect()) == [(i, k) for i in range(2) for k in range(3)]
    with pytest.raises(ValueError):
        csv.read(spark, [], form(1))


EXAMPLES = [
    {"x": ("BYTES", [b"a", b"b"]), "y": ("FLOAT", [1.0, 2.0]), "z": ("INT", [4, 5])},
    {"w": (None, None), "x": (None, None), "y": (None, None), "z": (None, None)},
    {"v": ("FLOAT", [1.0])},
    {"x": ("BYTES", []), "y": ("FLOAT", []), "z": ("INT", [])},
]


def example_frame(spark, rows=EXAMPLES):
    return spark.createDataFrame([(i, wire.build_example(r)) for i, r in enumerate(rows)], "i int, record binary")


def test_examples_without_schema(spark):
    out = examples.decode_examples(example_frame(spark), "record", keep=["i"]).orderBy("i")
    assert out.columns == ["i", "v", "w", "x", "y", "z"] and isinstance(out.schema["w"].dataType, T.NullType)
    assert [tuple(r)[1:] for r in out.collect()] == [
        (None, None, [b"a", b"b"], [1.0, 2.0], [4, 5]), (None,) * 5, ([1.0], None, None, None, None), (None, None, [], [], []),
    ]


def test_examples_with_schema(spark):
    s = FeatureSchema((Feature("a", "INT"), Feature("x", "BYTES"), Feature("y", "FLOAT")))
    out = examples.decode_examples(example_frame(spark), "record", s, raw_record="raw", keep=["i"]).orderBy("i")
    rows = out.collect()
    assert [tuple(r)[1:4] for r in rows] == [(None, [b"a", b"b"], [1.0, 2.0]), (None, None, None), (None, None, None), (None, [], [])]
    assert wire.parse_example(bytes(rows[0].raw[0])) == EXAMPLES[0]
    with pytest.raises(Exception, match="feature x"):
        examples.decode_examples(example_frame(spark), "record", {"x": "INT"}).collect()
    with pytest.raises(Exception, match="several kinds"):
        examples.decode_examples(example_frame(spark, [{"x": ("INT", [1])}, {"x": ("FLOAT", [1.0])}]), "record")
    with pytest.raises(Exception, match="Unable to parse example"):
        examples.decode_examples(spark.createDataFrame([(b"\xff\xff",)], "record binary"), "record", {"x": "INT"}).collect()


def test_wire():
    big = {"i": ("INT", [MIN, MAX, -1, 0, 2**40]), "f": ("FLOAT", [0.5]), "b": ("BYTES", [b"", b"\x00\xff"])}
    assert wire.parse_example(wire.build_example(big)) == big
    unpacked = wire._delimited(1, wire._delimited(1, wire._delimited(1, b"k") + wire._delimited(2, wire._delimited(3, b"\x08\x05\x08\x07"))))
    assert wire.parse_example(unpacked) == {"k": ("INT", [5, 7])}
    got = examples.example_to_numpy(wire.build_example(EXAMPLES[0] | {"u": (None, None)}))
    assert got["u"] is None and got["z"].dtype == np.int64 and got["y"].dtype == np.float32
    assert int(wire.crc32c([b"123456789"])[0]) == 0xE3069283
    data = wire.frame([b"", b"abc", b"x" * 1000])
    assert wire.unframe(data, verify=True) == [b"", b"abc", b"x" * 1000]
    for bad in (data[:-1], data[:5]):
        with pytest.raises(ValueError):
            wire.unframe(bad)
    with pytest.raises(ValueError, match="checksum"):
        wire.unframe(data.replace(b"abc", b"abd"), verify=True)
    assert struct.unpack_from("<Q", data)[0] == 0


def test_encode(spark):
    df = spark.createDataFrame([([1, 2], None, [b"x"]), ([], [0.5], None)], "i array<bigint>, f array<float>, b array<binary>")
    got = [wire.parse_example(bytes(r.record)) for r in examples.encode_examples(df).collect()]
    assert got == [{"i": ("INT", [1, 2]), "f": (None, None), "b": ("BYTES", [b"x"])}, {"i": ("INT", []), "f": ("FLOAT", [0.5]), "b": (None, None)}]
    for schema in ("d array<double>", "s int", "n array<array<int>>"):
        with pytest.raises((TypeError, ValueError)):
            examples.encode_examples(spark.createDataFrame([], schema))


def test_encode_ragged(spark):
    df = spark.createDataFrame([([[[1, 2], [3, 4]], [[5, 6]]],), (None,)], "r array<array<array<bigint>>>")
    enc = examples.encode_examples(df, partitions={"r": ("values", [("lengths", "rows"), ("uniform", 2)])})
    got = [wire.parse_example(bytes(r.record)) for r in enc.collect()]
    assert got[0] == {"values": ("INT", [1, 2, 3, 4, 5, 6]), "rows": ("INT", [2, 1])}
    assert got[1] == {"values": (None, None), "rows": (None, None)}
    with pytest.raises(ValueError):
        examples.encode_examples(df, partitions={"r": ("values", [("uniform", 2)])})


def test_sequences(spark):
    rows = [
        ({"int_feature": ("INT", [1]), "float_feature": ("FLOAT", [1, 2, 3, 4])}, {"int_feature": [("INT", [1, 2]), ("INT", [3])]}),
        ({"int_feature": ("INT", [2]), "float_feature": ("FLOAT", [2, 3, 4, 5])}, {"string_feature": [("BYTES", [b"foo", b"bar"]), ("BYTES", [])]}),
        ({"int_feature": ("INT", [3])}, {"int_feature": [("INT", [4])], "string_feature": [("BYTES", [b"baz"])]}),
        ({}, {"int_feature": [], "string_feature": [(None, None)]}),
    ]
    df = spark.createDataFrame([(i, wire.build_sequence(*r)) for i, r in enumerate(rows)], "i int, record binary")
    want = [
        ([1], [1, 2, 3, 4], Row(int_feature=[[1, 2], [3]], string_feature=None)), ([2], [2, 3, 4, 5], Row(int_feature=None, string_feature=[[b"foo", b"bar"], []])),
        ([3], None, Row(int_feature=[[4]], string_feature=[[b"baz"]])), (None, None, Row(int_feature=[], string_feature=[None])),
    ]
    schema = FeatureSchema((Feature("int_feature", "INT"), Feature("float_feature", "FLOAT"), Feature(examples.SEQUENCE, "STRUCT", children=(Feature("int_feature", "INT"), Feature("string_feature", "BYTES")))))
    for s in (schema, None):
        out = examples.decode_sequences(df, "record", s, keep=["i"]).orderBy("i")
        cols = ["int_feature", "float_feature", f"`{examples.SEQUENCE}`"]
        assert [tuple(r) for r in out.select(*cols).collect()] == want and out.columns[-1] == examples.SEQUENCE
    again = examples.decode_sequences(examples.encode_sequences(out.drop("i")), "record", schema)
    assert sorted(map(repr, again.select(*cols).collect())) == sorted(map(repr, out.select(*cols).collect()))
    with pytest.raises(ValueError):
        examples.decode_sequences(df, "record", FeatureSchema((Feature(examples.SEQUENCE, "INT"),)))


def test_sequences_by_pieces(spark, monkeypatch):
    """Python's objects are made of few rows at a time, however large a batch is; a long row stands alone."""
    runs, frame = [], type(spark.range(1))
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: runs.append(f) or whole(self, f, *a, **k))
    df = spark.createDataFrame([], f"c array<bigint>, `{examples.SEQUENCE}` struct<t: array<array<binary>>>")
    examples.decode_sequences(examples.encode_sequences(df), "record", {"c": "INT"}, {"t": "BYTES"})
    encode, decode = runs
    sizes = []
    for name, size in (("sequence_bytes", lambda x: (len(x[0]), sum(c.nbytes for c in x))), ("sequence_columns", lambda x: (len(x), sum(map(len, x))))):
        monkeypatch.setattr(examples, name, lambda x, *a, size=size, real=getattr(examples, name): sizes.append(size(x)) or real(x, *a))
    steps = [[[b"x" * (3 << 20 if i == 1234 else 2000)], [], [bytes([i % 256])]] for i in range(3000)]
    held = pa.StructArray.from_arrays([pa.array(steps, pa.list_(pa.list_(pa.binary())))], ["t"])
    batch = pa.RecordBatch.from_arrays([pa.array([[i] for i in range(3000)]), held], ["c", examples.SEQUENCE])
    records = list(encode([batch.slice(0, 0), batch]))
    got = pa.Table.from_batches(decode([pa.Table.from_batches(records).combine_chunks().to_batches()[0]]))
    assert got.column("c").to_pylist() == [[i] for i in range(3000)] and [r["t"] for r in got.column(examples.SEQUENCE).to_pylist()] == steps
    assert sum(n for n, _ in sizes) == 6000 and all(n == 1 or b <= examples.PIECE_BYTES for n, b in sizes)


def test_record_files(spark, tmp_path):
    df = spark.createDataFrame([(bytes([i]) * i,) for i in range(50)], "record binary").repartition(3)
    for compress in (False, True):
        path = str(tmp_path / str(compress))
        assert records.write_records(df, path, compress=compress) == 50
        got = records.read_records(spark, f"{path}/part-*", verify=True)
        assert sorted(bytes(r.record) for r in got.collect()) == sorted(bytes(r.record) for r in df.collect())
    assert records.detect_compression([]) == "" == records.detect_compression(["a"]) and records.detect_compression(["a.gz"]) == "GZIP" and records.detect_compression(["a.gz", "b"]) == records.MIXED
    placed = records.read_records(spark, f"{path}/part-*", with_file=True)
    assert placed.groupBy("file").agg((F.max("pos") + 1 == F.count("pos")).alias("x")).where("x").count() == placed.select("file").distinct().count()
    with pytest.raises(ValueError):
        records.read_records(spark, [])
    src = records.raw_records(f"{path}/part-*", "raw")
    assert src.load(spark).columns == ["raw"] and src.decode(src.raw(spark)).count() == 50


class Doubler(examples.RecordDecoder):
    record_index = "index"

    def output_schema(self):
        return T.StructType([T.StructField("v", T.StringType()), T.StructField("index", T.LongType())])

    def decode(self, raw):
        return {"v": [r.decode() * k for r in raw for k in (1, 2)], "index": [i for i in range(len(raw)) for _ in (1, 2)]}


def test_own_decoder(spark, tmp_path):
    df = spark.createDataFrame([(b"a",), (b"b",)], "record binary")
    Doubler.__module__ = "__main__"  # saved by value: workers need not import this module
    examples.save_decoder(Doubler(), str(tmp_path / "d"))
    got = examples.decode_with(df, "record", examples.load_decoder(str(tmp_path / "d")), raw_record="raw").collect()
    assert sorted((r.v, bytes(r.raw[0])) for r in got) == [("a", b"a"), ("aa", b"a"), ("b", b"b"), ("bb", b"b")]


def test_raw_columns(spark):
    df = spark.createDataFrame([(1, b"x")], "a int, record binary")
    assert examples.append_raw_record(df, "raw", "record").first() == Row(a=1, raw=[b"x"])
    with pytest.raises(ValueError):
        examples.append_raw_record(df, "a", "record")
    rows = spark.createDataFrame([("p", [1]), ("q", [0])], "v string, at array<int>")
    raw = spark.createDataFrame([(0, b"zero"), (1, b"one")], "pos long, record binary")
    got = examples.append_indexed_records(rows, "raw", "at", raw, "pos", "record").collect()
    assert sorted((r.v, bytes(r.raw[0])) for r in got) == [("p", b"one"), ("q", b"zero")]
    with pytest.raises(Exception, match="one number"):
        examples.append_indexed_records(spark.createDataFrame([("p", None)], rows.schema), "raw", "at", raw, "pos", "record").collect()


def test_tables(spark, tmp_path):
    spark.range(5).selectExpr("id as a", "id * 2 as b").write.parquet(str(tmp_path / "t"))
    df = tables.read_parquet(spark, [str(tmp_path / "t")], ["b"])
    assert df.columns == ["b"] and "ReadSchema: struct<b:bigint>" in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        tables.read_parquet(spark, str(tmp_path / "t"), ["no"])
    flat = tables.flatten_dataset(spark.createDataFrame([(1, (True, (0.5, "x")))], "a int, b struct<c:boolean,d:struct<e:double,f:string>>"))
    assert flat.dtypes == [("a", "bigint"), ("b_c", "bigint"), ("b_d_e", "float"), ("b_d_f", "string")] and flat.first()[:] == (1, 1, 0.5, "x")
    made = tables.from_rows(spark, [(1, "a"), (2, "b")], shards=3)
    assert made.columns == ["feature0", "feature1"] and made.rdd.getNumPartitions() == 3
    with pytest.raises(TypeError):
        tables.flatten_dataset(spark.sql("select date'2020-01-01' as d"))


def test_crc_of_any_length():
    """Against the register moved byte by byte."""
    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (wire.POLYNOMIAL if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rng = np.random.default_rng(3)
    some = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 3, 4, 5, 255, 256, 257, 511, 512, 1000, 3000)]
    assert wire.crc32c(some).tolist() == [plain(r) for r in some] and len(wire.crc32c([])) == 0


def test_records_stream(spark, tmp_path):
    """Buffers smaller than records, files cut off anywhere, and checksums that are verified unless told otherwise."""
    import io

    some = [b"", b"abc", b"x" * 5000, b"y" * 100] * 3
    data = wire.frame(some)
    for size in (1, 13, 700, 1 << 20):
        assert [r for part in wire.stream_records(io.BytesIO(data), size=size) for r in part] == some
    for end in (1, 11, 17, len(data) - 1):
        with pytest.raises(ValueError):
            list(wire.stream_records(io.BytesIO(data[:end]), size=50))
    damaged = data.replace(b"abc", b"abd")
    (tmp_path / "a b%20c.rec").write_bytes(data)
    assert records.read_records(spark, str(tmp_path)).count() == len(some)
    (tmp_path / "bad.rec").write_bytes(damaged)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(spark, str(tmp_path)).collect()
    assert records.read_records(spark, str(tmp_path), verify=False).count() == 2 * len(some)
    huge = data[:12] + damaged[12:]
    assert [len(p) for p in wire.stream_records(io.BytesIO(huge), verify=False)] == [len(some)]


def test_columns_of_a_batch_and_record_by_record():
    """The batch parser against the one for single records, over random and odd records."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    kinds = {"i": "INT", "f": "FLOAT", "b": "BYTES", "é long name": "INT", "": "BYTES", "none": "FLOAT"}
    draw = {
        "INT": lambda n: [int(x) for x in rng.choice([0, 1, 127, 128, 300, -1, MIN, MAX, 2**40], n)],
        "FLOAT": lambda n: [float(np.float32(x)) for x in rng.normal(size=n)],
        "BYTES": lambda n: [rng.bytes(int(k)) for k in rng.integers(0, 300, n)],
    }
    some = []
    for _ in range(300):
        features = {}
        for name in rng.permutation([*kinds, "other"]):
            kind = kinds.get(name, "INT")
            if name != "none" and rng.random() < 0.8:
                features[name] = (kind, draw[kind](int(rng.integers(0, 5)))) if rng.random() < 0.9 else (None, None)
        some.append(wire.build_example(features))
    unpacked = bytes([0x0A, 13, 0x0A, 11, 0x0A, 1, 0x69, 0x12, 6, 0x1A, 4, 0x08, 5, 0x08, 6])
    some += [b"", wire.build_example({}), wire.build_example({"f": ("FLOAT", [])})]

    def plain(raws):
        parsed = [wire.parse_example(r, kinds) for r in raws]
        return [[p[n][1] if n in p else None for p in parsed] for n in kinds]

    got = [c.to_pylist() for c in wire.columns(pa.array(some, pa.binary()), kinds)]
    assert got == plain(some)
    assert [c.to_pylist() for c in wire.columns(pa.array([unpacked] * 3), {"i": "INT"})] == [[[5, 6]] * 3] and wire.parse_example(unpacked)["i"] == ("INT", [5, 6])
    with pytest.raises(wire.Irregular):
        wire.columns(pa.array([unpacked, wire.build_example({"i": ("INT", [1])})]), {"i": "INT"})
    assert wire.columns(pa.array(some[:5], pa.binary()).slice(2, 2), kinds)[0].to_pylist() == plain(some[2:4])[0]
    assert [len(c) for c in wire.columns(pa.array([], pa.binary()), kinds)] == [0] * len(kinds)
    with pytest.raises(ValueError, match="FLOAT values where INT"):
        wire.columns(pa.array([wire.build_example({"i": ("FLOAT", [1.0])})]), {"i": "INT"})
    for cut in range(1, len(some[0]) - 1, 7):
        try:
            wire.parse_example(some[0][:cut], kinds)
        except wire.ParseError:
            with pytest.raises(wire.ParseError):
                wire.columns(pa.array([some[1], some[0][:cut]]), kinds)


def test_csv_headers_of_many_splits(spark, tmp_path):
    """Header lines are those of each file's beginning, wherever its splits lie."""
    want = []
    for f in range(3):
        lines = [f"{f},{i}" for i in range(4000 if f else 2)]
        want += [(f, i) for i in range(4000 if f else 2)]
        (tmp_path / f"{f}.csv").write_text("a,b\nunits,units\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = csv.read(spark, str(tmp_path), form(2), skip_header_lines=2)
        assert got.rdd.getNumPartitions() > 8
        assert sorted((int(r.f1[0]), int(r.f2[0])) for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
