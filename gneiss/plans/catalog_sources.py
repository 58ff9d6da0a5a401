"""More driver queries: files, decoders, schemas, representations, paths, profiles and batches, each with its SQL.

SQL about schemas reads them from the tables themselves (`describe`), so both sides follow the data.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions import arrays as A
from gneiss.operators import batching, inference, paths, profile as prof, relational, stats, tensors
from gneiss.plans import features as feat
from gneiss.plans import schema_binary
from gneiss.plans.catalog import _LINES, _customers, _lines, _shared, query, table
from gneiss.plans.features import Feature, FeatureSchema, Representation, SparseFeature
from gneiss.plans.schema_text import parse_schema
from gneiss.sources import csv, datasource, examples, records, tabular

_TYPES = "case when column_type in ('BIGINT', 'INTEGER') then 'INT' when column_type in ('DOUBLE', 'FLOAT') then 'FLOAT' else 'BYTES' end"


def _schema_of(df, **options) -> FeatureSchema:
    kinds = {"bigint": "INT", "int": "INT", "double": "FLOAT", "float": "FLOAT"}
    return FeatureSchema(tuple(Feature(f.name, kinds.get(f.dataType.simpleString(), "BYTES"), **options) for f in df.schema.fields))


# ---- files and codecs -------------------------------------------------------------------------------------------


def _dialogues(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    step = lambda f: F.transform("x", lambda s: F.array(F.encode(s[f], "UTF-8"))).alias(f)
    return c.select(F.array("conv_id").alias("conv"), F.struct(step("role"), step("text")).alias(examples.SEQUENCE))


_DIALOGUES = "select [conv_id] as conv, list([encode(role)] order by turn, role, text) as roles, list([encode(text)] order by turn, role, text) as texts from conversations group by conv_id"


@query(_DIALOGUES)
def sequence_record_files(spark, d):
    path = _shared(spark)
    records.write_records(examples.encode_sequences(_dialogues(spark, d)), path)
    steps = Feature(examples.SEQUENCE, "STRUCT", children=(Feature("role"), Feature("text")))
    out = tabular.Sequences(f"{path}/part-*", FeatureSchema((Feature("conv", "INT"), steps))).load(spark)
    return out.select("conv", F.col(f"`{examples.SEQUENCE}`.role").alias("roles"), F.col(f"`{examples.SEQUENCE}`.text").alias("texts"))


_CSV_ROWS = "select [p_partkey] as key, case when p_partkey % 3 <> 0 then [encode(p_name)] end as name, case when p_partkey % 4 <> 0 then [cast(p_size as bigint)] end as size from part"


@query(_CSV_ROWS)
def csv_files(spark, d):
    """Files with a header line each, read back with it left out."""
    p = table(spark, d, "part")
    cell = lambda n, c: F.when(F.col("p_partkey") % n != 0, c).otherwise("")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), cell(3, F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))), cell(4, F.col("p_size").cast("string")))
    lines = p.select(F.lit(1).alias("o"), line.alias("value"), F.spark_partition_id().alias("part"))
    headers = lines.select("part").distinct().select(F.lit(0).alias("o"), F.lit("key,name,size").alias("value"), "part")
    path = _shared(spark)
    headers.unionAll(lines.select("o", "value", "part")).select("o", "value", "part").repartition("part").sortWithinPartitions("part", "o").select("value", "part").write.partitionBy("part").text(path)
    schema = FeatureSchema((Feature("key", "INT"), Feature("name"), Feature("size", "INT")))
    return csv.read(spark, path, csv.CsvFormat(("key", "name", "size")), schema, skip_header_lines=1)


class _Splitter(examples.RecordDecoder):
    """Words of a record, with the record that each came from."""

    record_index = "source"

    def output_schema(self):
        return T.StructType([T.StructField("word", T.ArrayType(T.BinaryType())), T.StructField("source", T.ArrayType(T.LongType()))])

    def decode(self, raws):
        words = [(w, i) for i, r in enumerate(raws) for w in r.split()]
        return {"word": [[w] for w, _ in words], "source": [[i] for _, i in words]}


@query("select [encode(unnest(string_split(n_name, ' ')))] as word, [encode(n_name)] as raw from nation")
def saved_decoder_files(spark, d):
    path = _shared(spark)
    records.write_records(table(spark, d, "nation").select(F.encode("n_name", "UTF-8").alias("record")), path)
    examples.save_decoder(_Splitter(), f"{path}.decoder")
    return records.decoded_records(f"{path}/part-*", f"{path}.decoder", "raw").load(spark).select("word", "raw")


@query("select r_regionkey::bigint as pos, [encode(n_name)] as raw from nation join region on n_regionkey = r_regionkey")
def attach_indexed_records(spark, d):
    raws = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.encode("n_name", "UTF-8").alias("record"))
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("pos"), F.array(F.col("n_nationkey").cast("long")).alias("source"))
    return examples.append_indexed_records(rows, "raw", "source", raws, "pos", "record").select("pos", "raw")


@query("select [encode(n_name)] as record, [n_nationkey::bigint] as key from nation")
def record_source_halves(spark, d):
    """Raw records read once, and decoded apart."""
    n = table(spark, d, "nation").select(F.array(F.col("n_nationkey").cast("long")).alias("key"), F.array(F.encode("n_name", "UTF-8")).alias("name"))
    path = _shared(spark)
    records.write_records(examples.encode_examples(n), path)
    source = records.example_records(f"{path}/part-*", FeatureSchema((Feature("key", "INT"), Feature("name"))))
    return source.decode(source.raw(spark)).select(F.col("name").alias("record"), "key")


@query("select n_regionkey as region, case when bool_and(n_nationkey % 2 = 0) then 'GZIP' when bool_or(n_nationkey % 2 = 0) then 'INVALID_MIXED_COMPRESSION_TYPES' else '' end as kind from nation where n_nationkey % 2 = 0 or n_regionkey > 1 group by 1")
def compression_of_files(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0 or n_regionkey > 1")
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".rec.gz").otherwise(".rec"))
    files = n.groupBy("n_regionkey").agg(F.collect_list(name).alias("files")).collect()  # the files of a pattern are listed on the driver
    return spark.createDataFrame([(r.n_regionkey, records.detect_compression(r.files)) for r in files], "region int, kind string")


@query("select n_name as name, n_nationkey::bigint as key, octet_length(encode(n_name))::bigint as size from nation")
def example_to_arrays(spark, d):
    """Records as dicts of one-dimensional arrays."""
    n = table(spark, d, "nation").select(F.array(F.col("n_nationkey").cast("long")).alias("key"), F.array(F.encode("n_name", "UTF-8")).alias("name"), F.array().cast("array<float>").alias("none"))
    got = [examples.example_to_numpy(bytes(r.record)) for r in examples.encode_examples(n).collect()]  # 25 nations
    return spark.createDataFrame([(g["name"][0].decode(), int(g["key"][0]), len(g["name"][0]) + len(g["none"])) for g in got], "name string, key long, size long")


_SCHEMA_TEXT = """
# the features of a line
feature { name: "l_orderkey" type: INT shape { dim { size: 1 } } presence { min_fraction: 1 } }
feature { name: "l_quantity" type: FLOAT value_count { min: 1 max: 1 } }
feature { name: "l_returnflag" type: BYTES }
feature { name: "l_tax" type: FLOAT lifecycle_stage: DEPRECATED }
tensor_representation_group {
  key: ""
  value {
    tensor_representation {
      key: "quantity"
      value { dense_tensor { column_name: "l_quantity" shape { dim { size: 1 } } default_value { float_value: -1 } } }
    }
  }
}
"""


def _line_records(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.array("l_orderkey").alias("l_orderkey"), F.when(F.col("l_linenumber") != 2, F.array(F.col("l_quantity").cast("float"))).alias("l_quantity"), F.array(F.encode("l_returnflag", "UTF-8")).alias("l_returnflag"), F.array(F.col("l_tax").cast("float")).alias("l_tax"))
    return examples.encode_examples(rows)


@query("select [l_orderkey] as l_orderkey, [case when l_linenumber <> 2 then l_quantity else -1 end] as quantity from lineitem")
def project_by_schema_text(spark, d):
    """A schema in text form, and a projection of a record source to two of its tensors; only two features are decoded."""
    source = tabular.Examples(lambda s: _line_records(s, d), parse_schema(_SCHEMA_TEXT))
    out = source.project(["quantity", "l_orderkey"]).tensors(spark)
    return out.select("l_orderkey", F.transform("quantity", lambda x: x.cast("double")).alias("quantity"))


@query("select [l_orderkey] as l_orderkey, [case when l_linenumber <> 2 then l_quantity else -1 end] as quantity from lineitem")
def project_by_schema_binary(spark, d):
    """The same schema as serialised bytes."""
    schema = schema_binary.parse_schema(schema_binary.format_schema(parse_schema(_SCHEMA_TEXT)))
    out = tabular.Examples(lambda s: _line_records(s, d), schema).project(["quantity", "l_orderkey"]).tensors(spark)
    return out.select("l_orderkey", F.transform("quantity", lambda x: x.cast("double")).alias("quantity"))


@query("select [l_orderkey] as l_orderkey, l_quantity from lineitem where l_linenumber <> 2 union all select [l_orderkey], -1 from lineitem where l_linenumber = 2")
def project_legacy_tensors(spark, d):
    """A schema that asks for the older rules: value counts make the shapes, and missing values get defaults."""
    text = 'generate_legacy_feature_spec: true feature { name: "l_orderkey" type: INT value_count { min: 1 max: 1 } presence { min_fraction: 1 } } feature { name: "l_quantity" type: FLOAT value_count { min: 1 max: 1 } }'
    out = tabular.Examples(lambda s: _line_records(s, d), parse_schema(text)).tensors(spark)
    return out.select("l_orderkey", F.get("l_quantity", 0).cast("double").alias("l_quantity"))


@query("select [s_suppkey] as s_suppkey from supplier")
def project_source(spark, d):
    """A projection of a projection is taken from the original."""
    s = table(spark, d, "supplier").select(F.array("s_suppkey").alias("s_suppkey"), F.array(F.encode("s_name", "UTF-8")).alias("s_name"), F.array(F.col("s_acctbal").cast("float")).alias("s_acctbal"))
    schema = FeatureSchema((Feature("s_suppkey", "INT"), Feature("s_name"), Feature("s_acctbal", "FLOAT")))
    source = tabular.Examples(lambda _: examples.encode_examples(s), schema)
    return source.project(["s_name", "s_acctbal"]).project(["s_suppkey"]).load(spark)


@query("select rows, count(*) as batches from (select least(7, (select count(*) from supplier) - 7 * b) as rows from range((select ceil(count(*) / 7)::bigint from supplier)) t(b)) group by 1")
def local_batches(spark, d):
    """Batches of a source for a local consumer."""
    sizes = [len(b) for b in tabular.Parquet(f"{d}/supplier.parquet", columns=["s_suppkey"]).batches(spark, 7)]
    return spark.createDataFrame([(n, sizes.count(n)) for n in sorted(set(sizes))], "rows long, batches long")


@query("select n_nationkey::bigint as key, n_regionkey::bigint as label from nation")
def labelled_local_batches(spark, d):
    """(features, label) pairs."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    pairs = [p for batch in relational.labelled_batches(n, "n_regionkey", batch_size=4) for p in batch]
    return spark.createDataFrame([(f["n_nationkey"], label) for f, label in pairs], "key long, label long")


# ---- schemas and representations --------------------------------------------------------------------------------


@query(f"select column_name as name, 'array<' || case {_TYPES} when 'INT' then 'bigint' when 'FLOAT' then 'float' else 'binary' end || '>' as kind from (describe supplier) where column_name <> 's_nationkey' union all select 'raw', 'array<binary>'")
def csv_schema(spark, d):
    """The columns that decoding gives, columns outside the schema left out."""
    t = table(spark, d, "supplier")
    kinds = csv.spark_schema(tuple(t.columns), _schema_of(t.drop("s_nationkey")), "raw")
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in kinds.fields], "name string, kind string")


@query(f"with {_LINES} select case when min(coalesce(len(q), 0)) = max(coalesce(len(q), 0)) then 'dense' else 'varlen' end as q, 'dense' as l_orderkey from lines")
def legacy_representations(spark, d):
    """Shapes from the value counts that the data have."""
    r = _lines(spark, d).agg(F.min(F.coalesce(F.size("q"), F.lit(0))).alias("lo"), F.max(F.coalesce(F.size("q"), F.lit(0))).alias("hi")).first()
    made = feat.infer_legacy(FeatureSchema((Feature("q", "FLOAT", value_count=(r.lo, r.hi)), Feature("l_orderkey", "INT", value_count=(1, 1)))))
    return spark.createDataFrame([(made["q"].kind, made["l_orderkey"].kind)], "q string, l_orderkey string")


@query("select column_name as name, case when column_name like '%key' then 'dense' else 'varlen' end as kind from (describe lineitem)")
def mixed_representations(spark, d):
    """Explicit representations of some columns, set and read back, and inferred ones of the rest."""
    schema = _schema_of(table(spark, d, "lineitem"))
    explicit = {f.name: Representation("dense", (f.name,), shape=(1,)) for f in schema.features if f.name.endswith("key")}
    made = feat.infer_mixed(feat.set_representations(schema, explicit))
    return spark.createDataFrame([(n, r.kind) for n, r in made.items()], "name string, kind string")


@query("select a.column_name || '/' || b.column_name as name, unnest([a.column_name, b.column_name]) as source, b.column_name as value from (describe orders) a, (describe orders) b where a.column_name like '%key' and b.column_name not like '%key'")
def source_columns(spark, d):
    """T5: the columns that sparse tensors read."""
    names = table(spark, d, "orders").columns
    rows = []
    for a in (n for n in names if n.endswith("key")):
        for b in (n for n in names if not n.endswith("key")):
            r = Representation("sparse", (b,), indices=(a,), sizes=(-1,))
            rows += [(f"{a}/{b}", ".".join(c), ".".join(feat.source_value_column(r))) for c in feat.source_columns(r)]
    return spark.createDataFrame(rows, "name string, source string, value string")


@query("select column_name as dropped, false as valid from (describe part) union all select '', true")
def validated_representations(spark, d):
    """Representations are valid only if every column is used."""
    schema = _schema_of(table(spark, d, "part"))
    whole = {f.name: Representation("varlen", (f.name,)) for f in schema.features}

    def valid(gone):
        try:
            feat.validate_representations(feat.set_representations(schema, {n: r for n, r in whole.items() if n != gone}))
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(n, valid(n)) for n in ["", *whole]], "dropped string, valid boolean")


@query(f"select column_name as feature, case when column_name like '%key' then 'fixed' else 'varlen' end as kind, {_TYPES} as type from (describe lineitem) where column_name not in ('l_linenumber', 'l_quantity') union all select '_parse_pair', 'sparse', 'FLOAT'")
def parse_specifications(spark, d):
    """How a parser reads each feature; a tensor of two features goes under a name of its own."""
    base = _schema_of(table(spark, d, "lineitem"))
    made = tuple(Feature(f.name, f.type, shape=(1,), min_fraction=1) if f.name.endswith("key") else f for f in base.features)
    schema = FeatureSchema(made, (SparseFeature("pair", ("l_linenumber",), "l_quantity", (-1,)),))
    return spark.createDataFrame([(n, s.kind, s.type) for n, s in feat.parse_config(schema).items()], "feature string, kind string, type string")


@query("select column_name as tensor, case when column_name like '%key' then '[-1, 1]' else '[-1, -1]' end as spec, column_name like '%key' as kept from (describe partsupp_like)".replace("partsupp_like", "supplier"))
def tensor_specs(spark, d):
    """Static shapes of tensors, and of the original of a projection."""
    schema = _schema_of(table(spark, d, "supplier"))
    every = {f.name: Representation("dense", (f.name,), shape=(1,)) if f.name.endswith("key") else Representation("varlen", (f.name,)) for f in schema.features}
    kept = {n: r for n, r in every.items() if n.endswith("key")}
    adapter = tensors.TensorAdapter(schema.spark_type(), kept, every)
    return spark.createDataFrame([(n, str(list(s)), n in adapter.type_specs()) for n, (_, s) in adapter.original_type_specs().items()], "tensor string, spec string, kept boolean")


@query("select l_orderkey as row, list(l_quantity order by l_linenumber, l_suppkey, l_quantity) as q_values, list(l_linenumber::bigint order by l_linenumber, l_suppkey, l_quantity) as q_line, list(l_suppkey order by l_linenumber, l_suppkey, l_quantity) as q_supplier from lineitem where l_quantity > 25 group by 1")
def tensor_to_columns_nd(spark, d):
    """A sparse tensor of three dimensions as columns of values and indices."""
    li = table(spark, d, "lineitem").where("l_quantity > 25")
    at = li.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("i0"), F.col("l_suppkey").alias("i1"), F.col("l_quantity").alias("value"))
    out = tensors.from_sparse_nd(at, at.select("row").distinct(), "q", 2)
    return out.select("row", F.col("`q$values`").alias("q_values"), F.col("`q$index0`").alias("q_line"), F.col("`q$index1`").alias("q_supplier"))


# ---- paths, types, batches --------------------------------------------------------------------------------------


@query("select c_custkey, c_name as name, c_nationkey as nation from customer")
def struct_fields(spark, d):
    """P3."""
    c = _customers(spark, d)
    return c.select("c_custkey", paths.get_field(c, "who", "name").alias("name"), paths.get_field(c, "who", "nation").alias("nation"))


@query("select path, parent, depth from (values ('c_custkey', '', 1::bigint), ('who.name', 'who', 2), ('who.nation', 'who', 2), ('orders.o_orderkey', 'orders', 2), ('orders.o_orderstatus', 'orders', 2)) t(path, parent, depth) where (select count(*) from customer) > 0")
def column_paths(spark, d):
    """The leaf paths of a nested schema."""
    leaves = [p for p, _ in paths.enumerate_paths(_customers(spark, d).schema, leaves_only=True)]
    return spark.createDataFrame([(str(p), str(p.parent()), len(paths.ColumnPath.from_dict(p.to_dict()))) for p in leaves], "path string, parent string, depth long")


@query("select column_name as name, case when column_type in ('BIGINT', 'INTEGER') then 'bigint' when column_type in ('DOUBLE', 'FLOAT') then 'double' else 'binary' end as kind from (describe supplier)")
def canonical_kinds(spark, d):
    """Canonical types by the kind letters of numpy types."""
    import numpy as np

    letters = {"bigint": np.int64, "int": np.int32, "double": np.float64, "float": np.float32, "string": object}
    fields = table(spark, d, "supplier").schema.fields
    return spark.createDataFrame([(f.name, relational.kind_to_type(np.dtype(letters.get(f.dataType.simpleString(), object)).kind)) for f in fields], "name string, kind string")


@query("select column_name as name, starts_with(reverse(column_type), '][') as is_list, lower(replace(replace(column_type, '[]', ''), 'VARCHAR', 'STRING')) as leaf from (describe embeddings)".replace("lower(replace(replace(column_type, '[]', ''), 'VARCHAR', 'STRING'))", "case replace(column_type, '[]', '') when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(replace(column_type, '[]', '')) end"))
def list_types(spark, d):
    """A10."""
    t = table(spark, d, "embeddings")
    return spark.createDataFrame([(f.name, A.is_list_like(f.dataType), A.innermost_type(f.dataType).simpleString()) for f in t.schema.fields], "name string, is_list boolean, leaf string")


@query("select o_orderkey * 1000003 - 5000000000 as k, (row_number() over (order by o_orderkey) - 1) // 100 as batch_id from orders")
def batch_ids_sparse(spark, d):
    """U3 over numbers that are far apart."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") * 1000003 - 5000000000).alias("k"))
    return relational.batch_ids(o, "k", 100)


# ---- statistics, profiles ---------------------------------------------------------------------------------------


_STATS = "select l_returnflag as slice, count(*) as num_examples, 'l_quantity' as feature_id, cast(sum(l_quantity) as bigint) as total from lineitem group by 1"


def _shards(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    parts = li.groupBy(F.col("l_returnflag").alias("slice"), "year").agg(F.sum("l_quantity").cast("long").alias("total"))
    whole = li.groupBy(F.col("l_returnflag").alias("slice")).agg(F.count(F.lit(1)).alias("num_examples"))
    return parts.join(whole, "slice").select("slice", "num_examples", F.lit("l_quantity").alias("feature_id"), F.lit(False).alias("is_path"), "total", "year")


@query(_STATS)
def stats_merge_lists(spark, d):
    """M2: rows that each hold a list of shards."""
    held = _shards(spark, d).groupBy("year").agg(F.collect_list(F.struct("slice", "num_examples", "feature_id", "is_path", "total")).alias("shards"))
    return stats.merge_lists(held, "shards", sums=["total"]).select("slice", "num_examples", "feature_id", "total")


@query(_STATS)
def stats_accumulated(spark, d):
    """M5: shards that arrive one table at a time."""
    held, every = stats.Accumulator(), _shards(spark, d)
    for rest in range(3):
        held.merge(every.where(F.col("year") % 3 == rest).drop("year"))
    return held.get(spark, sums=["total"]).where("slice is not null").select("slice", "num_examples", "feature_id", "total")


@query(
    """
with b as (select cast(5 * ceil(count(*) / 8.0) + count(*) * 24 + (count(*) + 1) * 8 + sum(octet_length(encode(l_returnflag))) as bigint) as b, count(*) as n from
  (select l_orderkey, l_quantity, l_tax, l_returnflag from lineitem)),
m as (select 'num_columns' as name, 4::bigint as min, 4::bigint as max, count(*) as count, 4 * count(*) as sum from lineitem
  union all select 'num_feature_values', 1, 1, 4 * count(*), 4 * count(*) from lineitem union all select 'num_feature_values[INT]', 1, 1, count(*), count(*) from lineitem
  union all select 'num_feature_values[FLOAT]', 1, 1, 2 * count(*), 2 * count(*) from lineitem union all select 'num_feature_values[STRING]', 1, 1, count(*), count(*) from lineitem
  union all select 'num_rows', n, n, 1, n from b union all select 'record_batch_byte_size', b - ceil(n / 8.0)::bigint, b - ceil(n / 8.0)::bigint, 1, b - ceil(n / 8.0)::bigint from b)
select 'LogicalFormat[table]-PhysicalFormat[parquet]-' || name as metric, min, max, count, sum::bigint as sum from m
"""
)
def profile_table(spark, d):
    """L1, L3."""
    return prof.profile(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_returnflag"))


@query("select 'reader.maxRecordsPerBatch' as metric, 500::bigint as value union all select 'reader.rows', count(*) from supplier union all select 'reader.batches', ceil(count(*) / 500)::bigint from supplier")
def batching_report(spark, d):
    """L7."""
    return prof.batching(table(spark, d, "supplier").coalesce(1), relational.batch_settings(500), "reader")


# ---- inference --------------------------------------------------------------------------------------------------


@query("select vec_id, case when embedding[1] > 0 then 'pos' else 'neg' end as label, cast(embedding[1] as float) as value from embeddings")
def infer_multi(spark, d):
    """A model that classifies and regresses."""
    both = (inference.Signature("classify", ("x",), {"classes": "string", "scores": "float"}), inference.Signature("regress", ("x",), {"output": "double"}))
    spec = inference.ModelSpec("multi", both, inference.linear([1.0] + [0.0] * 63))
    out = inference.run_inference(table(spark, d, "embeddings"), ["embedding"], spec)
    classes = F.col("prediction.classify")
    best = F.reduce(classes, F.get(classes, 0), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))
    return out.select("vec_id", best["label"].alias("label"), F.col("prediction.regress").alias("value"))


@query("select l_orderkey, l_linenumber, l_quantity * 3 + octet_length(encode(l_returnflag)) as y from lineitem")
def infer_remote(spark, d):
    """Instances go to a remote model's client as JSON values, and calls that the service turns away are repeated."""
    calls = []

    def client(project, model, instances):
        calls.append(len(instances))
        if len(calls) == 1:
            raise inference.RemoteError(503)
        import base64

        return [{"y": 3.0 * row["quantity"] + len(base64.b64decode(row["flag_bytes"]["b64"]))} for row in instances]

    load = inference.remote_model("project", "model", client)
    spec = inference.ModelSpec("remote", (inference.Signature("predict", ("quantity", "flag_bytes"), {"y": "double"}),), load)
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.encode("l_returnflag", "UTF-8").alias("flag"))
    return inference.run_inference(t, ["l_quantity", "flag"], spec).select("l_orderkey", "l_linenumber", "prediction.y")


@query("select l_orderkey, l_linenumber, l_quantity * 2 + 1 as y, true as within from lineitem")
def infer_batch_limits(spark, d):
    """The model sees batches of 700 to 2,000 rows, whatever Arrow batches they come in."""

    def load(path):
        def run(batch, signature):
            x = batch["x"]
            return {"y": 2 * x + 1, "n": [len(x)] * len(x)}

        return run

    spec = inference.ModelSpec("sized", (inference.Signature("predict", ("x",), {"y": "double", "n": "bigint"}),), load, max_batch=2000, min_batch=700)
    got = inference.run_inference(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], spec)
    return got.select("l_orderkey", "l_linenumber", "prediction.y", F.col("prediction.n").between(700, 2000).alias("within"))


@query("select count(*) > 0 as loaded from supplier")
def model_load_times(spark, d):
    """Every worker that runs a model tells how long it took to load it."""
    spec = inference.ModelSpec("timed", (inference.Signature("regress", ("x",), {"output": "double"}),), inference.linear([1.0]))
    got = inference.load_seconds(table(spark, d, "supplier").select("s_suppkey"), spec)
    return got.select(((F.col("loads") >= 1) & (F.col("min") >= 0) & (F.col("sum") >= F.col("max"))).alias("loaded"))


@query("select l_orderkey as order_key, cast(l_linenumber as bigint) as line, [encode(l_returnflag), encode(l_linestatus)] as marks from lineitem where l_returnflag in ('A', 'R') and l_linenumber < 4")
def record_source_format(spark, d):
    """Example records written by the committing sink, and read by format with conditions given to the scan."""
    marks = F.array(F.encode("l_returnflag", "UTF-8"), F.encode("l_linestatus", "UTF-8"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("mode"), marks.alias("marks"))
    path = _shared(spark)
    datasource.register(spark)
    rows.write.format("record_examples").mode("append").save(path)
    where = [("mode", "in", ["A", "R"]), ("line", "<", 4)]
    return datasource.read(spark, "examples", path, "order_key long, line long, mode string, marks array<binary>", where).drop("mode")


# ---- batches, epochs, nested tensors and payloads ---------------------------------------------------------------


@query(
    """
with recursive p as (select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as w, sum(coalesce(octet_length(encode(text)), 0)) over (order by doc_id)::bigint as upto from documents),
b(n, s) as (select 0::bigint, 0::bigint union all
            select n + 1, e from (select n, (select min(upto) from p where upto >= s + 50000) as e from b) where e is not null)
select p.doc_id, (select max(n) from b where b.s <= p.upto - p.w and (b.s < p.upto or b.n = (select min(n) from b c where c.s = b.s))) as batch_id from p
"""
)
def batch_ids_by_bytes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return batching.batch_ids_by_bytes(docs, "doc_id", F.octet_length("text"), 50_000, weigh=False).drop("text")


@query(
    """
with n as (select count(*) as n from orders), e as (select unnest(range(3)) as epoch)
select epoch::int as epoch, n as n_rows, n as n_keys, 0::bigint as first_position, n - 1 as last_position, ((epoch + 1) * n - 1) // 100 as last_batch, 0::bigint as moved, true as reordered from n, e
"""
)
def epoch_batches(spark, d):
    """Each epoch is a permutation of all rows, in an order of its own that partitions don't change."""
    o = table(spark, d, "orders").select("o_orderkey")
    made = [relational.epoch_batches(o.repartition(p), 100, 3, 17, ["o_orderkey"]) for p in (4, 16)]
    both = made[0].join(made[1].withColumnRenamed("position", "other").drop("batch_id"), ["o_orderkey", "epoch"], "full")
    before = Window.partitionBy("o_orderkey").orderBy("epoch")
    both = both.withColumn("changed", F.col("position") != F.lag("position", 1, -1).over(before))
    return both.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"), F.min("position").alias("first_position"), F.max("position").alias("last_position"),
        F.max("batch_id").alias("last_batch"), F.count_if(~F.col("position").eqNullSafe(F.col("other"))).alias("moved"), (F.count_if("changed") > F.count(F.lit(1)) * 0.9).alias("reordered"),
    )


_NESTED = """
with c as (select c_nationkey as nation, c_custkey as cust, (select count(*) from orders where o_custkey = c_custkey) as n from customer),
o as (select c_nationkey as nation, c_custkey as cust, o_orderkey as ord, (select count(*) from lineitem where l_orderkey = o_orderkey) as n from customer join orders on o_custkey = c_custkey),
n as (select n_nationkey as nation, (select count(*) from customer where c_nationkey = n_nationkey) as n from nation)
select 0 as level, row_number() over (order by nation) as number, sum(n) over (order by nation)::bigint as split from n
union all select 1, row_number() over (order by nation, cust), sum(n) over (order by nation, cust)::bigint from c
union all select 2, row_number() over (order by nation, cust, ord), sum(n) over (order by nation, cust, ord)::bigint from o
"""


@query(_NESTED)
def ragged_row_splits_three_levels(spark, d):
    """Nations' customers, their orders, and the orders' lines, each line a pair: three ragged levels and a uniform one."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.array("l_quantity", "l_extendedprice")).alias("lines"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_custkey", "o_orderkey", "lines")
    nest = lambda df, by, key, what: df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.coalesce(what, F.array().cast(df.schema[what].dataType)).alias("x")))), lambda s: s["x"]).alias("x"))
    orders = nest(o, "o_custkey", "o_orderkey", "lines").withColumnRenamed("o_custkey", "c_custkey")
    customers = nest(table(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left"), "c_nationkey", "c_custkey", "x")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("c_nationkey")).join(customers.withColumn("c_nationkey", F.col("c_nationkey").cast("long")), "c_nationkey", "left")
    return tensors.nested_row_splits(nations, "x", "c_nationkey", uniform=1)


@query(
    """
with h as (select l_returnflag, year(l_shipdate) as y, l_linenumber as low, count(*) as n from lineitem group by all),
s as (select l_returnflag, y, sum(n)::bigint as n from h group by all)
select l_returnflag as feature_id, arg_max(s.n, s.y) as last_n,
       (select list(low::bigint order by y, low) from h where h.l_returnflag = s.l_returnflag) as low, (select list(n::bigint order by y, low) from h where h.l_returnflag = s.l_returnflag) as n,
       list(y::double order by y) as years, max(y) filter (where y % 2 = 0)::double as even
from s group by l_returnflag
"""
)
def merge_nested_payloads(spark, d):
    """Statistics of each year as nested messages, folded: histograms and custom statistics joined, other fields from the last year that has them."""
    rows = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    bars = rows.groupBy("l_returnflag", "y", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    hist = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("low"), "n")))
    shards = bars.groupBy(F.col("l_returnflag").alias("feature_id"), "y").agg(F.sum("n").alias("n"), hist.alias("hist"))
    shards = shards.select(
        "feature_id", "y", F.struct(F.struct("n", "hist").alias("common"), F.when(F.col("y") % 2 == 0, F.col("y").cast("double")).alias("even")).alias("payload"),
        F.array(F.struct(F.lit("year").alias("name"), F.col("y").cast("double").alias("num"))).alias("custom"),
    )
    merged = stats.merge_statistics(shards, payloads=["payload", "custom"], order="y")
    hist = F.col("payload.common.hist")
    return merged.select("feature_id", F.col("payload.common.n").alias("last_n"), hist["low"].alias("low"), hist["n"].alias("n"), F.col("custom")["num"].alias("years"), F.col("payload.even").alias("even"))
