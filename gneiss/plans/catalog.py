"""The driver queries of the reference's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import arrays as A
from gneiss.operators import distinct, heavy, inference, paths, profile as prof, quantiles, relational, slicing, stats, tensors
from gneiss.plans.features import Feature, FeatureSchema, Representation, infer_representations, project
from gneiss.sources import csv, examples, records, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, f"{d}/{name}.parquet")


# ---- sketches ---------------------------------------------------------------------------------------------------

_QUANTILES = """
with g as (select {k} as k, {v} as v, sum({w}) as w from {t} where {v} is not null and not isnan({v}) and {w} > 0 group by all),
c as (select k, v, sum(w) over (partition by k order by v) cw, sum(w) over (partition by k) tw from g),
r as (select unnest(generate_series(0, {n})) r)
select k as {name}, cast(r as bigint) as r, min(v) filter (where cw > r * tw / {n} or cw = tw) as quantile,
       min(cw) filter (where cw > r * tw / {n} or cw = tw) as cum_weight
from c, r group by k, r
"""


@query(_QUANTILES.format(k="l_returnflag", v="l_extendedprice", w="l_quantity", t="lineitem", n=10, name="l_returnflag"))
def weighted_quantiles(spark, d):
    return quantiles.quantiles(table(spark, d, "lineitem"), "l_extendedprice", 10, "l_quantity", ["l_returnflag"])


@query(
    " union all ".join(
        "(" + _QUANTILES.format(k=str(i), v=v, w="cast(1 as double)", t="lineitem", n=7, name="stream").strip() + ")"
        for i, v in enumerate(("l_quantity", "l_discount", "l_tax"))
    )
)
def quantiles_multi_stream(spark, d):
    return quantiles.streams(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 7)


@query(
    """
with t as (select event_type, case when event_id % 7 = 0 then null when event_id % 11 = 0 then 'NaN'::double else value end as v,
                  cast(event_id % 5 - 1 as double) as w from events),
g as (select event_type as k, v, sum(w) as w from t where v is not null and not isnan(v) and w > 0 group by all),
c as (select k, v, sum(w) over (partition by k order by v) cw, sum(w) over (partition by k) tw from g),
r as (select unnest(generate_series(0, 4)) r)
select k as event_type, cast(r as bigint) as r, min(v) filter (where cw > r * tw / 4 or cw = tw) as quantile,
       min(cw) filter (where cw > r * tw / 4 or cw = tw) as cum_weight
from c, r group by k, r
"""
)
def quantiles_skip_invalid(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return quantiles.quantiles(e.select("event_type", v.alias("v"), (F.col("event_id") % 5 - 1).cast("double").alias("w")), "v", 4, "w", ["event_type"])


@query(
    """
with g as (select l_quantity as v, count(*)::double as w from lineitem group by 1),
c as (select v, sum(w) over (order by v) cw, sum(w) over () tw from g),
r as (select unnest(generate_series(0, 20)) r),
q as (select r, min(v) filter (where cw > r * tw / 20 or cw = tw) as q from c, r group by r)
select list(q order by r) as quantiles from q
"""
)
def quantile_boundaries(spark, d):
    return quantiles.boundaries(table(spark, d, "lineitem"), "l_quantity", 20)


def _ranks(rows, value, estimates, n, eps, by):
    """(by.., r, within): whether each estimated boundary lies within eps of its rank among the group's values."""
    est = estimates.select(*by, F.posexplode("quantiles").alias("r", "q"))
    values = rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    met = values.join(est, by) if by else values.join(F.broadcast(est))  # n + 1 boundaries
    got = met.groupBy(*by, "r").agg(F.sum(F.when(F.col("v") < F.col("q"), F.col("c")).otherwise(0)).alias("lo"), F.sum(F.when(F.col("v") <= F.col("q"), F.col("c")).otherwise(0)).alias("hi"), F.sum("c").alias("n"))
    want = F.col("r") / n * F.col("n")
    return got.select(*by, F.col("r").cast("long").alias("r"), ((F.col("lo") <= want + eps * F.col("n")) & (F.col("hi") >= want - eps * F.col("n"))).alias("within"))


@query("select l_returnflag, unnest(range(11)) as r, count(*) > 0 as within from lineitem group by 1")
def quantiles_approximate(spark, d):
    li = table(spark, d, "lineitem")
    return _ranks(li, "l_extendedprice", quantiles.approximate(li, "l_extendedprice", 10, 0.001, ["l_returnflag"]), 10, 0.001, ["l_returnflag"])


@query("select unnest(range(11)) as r, count(*) > 0 as within from lineitem")
def quantiles_kll_merged(spark, d):
    rows = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    merged = quantiles.kll_merge(quantiles.kll(rows, "l_extendedprice", k=800, by=["year"]))
    got = merged.select(F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / 10) for i in range(11)])).alias("quantiles"))
    return _ranks(rows, "l_extendedprice", got, 10, 0.02, [])


def _weighted_ranks(rows, value, weight, sketches, n, eps, by):
    """(by.., r, within): whether each boundary of the sketches lies within eps of its rank in the group's weight."""
    got = quantiles.sketch_quantiles(sketches, n, by).select(*by, "r", F.col("quantile").alias("q"))
    met = rows.select(*by, F.col(value).alias("v"), F.col(weight).cast("double").alias("w")).join(F.broadcast(got), by).groupBy(*by, "r")  # n + 1 rows a group
    sums = met.agg(F.sum(F.when(F.col("v") < F.col("q"), F.col("w")).otherwise(0)).alias("lo"), F.sum(F.when(F.col("v") <= F.col("q"), F.col("w")).otherwise(0)).alias("hi"), F.sum("w").alias("w"))
    want = F.col("r") / n * F.col("w")
    return sums.select(*by, "r", ((F.col("lo") <= want + eps * F.col("w")) & (F.col("hi") >= want - eps * F.col("w"))).alias("within"))


@query("select l_returnflag, unnest(range(11)) as r, sum(l_quantity) > 0 as within from lineitem group by 1")
def quantiles_weighted_merged(spark, d):
    """Weighted sketches of each year, merged and cut back, against the exact weighted ranks."""
    by, eps = ["l_returnflag"], 0.02
    rows = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    merged = quantiles.sketch_merge(quantiles.sketch(rows, "l_extendedprice", eps, "l_quantity", [*by, "year"]).drop("year"), by)
    return _weighted_ranks(rows, "l_extendedprice", "l_quantity", quantiles.sketch_compact(merged, eps, by), 10, eps, by)


@query("select l_returnflag, unnest(range(21)) as r, count(*) > 0 as within from lineitem group by 1")
def quantiles_skewed_weights(spark, d):
    """One pass over weights that span many orders of magnitude and grow as values fall."""
    by, eps = ["l_returnflag"], 0.005
    rows = table(spark, d, "lineitem").withColumn("w", F.exp(F.lit(20.0) - F.col("l_extendedprice") / 2500))
    return _weighted_ranks(rows, "l_extendedprice", "w", quantiles.sketch(rows, "l_extendedprice", eps, "w", by), 20, eps, by)


@query(_QUANTILES.format(k="l_returnflag", v="l_quantity", w="cast(l_linenumber as double)", t="lineitem", n=10, name="l_returnflag"))
def quantiles_sketch_few_values(spark, d):
    """A sketch that holds all distinct values is exact."""
    made = quantiles.sketch(table(spark, d, "lineitem"), "l_quantity", 0.001, "l_linenumber", ["l_returnflag"])
    return quantiles.sketch_quantiles(made, 10, ["l_returnflag"])


@query(
    """
select 'l_returnflag' as col, count(distinct l_returnflag) as n_distinct from lineitem
union all select 'l_linestatus', count(distinct l_linestatus) from lineitem
union all select 'event_type', count(distinct event_type) from events
"""
)
def distinct_exact_small(spark, d):
    li, ev = table(spark, d, "lineitem"), table(spark, d, "events")
    parts = [distinct.distinct_exact(t, c).select(F.lit(c).alias("col"), "n_distinct") for t, c in ((li, "l_returnflag"), (li, "l_linestatus"), (ev, "event_type"))]
    return relational.flatten_sources(parts)


def _distinct_within(estimate, df, column, error):
    exact = df.agg(F.count_distinct(column).alias("n"))
    return estimate.join(F.broadcast(exact)).select((F.abs(F.col("n_distinct") - F.col("n")) <= F.lit(error) * F.col("n")).alias("within"))  # one row each


@query("select count(distinct o_custkey) > 0 as within from orders")
def distinct_theta(spark, d):
    o = table(spark, d, "orders")
    return _distinct_within(distinct.theta_sketch(o, "o_custkey").select(distinct.theta_estimate().alias("n_distinct")), o, "o_custkey", 4 / 4096**0.5)


@query("select p_size as p_size, count(distinct p_brand) as n_distinct from part group by 1")
def distinct_theta_below_k(spark, d):
    return distinct.theta_sketch(table(spark, d, "part"), "p_brand", 4096, ["p_size"]).select("p_size", distinct.theta_estimate().alias("n_distinct"))


@query("select count(distinct p_name) > 0 as within from part")
def kmv_estimate(spark, d):
    p = table(spark, d, "part")
    return _distinct_within(distinct.kmv(p, "p_name", 128).select(distinct.kmv_estimate(128).alias("n_distinct")), p, "p_name", 4 / 128**0.5)


@query("select count(distinct cast(l_quantity as bigint)) as n_distinct from lineitem")
def distinct_merge(spark, d):
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").alias("q"))
    return distinct.kmv_merge(distinct.kmv(rows, "q", 128, ["year"]), 128).select(distinct.kmv_estimate(128).alias("n_distinct"))


@query("select event_type as value, count(*)::double as count from events where event_type is not null group by 1 order by 2 desc, 1 limit 3")
def top_k_counts(spark, d):
    return heavy.top_k(table(spark, d, "events"), "event_type", 3)


@query("select l_returnflag || l_linestatus as value, sum(l_quantity) as count from lineitem group by 1 order by 2 desc, 1 limit 3")
def top_k_weighted(spark, d):
    return heavy.top_k(table(spark, d, "lineitem"), F.concat("l_returnflag", "l_linestatus"), 3, "l_quantity")


@query("select p_brand as value, count(*)::double as count from part group by 1 order by 2 desc, 1 desc limit 8")
def top_k_reverse_ties(spark, d):
    return heavy.top_k(table(spark, d, "part"), "p_brand", 8, reverse_ties=True)


@query(
    """
select lang, value, count from (
  select lang, case when octet_length(encode(text)) > 800 then '__LARGE__' else text end as value, count(*)::double as count,
         row_number() over (partition by lang order by count(*) desc, case when octet_length(encode(text)) > 800 then '__LARGE__' else text end) as rank
  from documents where text is not null group by 1, 2)
where rank <= 5
"""
)
def top_k_clean_text(spark, d):
    return heavy.top_k(table(spark, d, "documents"), heavy.clean_text("text", threshold=800), 5, by=["lang"])


@query("select l_linenumber as value, sum(l_quantity) as count, 0.0::double as delta from lineitem group by 1")
def misra_gries_below_k(spark, d):
    return heavy.misra_gries(table(spark, d, "lineitem"), "l_linenumber", 16, "l_quantity")


@query("select sum(l_quantity) > 0 as within from lineitem")
def misra_gries_weighted(spark, d):
    """Whether each estimate is an upper bound of its value's weight, too high by its delta at most, and deltas are bounded."""
    li, k = table(spark, d, "lineitem"), 64
    got = heavy.misra_gries(li, "l_suppkey", k, "l_quantity")
    true = li.groupBy(F.col("l_suppkey").alias("value")).agg(F.sum("l_quantity").alias("w"))
    whole = li.agg(F.sum("l_quantity").alias("all"))
    c = got.join(true, "value").join(F.broadcast(whole))  # one row
    fits = (F.col("count") >= F.col("w") - 1e-6) & (F.col("count") - F.col("w") <= F.col("delta") + 1e-6) & (F.col("delta") <= 2 * F.col("all") / (k + 1))
    return c.agg((F.bool_and(fits) & (F.count(F.lit(1)) <= k)).alias("within"))


@query("select l_returnflag, l_linenumber::varchar as value, sum(l_quantity) as count, 0.0::double as delta from lineitem group by 1, 2")
def misra_gries_merged(spark, d):
    """Serialised summaries of each year, merged by group; below k counters they are exact."""
    rows = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    days = heavy.summary(rows, "l_linenumber", 16, "l_quantity", ["l_returnflag", "year"]).drop("year")
    return heavy.summary_counts(heavy.summary_merge(days, ["l_returnflag"]), ["l_returnflag"])


@query("select l_returnflag, sum(l_quantity) > 0 as within from lineitem group by 1")
def misra_gries_merged_bound(spark, d):
    li, k, by = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate")), 32, ["l_returnflag"]
    got = heavy.summary_counts(heavy.summary_merge(heavy.summary(li, "l_suppkey", k, "l_quantity", [*by, "year"]).drop("year"), by), by)
    true = li.groupBy(*by, F.col("l_suppkey").cast("string").alias("value")).agg(F.sum("l_quantity").alias("w"))
    c = got.join(true, [*by, "value"]).join(F.broadcast(li.groupBy(*by).agg(F.sum("l_quantity").alias("all"))), by)  # a row a flag
    fits = (F.col("count") >= F.col("w") - 1e-6) & (F.col("count") - F.col("w") <= F.col("delta") + 1e-6) & (F.col("delta") <= F.col("all") / (k + 1) + 1e-6)
    return c.groupBy(*by).agg(F.bool_and(fits).alias("within"))


# ---- list kernels -----------------------------------------------------------------------------------------------


def _lines(spark, d):
    """Orders with the list of their lines' quantities, null where an order's key is divisible by five."""
    li = table(spark, d, "lineitem")
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))
    return lists.select("l_orderkey", F.when(F.col("l_orderkey") % 5 != 0, F.transform("x", lambda s: s["l_quantity"])).alias("q"))


_LINES = "lines as (select l_orderkey, case when l_orderkey % 5 <> 0 then list(l_quantity order by l_linenumber, l_quantity) end as q from lineitem group by 1)"


@query(f"with {_LINES} select l_orderkey, cast(coalesce(len(q), 0) as bigint) as n from lines")
def element_lengths_list(spark, d):
    t = _lines(spark, d)
    return t.select("l_orderkey", A.element_lengths(t, "q").alias("n"))


@query("select doc_id, cast(coalesce(octet_length(encode(text)), 0) as bigint) as n from documents")
def element_lengths_text(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", A.element_lengths(t, "text").alias("n"))


@query(f"with {_LINES} select l_orderkey as row, cast(unnest(generate_series(0, len(q) - 1)) as int) as pos from lines where q is not null")
def parent_indices(spark, d):
    return A.parent_indices(_lines(spark, d), "q", "l_orderkey")


@query("select event_id, cast(nullif(event_type, 'click') is null as tinyint) as is_null from events")
def null_bitmap(spark, d):
    t = table(spark, d, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("click")).alias("x"))
    return t.select("event_id", A.null_bitmap("x").alias("is_null"))


@query("select cast(coalesce(sum(octet_length(encode(text))), 0) as bigint) as total_bytes from documents")
def binary_total_bytes(spark, d):
    return table(spark, d, "documents").agg(A.total_bytes("text").alias("total_bytes"))


@query(
    """
select p.parent, l.values from (select unnest(generate_series(0, (select max(o_orderkey) + 3 from orders))) as parent) p
left join (select l_orderkey as parent, list(l_partkey order by l_linenumber, l_partkey) as values from lineitem where l_quantity > 25 group by 1) l using (parent)
"""
)
def regroup_lists(spark, d):
    n = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 4
    flat = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("value"))
    return A.regroup_range(flat, n)


@query("select vec_id as row, cast(i - 1 as int) as i0, embedding[i] as value from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings)")
def coo_from_lists(spark, d):
    return A.coo(table(spark, d, "embeddings"), "embedding", "vec_id")


def _nested(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = li.groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q"))
    return per.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "q"))).alias("x")).select("o_custkey", F.transform("x", lambda s: s["q"]).alias("nested"))


_NESTED = """per as (select o_custkey, o_orderkey, list(l_quantity order by l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
nest as (select o_custkey, list(q order by o_orderkey) as nested, max(len(q)) as longest from per group by 1)"""


@query(f"with {_NESTED} select [count(*), max(len(nested)), max(longest)] as dense_shape from nest")
def coo_dense_shape(spark, d):
    return A.coo_shape(_nested(spark, d), "nested")


@query(f"with {_LINES} select l_orderkey, coalesce(q, [-1.0, 0.0]::double[]) as q from lines")
def fill_null_lists(spark, d):
    t = _lines(spark, d)
    return t.select("l_orderkey", A.fill_null_lists(t, "q", [-1.0, 0.0]).alias("q"))


@query("select n_nationkey, case when n_name <> 'FRANCE' then [n_name] end as name_list from nation")
def singleton_lists(spark, d):
    return table(spark, d, "nation").select("n_nationkey", A.singleton(F.nullif(F.col("n_name"), F.lit("FRANCE"))).alias("name_list"))


@query(
    f"""with {_NESTED}, flat as (select o_custkey as row, flatten(nested) as v from nest)
select row, cast(i - 1 as int) as pos, v[i] as value from (select *, unnest(generate_series(1, len(v))) as i from flat)"""
)
def flatten_nested(spark, d):
    return A.flatten_nested(_nested(spark, d), "nested", "o_custkey")


@query(
    """
select event_id, cast(list_position(['purchase', 'view', NULL, 'login'], nullif(event_type, 'click')) - 1 as bigint) as i from events
"""
)
def index_in(spark, d):
    t = table(spark, d, "events")
    return t.select("event_id", A.index_in(F.nullif(F.col("event_type"), F.lit("click")), ["purchase", "view", "purchase", None, "login"]).alias("i"))


@query("select o_orderkey, o_orderpriority, r.pos as index_in from orders left join (select r_name as value, r_regionkey::bigint as pos from region union all select '1-URGENT', 9) r on o_orderpriority is not distinct from r.value")
def index_in_table(spark, d):
    words = table(spark, d, "region").select(F.col("r_name").alias("value"), F.col("r_regionkey").cast("long").alias("pos"))
    words = words.union(spark.createDataFrame([("1-URGENT", 9)], "value string, pos long"))
    return A.index_in_table(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", words)


@query(
    """
select cast(ceil(count(*) / 8.0) + count(*) * 8 as bigint) as key_bytes, cast(ceil(count(*) / 8.0) + count(*) * 4 as bigint) as number_bytes,
       cast(ceil(count(*) / 8.0) + (count(*) + 1) * 8 + sum(octet_length(encode(l_returnflag))) as bigint) as flag_bytes from lineitem
"""
)
def byte_size(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(A.byte_size(t, "l_orderkey").alias("key_bytes"), A.byte_size(t, "l_linenumber").alias("number_bytes"), A.byte_size(t, "l_returnflag").alias("flag_bytes"))


@query(
    """
select cast(3 * ceil(count(*) / 8.0) + ceil(sum(len(embedding)) / 8.0) + count(*) * 12 + (count(*) + 1) * 8 + sum(len(embedding)) * 4 as bigint) as total from embeddings
"""
)
def byte_size_total(spark, d):
    t = table(spark, d, "embeddings")
    return t.agg(A.total_byte_size(t).alias("total"))


@query("select cast(count(*) filter (where l_orderkey % 5 <> 0 and (l_orderkey % 7 = 0 or l_linenumber = 3)) as bigint) as n_invalid from lineitem")
def invalid_utf8_count(spark, d):
    t = table(spark, d, "lineitem")
    text = F.encode("l_returnflag", "UTF-8")
    bad = F.when(F.col("l_orderkey") % 7 == 0, F.concat(text, F.unhex(F.lit("C328")))).when(F.col("l_linenumber") == 3, F.concat(F.unhex(F.lit("E282")), text)).otherwise(text)
    return t.select(F.when(F.col("l_orderkey") % 5 != 0, bad).alias("x")).agg(A.invalid_utf8("x").alias("n_invalid"))


# ---- unions, gathering, paths ------------------------------------------------------------------------------------


@query(
    """
select o_orderkey, o_totalprice, null::varchar as o_orderstatus, null::varchar as o_orderpriority from orders where o_orderkey % 3 = 0
union all select o_orderkey, null, o_orderstatus, null from orders where o_orderkey % 3 = 1
union all select o_orderkey, null, null, o_orderpriority from orders where o_orderkey % 3 = 2
"""
)
def merge_batches(spark, d):
    o = table(spark, d, "orders")
    return relational.merge_batches([o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 3 = 1").select("o_orderkey", "o_orderstatus"), o.where("o_orderkey % 3 = 2").select("o_orderpriority", "o_orderkey")])


@query(
    """
select s_suppkey as k, s_name as name, null::integer as nation, null::double as acct from supplier where s_suppkey % 2 = 0
union all select s_suppkey, null, s_nationkey, s_acctbal from supplier where s_suppkey % 2 = 1
"""
)
def merge_struct_batches(spark, d):
    s = table(spark, d, "supplier")
    a = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.struct(F.col("s_name").alias("name")).alias("s"), F.lit(None).alias("t"))
    b = s.where("s_suppkey % 2 = 1").select("s_suppkey", F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acct")).alias("s"))
    return relational.merge_batches([a, b]).select(F.col("s_suppkey").alias("k"), "s.name", "s.nation", "s.acct")


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 256 as batch_id from orders")
def batch_ids(spark, d):
    return relational.batch_ids(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 256)


@query("select i.pos, n.n_nationkey, n.n_name from (values (0, 3), (1, 3), (2, 0), (3, 24), (4, 7)) i(pos, k) join nation n on n.n_nationkey = i.k")
def take_rows(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return relational.take_list(n, "n_nationkey", [3, 3, 0, 24, 7]).withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


def _customers(spark, d):
    o = table(spark, d, "orders")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    c = table(spark, d, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who"), "orders")


@query(
    """
select 'who.name' as path, c_custkey as row, 1::bigint as n_values, 0::bigint as n_missing from customer
union all select 'who.nation', c_custkey, 1, count_if(c_nationkey is null)::bigint from customer group by c_custkey
union all select 'orders.o_orderkey', o_custkey, count(*), 0 from orders where o_custkey in (select c_custkey from customer) group by o_custkey
union all select 'orders.o_orderstatus', o_custkey, count(*), count_if(o_orderstatus is null)::bigint from orders where o_custkey in (select c_custkey from customer) group by o_custkey
"""
)
def enumerate_leaves(spark, d):
    return paths.leaf_values(_customers(spark, d), "c_custkey")


@query("select o_custkey as row, o_orderkey as value from orders where o_custkey in (select c_custkey from customer)")
def get_nested_path(spark, d):
    return paths.get_array(_customers(spark, d), ("orders", "o_orderkey"), "c_custkey").select("row", "value")


@query("select p_partkey, [p_size::bigint] as p_size, [p_retailprice] as p_retailprice, [encode(p_name)] as p_name from part")
def canonicalize(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    return relational.canonicalize(t).withColumn("p_partkey", F.get("p_partkey", 0))


_LINE_SCHEMA = FeatureSchema((Feature("l_orderkey", "INT"), Feature("l_partkey", "INT"), Feature("l_quantity", "FLOAT"), Feature("l_returnflag", "BYTES")))


@query("select l_orderkey, l_quantity from lineitem")
def project_tensors(spark, d):
    keep = project(_LINE_SCHEMA, ["l_orderkey", "l_quantity"])
    return tables.read_parquet(spark, f"{d}/lineitem.parquet", [f.name for f in keep.features])


@query("select d.doc_id, d.lang, d.n_chars, l.quality as label from documents d join labels l using (doc_id)")
def label_split(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return relational.split_label(t, "quality").select("features.doc_id", "features.lang", "features.n_chars", "label")


# ---- CSV --------------------------------------------------------------------------------------------------------

_CSV = csv.CsvFormat(("key", "status", "price", "word"))
_CSV_SQL = """select o_orderkey as key, case when o_orderkey % 4 <> 0 then o_orderstatus end as status,
case when o_orderkey % 3 <> 0 then cast(o_custkey as float) / 4 end as price, case when o_orderkey % 5 <> 0 then 'say "' || o_orderpriority || '", please' end as word from orders"""


def _csv_lines(spark, d):
    o = table(spark, d, "orders")
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    cell = lambda n, c: F.when(F.col("o_orderkey") % n != 0, c).otherwise("")
    word = F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('", please'))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), cell(4, F.col("o_orderstatus")), cell(3, (F.col("o_custkey") / 4).cast("decimal(20,2)").cast("string")), cell(5, q(word)))
    return o.select("o_orderkey", line.alias("line"))


@query(
    """
with t as (select o_orderkey::varchar as key, case when o_orderkey % 4 <> 0 then o_orderstatus end as status,
                  case when o_orderkey % 3 <> 0 then (o_custkey / 4)::decimal(20, 2)::varchar end as price,
                  case when o_orderkey % 5 <> 0 then 'say "' || o_orderpriority || '", please' end as word from orders),
c as (unpivot t on key, status, price, word into name name value cell)
select name, case when count(cell) = 0 then 'UNKNOWN' when bool_and(regexp_full_match(cell, '[0-9]+')) then 'INT'
                  when bool_and(try_cast(cell as double) is not null) then 'FLOAT' else 'BYTES' end as kind from c group by name
"""
)
def csv_infer_types(spark, d):
    return spark.createDataFrame(list(csv.infer_types(_csv_lines(spark, d), "line", _CSV).items()), "name string, kind string")


@query(f"with t as ({_CSV_SQL}) select [key] as key, case when status is not null then [encode(status)] end as status, case when price is not null then [price] end as price, case when word is not null then [encode(word)] end as word from t")
def csv_decode(spark, d):
    return csv.decode(_csv_lines(spark, d), "line", _CSV)


@query(
    """
select [o_orderkey] as key, case when o_orderkey % 4 <> 0 then [o_custkey, o_orderkey % 10] end as pair, [encode(o_orderkey || ',' || case when o_orderkey % 4 <> 0 then o_custkey || '|' || o_orderkey % 10 else '' end)] as raw from orders
"""
)
def csv_multivalent(spark, d):
    form = csv.CsvFormat(("key", "pair"), multivalent=("pair",), secondary="|")
    pair = F.when(F.col("o_orderkey") % 4 != 0, F.concat_ws("|", F.col("o_custkey"), F.col("o_orderkey") % 10)).otherwise("")
    lines = table(spark, d, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), pair).alias("line"))
    return csv.decode(lines, "line", form, raw_record="raw")


# ---- statistics, profiles ---------------------------------------------------------------------------------------

_NUMERIC = ["l_quantity", "l_discount", "l_tax"]


@query(
    " union all ".join(
        f"select '{s}' as slice, '{c}' as feature_id, false as is_path, count(*) as num_examples, 'FLOAT' as type, 'num' as stats_kind, count({c}) as n, cast(sum({c} * 100) as bigint) as sum100, min({c}) as min, max({c}) as max from lineitem where l_returnflag = '{s}' group by all"
        for s in "ANR"
        for c in _NUMERIC
    )
)
def stats_merge(spark, d):
    li = table(spark, d, "lineitem")
    shards = stats.column_statistics(li.withColumn("year", F.year("l_shipdate")), _NUMERIC, F.concat_ws("/", "l_returnflag", F.col("year").cast("string")))
    shards = shards.select(F.split("slice", "/")[0].alias("slice"), F.split("slice", "/")[1].alias("shard"), *shards.columns[1:])
    every = shards.groupBy("slice", "feature_id").agg(F.sum("num_examples").alias("all"))
    shards = shards.join(every, ["slice", "feature_id"]).withColumn("num_examples", F.col("all"))
    shards = shards.withColumn("sum100", F.round(F.col("sum") * 100).cast("long")).withColumn("lows", F.array("min")).withColumn("highs", F.array("max"))
    out = stats.merge_statistics(shards, sums=["n", "sum100"], lists=["lows", "highs"], order="shard")
    return out.select("slice", "feature_id", "is_path", "num_examples", "type", "stats_kind", "n", "sum100", F.array_min("lows").alias("min"), F.array_max("highs").alias("max"))


@query("select l_returnflag as slice, 'l_quantity' as path_x, 'l_tax' as path_y, count(*) as count, 'num_cross' as stats_kind, cast(sum(l_quantity * (l_tax * 100)) as bigint) as xy from lineitem group by 1")
def stats_merge_cross(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    xy = F.sum(F.col("l_quantity") * F.round(F.col("l_tax") * 100))
    part = li.groupBy(F.col("l_returnflag").alias("slice"), "year").agg(xy.cast("long").alias("xy"))
    total = li.groupBy(F.col("l_returnflag").alias("slice")).agg(F.count(F.lit(1)).alias("count"))
    shards = part.join(total, "slice").select("slice", F.lit("l_quantity").alias("path_x"), F.lit("l_tax").alias("path_y"), F.when(F.col("year") % 2 == 0, F.col("count")).otherwise(0).cast("long").alias("count"), F.lit("num_cross").alias("stats_kind"), "xy")
    shards = shards.unionByName(shards.withColumn("count", F.lit(0).cast("long")).withColumn("stats_kind", F.lit("")).withColumn("xy", F.lit(0).cast("long")))
    return stats.merge_cross_statistics(shards, sums=["xy"])


_EVENTS_SQL = "t as (select [event_id] as a, case when event_id % 3 <> 0 then [value, value] end as b, case when event_id % 4 <> 0 then [event_type] end as c from events)"


def _event_lists(spark, d):
    e = table(spark, d, "events")
    return e.select(F.array("event_id").alias("a"), F.when(F.col("event_id") % 3 != 0, F.array("value", "value")).alias("b"), F.when(F.col("event_id") % 4 != 0, F.array("event_type")).alias("c"), F.lit(None).alias("n"))


@query(f"with {_EVENTS_SQL} select 'INT' as kind, count(a) as cells from t union all select 'FLOAT', count(b) from t union all select 'STRING', count(c) from t union all select 'NULL', count(*) from t")
def profile_num_cells(spark, d):
    return prof.num_cells(_event_lists(spark, d))


@query(f"with {_EVENTS_SQL}, n as (select (a is not null)::int + (b is not null)::int + (c is not null)::int as n from t) select min(n)::bigint as min, max(n)::bigint as max, count(n) as count, sum(n)::bigint as sum from n")
def profile_num_columns(spark, d):
    t = _event_lists(spark, d)
    return t.agg(prof.num_columns(t).alias("d")).select("d.*")


@query(
    f"""with {_EVENTS_SQL}, n as (select 'INT' as kind, coalesce(len(a), 0) as n from t union all select 'FLOAT', coalesce(len(b), 0) from t union all select 'STRING', coalesce(len(c), 0) from t union all select 'NULL', 1 from t)
select kind, min(n)::bigint as min, max(n)::bigint as max, count(*) as count, sum(n)::bigint as sum from n group by 1
union all select 'ALL', min(n)::bigint, max(n)::bigint, count(*), sum(n)::bigint from n"""
)
def profile_num_values(spark, d):
    return prof.value_distributions(_event_lists(spark, d))


@query("select count(*) as num_raw_records, min(n)::bigint as min, max(n)::bigint as max, count(n) as count, sum(n)::bigint as sum from (select octet_length(encode(text)) as n from conversations)")
def raw_record_profile(spark, d):
    return prof.raw_records(table(spark, d, "conversations"), "text")


@query("select case when column_name like '%key' then 'dense' else 'varlen' end as kind, count(*) as n from (describe lineitem) group by 1")
def representation_counts(spark, d):
    names = table(spark, d, "lineitem").columns
    schema = FeatureSchema(tuple(Feature(n, "INT", shape=(1,), min_fraction=1) if n.endswith("key") else Feature(n) for n in names))
    return spark.createDataFrame(list(prof.representation_counts(infer_representations(schema)).items()), "kind string, n long")


@query("select 'engine.lineitem' as metric, cast(2 * ceil(count(*) / 8.0) + count(*) * 16 as bigint) as bytes from lineitem")
def tracked_bytes(spark, d):
    return prof.tracked_bytes(table(spark, d, "lineitem").select("l_orderkey", "l_tax"), "engine", "lineitem")


@query()
def profile_lineitem(spark, d):
    return column_profile(table(spark, d, "lineitem"))


# ---- tensors ----------------------------------------------------------------------------------------------------


@query("select l_orderkey as row, [l_linenumber::bigint] as i0, l_quantity as value from lineitem".replace("[l_linenumber::bigint]", "l_linenumber::bigint"))
def sparse_tensor(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))
    t = li.select("l_orderkey", F.transform("x", lambda s: s["l_linenumber"].cast("long")).alias("at"), F.transform("x", lambda s: s["l_quantity"]).alias("q"))
    r = Representation("sparse", ("q",), indices=("at",), sizes=(-1,))
    return tensors.sparse_rows(t.select("l_orderkey", tensors.to_tensor(t, "t", r)), "t", "l_orderkey", 1)


@query("select [count(*), max(n)] as dense_shape from (select l_orderkey, count(*) as n from lineitem group by 1)")
def varlen_dense_shape(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return tensors.sparse_shape(t.select(tensors.to_tensor(t, "t", Representation("varlen", ("q",)))), "t")


@query('select l_orderkey as "order", cast(sum(n) over (order by l_orderkey) as bigint) as split from (select l_orderkey, count(*) as n from lineitem group by 1)')
def ragged_row_splits(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return tensors.row_splits(t, "q", "l_orderkey")


@query(f"with {_NESTED} select o_custkey, nested as value from nest")
def ragged_partition(spark, d):
    n = _nested(spark, d)
    t = n.select("o_custkey", A.flattened(n, "nested").alias("v"), F.transform("nested", lambda x: F.size(x).cast("long")).alias("lengths"))
    r = Representation("ragged", ("v",), partitions=(("lengths", "lengths"),))
    return t.select("o_custkey", tensors.to_tensor(t, "value", r))


@query("select vec_id, embedding as t from embeddings")
def dense_tensor(spark, d):
    t = table(spark, d, "embeddings")
    return t.select("vec_id", tensors.to_tensor(t, "t", Representation("dense", ("embedding",), shape=(8, 8))))


@query("select event_id, case when event_id % 3 = 0 then [-1.0, -1.0]::double[] else [value, value] end as t from events")
def dense_tensor_default(spark, d):
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.array("value", "value")).alias("v"))
    return t.select("event_id", tensors.to_tensor(t, "t", Representation("dense", ("v",), shape=(2,), default=-1.0)))


@query("select o_orderkey as row, coalesce(l.q, []) as q from orders left join (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity) as q from lineitem where l_quantity > 25 group by 1) l on l_orderkey = o_orderkey")
def tensor_to_columns(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 25")
    coordinates = li.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("i0"), F.col("l_quantity").alias("value"))
    return tensors.from_sparse(coordinates, table(spark, d, "orders").select(F.col("o_orderkey").alias("row")), name="q")


# ---- codecs -----------------------------------------------------------------------------------------------------


@query("select [o_orderkey] as key, case when o_orderkey % 3 <> 0 then [cast(o_totalprice as float), 0.5::float] end as price, case when o_orderkey % 4 <> 0 then [encode(o_orderstatus)] else [] end as status from orders")
def example_round_trip(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.array("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 != 0, F.array(F.col("o_totalprice").cast("float"), F.lit(0.5).cast("float"))).alias("price"), F.when(F.col("o_orderkey") % 4 != 0, F.array(F.encode("o_orderstatus", "UTF-8"))).otherwise(F.array().cast("array<binary>")).alias("status"))
    return examples.decode_examples(examples.encode_examples(rows), "record", {"key": "INT", "price": "FLOAT", "status": "BYTES"})


@query(
    """
with t as (select o_orderkey as key, case when o_orderkey % 3 <> 0 then o_totalprice end as price, null as never from orders),
k as (select 'key' as name, max(case when key is not null then typeof(key) end) as kind from t
      union all select 'price', max(case when price is not null then typeof(price) end) from t union all select 'never', max(case when never is not null then typeof(never) end) from t)
select name, case kind when 'BIGINT' then 'INT' when 'INTEGER' then 'INT' when 'DOUBLE' then 'FLOAT' end as kind from k
"""
)
def example_infer_schema(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.array("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 != 0, F.array(F.col("o_totalprice").cast("float"))).alias("price"), F.lit(None).alias("never"))
    return spark.createDataFrame(list(examples.infer_schema(examples.encode_examples(rows), "record").items()), "name string, kind string")


@query("select [conv_id] as conv, list([encode(role)] order by turn, role, text) as roles, list([encode(text)] order by turn, role, text) as texts from conversations group by conv_id")
def sequence_round_trip(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    step = lambda f: F.transform("x", lambda s: F.array(F.encode(s[f], "UTF-8"))).alias(f)
    rows = c.select(F.array("conv_id").alias("conv"), F.struct(step("role"), step("text")).alias(examples.SEQUENCE))
    out = examples.decode_sequences(examples.encode_sequences(rows), "record", {"conv": "INT"}, {"role": "BYTES", "text": "BYTES"})
    return out.select("conv", F.col(f"`{examples.SEQUENCE}`.role").alias("roles"), F.col(f"`{examples.SEQUENCE}`.text").alias("texts"))


def _shared(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which executors share; the caller has to set it."""
    import uuid

    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.startswith("local"):  # one machine: its temporary folder is shared
        import tempfile

        path = tempfile.mkdtemp(prefix="records-")
    if not path:
        raise ValueError("record files need a folder that executors share: set spark.checkpoint.dir")
    return f"{path.rstrip('/')}/records-{uuid.uuid4().hex}"


@query("select [n_nationkey::bigint] as key, [encode(n_name)] as name from nation")
def record_file_round_trip(spark, d):
    n = table(spark, d, "nation").select(F.array(F.col("n_nationkey").cast("long")).alias("key"), F.array(F.encode("n_name", "UTF-8")).alias("name"))
    path = _shared(spark)
    records.write_records(examples.encode_examples(n), path)
    return records.example_records(f"{path}/part-*", FeatureSchema((Feature("key", "INT"), Feature("name", "BYTES")))).load(spark)


@query("select [encode(n_name)] as raw_record from nation")
def raw_record_files(spark, d):
    path = _shared(spark)
    records.write_records(table(spark, d, "nation").select(F.encode("n_name", "UTF-8").alias("record")), path, compress=True)
    return records.raw_records(f"{path}/part-*").load(spark)


@query("select o_orderkey, [encode(o_orderkey || '/' || o_orderstatus)] as raw from orders")
def attach_raw_records(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.encode(F.concat_ws("/", F.col("o_orderkey").cast("string"), "o_orderstatus"), "UTF-8").alias("record"))
    return examples.append_raw_record(o, "raw", "record")


@query("select n_nationkey::bigint as k, r_name as region_name, cast(n_nationkey % 2 = 0 as bigint) as even from nation join region on n_regionkey = r_regionkey")
def flatten_dataset(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.flatten_dataset(n.select(F.col("n_nationkey").alias("k"), F.struct(F.col("r_name").alias("name")).alias("region"), (F.col("n_nationkey") % 2 == 0).alias("even")))


# ---- slices -----------------------------------------------------------------------------------------------------


@query("select 'event_type:' || event_type as slice, count(*) as n from events where event_type is not null group by 1 union all select '', count(*) from events")
def slice_keys(spark, d):
    return slicing.slice_counts(table(spark, d, "events"), [(["event_type"], {}), ([], {})])


@query("select 'event_type:' || event_type || ',bucket:' || user_id % 4 as slice, count(*) as n, cast(sum(round(value * 100)) as bigint) as cents from events where event_type is not null group by 1")
def slice_keys_cross(spark, d):
    e = table(spark, d, "events").withColumn("bucket", F.col("user_id") % 4)
    return slicing.slice_counts(e, [(["event_type", "bucket"], {})], {"cents": F.sum(F.round(F.col("value") * 100)).cast("long")})


@query("select 'lang:' || lang || ',quality:0' as slice, count(*) as n from documents join labels using (doc_id) where quality = 0 group by 1")
def slice_fixed_value(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return slicing.slice_counts(t, [(["lang"], {"quality": "0.0"})]).withColumn("slice", F.regexp_replace("slice", "quality:0.0", "quality:0"))


@query("select doc_id as row, case when quality = 1 and toxic = 1 then 'group=good_toxic' when quality = 1 then 'group=good' else '' end as slice from labels")
def slice_bpsn(spark, d):
    sql = "SELECT STRUCT(if(example.toxic = 1, 'good_toxic', 'good') AS group) WHERE example.quality = 1"
    out = slicing.slices_sql(table(spark, d, "labels"), "doc_id", sql)
    return out.select("row", F.array_join(F.transform(F.flatten("slices"), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("slice"))


@query(f"with {_LINES} select l_orderkey as row, cast(count_if(x > 40) as bigint) as n_slices from (select l_orderkey, unnest(case when q is null then [0.0] else q end) as x from lines) group by 1")
def slice_sql_unnest(spark, d):
    out = slicing.slices_sql(_lines(spark, d), "l_orderkey", "SELECT STRUCT(q AS quantity) FROM example.q WHERE q > 40")
    return out.select("row", F.size("slices").cast("long").alias("n_slices"))


@query("select c as feature_id, n from (select 'l_quantity' as c, count(*) as n, max(l_quantity) as m from lineitem union all select 'l_discount', count(*), max(l_discount) from lineitem union all select 'l_tax', count(*), max(l_tax) from lineitem) where m < 1")
def stats_predicate(spark, d):
    s = stats.column_statistics(table(spark, d, "lineitem"), _NUMERIC)
    return slicing.unary_predicate(s, "feature.max < 1 and feature.n_missing = 0").select("feature_id", "n")


@query("select c as feature_id from (select 'l_quantity' as c, max(l_quantity) as a, max(l_quantity) filter (where l_returnflag = 'A') as b from lineitem union all select 'l_tax', max(l_tax), max(l_tax) filter (where l_returnflag = 'A') from lineitem) where a = b")
def stats_predicate_pair(spark, d):
    li = table(spark, d, "lineitem")
    cols = ["l_quantity", "l_tax"]
    return slicing.binary_predicate(stats.column_statistics(li, cols), stats.column_statistics(li.where("l_returnflag = 'A'"), cols), ["feature_id"], "feature_base.max = feature_test.max").select("feature_id")


# ---- inference --------------------------------------------------------------------------------------------------


def _spec(method, weights, bias=0.0, outputs=None, inputs=("x",)):
    return inference.ModelSpec(f"linear:{weights}:{bias}", (inference.Signature(method, inputs, outputs or {"output": "double"}),), inference.linear(list(weights), bias))


@query("select l_orderkey, l_linenumber, cast(l_quantity * 2 - l_tax * 100 + 0.25 as float) as y from lineitem")
def infer_linear(spark, d):
    spec = inference.ModelSpec("linear", (inference.Signature("predict", ("a", "b"), {"y": "float"}),), inference.linear([2.0, -100.0], 0.25, "y"))
    out = inference.run_inference(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], spec)
    return out.select("l_orderkey", "l_linenumber", "prediction.y")


@query("select vec_id, case when embedding[1] > 0 then 'pos' else 'neg' end as label from embeddings")
def infer_classify(spark, d):
    spec = _spec("classify", [1.0] + [0.0] * 63, outputs={"classes": "string", "scores": "float"})
    out = inference.run_inference(table(spark, d, "embeddings"), ["embedding"], spec)
    best = F.reduce("prediction", F.get("prediction", 0), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))
    return out.select("vec_id", best["label"].alias("label"))


@query("select vec_id, cast(embedding[1] as float) as first, cast(embedding[2] * 2.0 + 1 as float) as second from embeddings")
def infer_per_model(spark, d):
    specs = [_spec("regress", [1.0] + [0.0] * 63), _spec("regress", [0.0, 2.0] + [0.0] * 62, 1.0)]
    out = inference.run_inference_per_model(table(spark, d, "embeddings"), ["embedding"], specs)
    return out.select("vec_id", F.col("predictions.m0").alias("first"), F.col("predictions.m1").alias("second"))


@query(f"with {_LINES} select l_orderkey, list_transform(q, lambda x: cast(x * 0.5 + 1 as float)) as predictions from lines")
def infer_keyed_batches(spark, d):
    return inference.run_inference_on_batches(_lines(spark, d), "q", _spec("regress", [0.5], 1.0)).drop("q")


# ---- flagship ---------------------------------------------------------------------------------------------------


def column_profile(df: DataFrame, n: int = 4) -> DataFrame:
    """(column, metric, value): cells, distinct values, quantiles and most frequent values of every column, as text."""
    names = df.columns
    counts = df.agg(*[F.count(c).alias(c) for c in names]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("cells").alias("metric"), F.col(c).cast("string").alias("value")) for c in names])))
    theta = df.agg(*[F.theta_sketch_estimate(F.theta_sketch_agg(F.col(c).cast("string"))).alias(c) for c in names])
    uniques = theta.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("distinct").alias("metric"), F.col(c).cast("string").alias("value")) for c in names])))
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer")]
    q = quantiles.streams(df, numeric, n)
    name = F.element_at(F.lit(numeric).cast("array<string>"), F.col("stream") + 1)
    bounds = q.select(name.alias("column"), F.concat(F.lit("quantile "), F.col("r").cast("string")).alias("metric"), F.col("quantile").cast("string").alias("value"))
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in texts])).alias("x")).select("x.*")
    top = heavy.top_k(long, "v", 3, by=["column"]).select("column", F.concat(F.lit("top "), F.col("value")).alias("metric"), F.col("count").cast("long").cast("string").alias("value"))
    return counts.unionAll(uniques).unionAll(bounds).unionAll(top)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(table(spark, sf_dir, "lineitem"))
