"""Fill-in-the-middle transformation by relational operations over units.

A text's units (lines by default) are exploded with their positions, and window running sums of their lengths give where
each unit ends. A document asks for two cuts by unit ordinal: the units join these requests, the offsets found are
aggregated by document, and the text is cut there with substring into prefix, middle and suffix, which change places
between sentinels.

Documents are shuffled once, by a digest of the row; rows that repeat another are counted before that. All that
follows (explosion, window, join with the requests, join with the texts) keeps this partitioning, so neither units nor
offsets are ever shuffled. The units of a document stay in the task that holds its text; windows and joins spill.

The choices of a document come from the hex sha256 of a salt and its id, so they don't depend on partitions or retries.
A text that is empty, contains a sentinel or isn't chosen (rate) stays plain. Other texts can be rebuilt from output and
form: a sentinel shares no beginning with its own end, so none arises where a piece and a sentinel meet.

Null texts are empty. A null id hashes as no digits. Rows that repeat an id or a text are transformed one by one, and
equal rows give equal rows. An empty table gives an empty table; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
SALT = "7:"
RATE, SPM = 100, 50  # percent of documents transformed, and of these with the suffix first


def _number(digest: str, i: int) -> Column:
    """The i-th group (from 0) of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def rebuilt(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that gave this output in this form (plain, psm or spm)."""
    p, s, m = sentinels
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)  # the two sentinels and pieces before the middle
    psm = F.concat(F.substr(F.substring_index(head, s, 1), F.lit(len(p) + 1)), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substr(F.substring_index(head, p, 1), F.lit(len(s) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(
    docs: DataFrame, units: str = LINES, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS, salt: str = SALT
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points, null if plain), text, output for docs(doc_id, text).

    units is a pattern whose matches, from left to right, must cover every text. A sentinel must not be able to begin
    within itself or within another (as "<P>" can't).
    """
    for a in sentinels:
        if any(b.startswith(a[i:]) for b in sentinels for i in range(1, len(a))) or sum(a in b for b in sentinels) > 1:
            raise ValueError("sentinels overlap")
    p, s, m = sentinels
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), "text"), 256)
    # copies is read wherever documents are, so that all readers have one shuffle in common
    key = F.coalesce(F.substring(F.unhex(row), 1, 16), F.lit(b""))  # never null, so no reader filters it before the shuffle
    documents = (
        given.groupBy(key.alias("key"))
        .agg(F.any_value(F.struct("doc_id", "text")).alias("row"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 0")
        .select("key", "row.doc_id", "row.text", "copies")
    )
    matches = F.regexp_extract_all("text", F.lit(units), F.lit(0))
    exploded = documents.select("key", F.posexplode(matches).alias("pos", "unit")).select("key", (F.col("pos") + 1).alias("ordinal"), F.char_length("unit").cast("long").alias("length"))
    upto = Window.partitionBy("key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = exploded.select("key", "ordinal", F.sum("length").over(upto).alias("end"))

    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    kept = (F.col("text") == "") | F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    form = F.when(kept | (_number("digest", 2) % 100 >= rate), "plain").when(_number("digest", 3) % 100 < spm, "spm").otherwise("psm")
    cuts = [_number("digest", i) % (F.col("n") + 1) for i in (0, 1)]
    asked = (
        documents.withColumn("digest", digest)
        .withColumn("n", F.regexp_count("text", F.lit(units)).cast("long"))
        .select("key", "doc_id", "text", "copies", "n", form.alias("form"), F.least(*cuts).alias("first"), F.greatest(*cuts).alias("last"))
    )
    requests = asked.where("form <> 'plain'").select(F.col("key").alias("_key"), "first", "last")
    offsets = (
        ends.join(requests, (F.col("key") == F.col("_key")) & F.col("ordinal").isin(F.col("first"), F.col("last")))
        .groupBy("key")
        .agg(F.max(F.when(F.col("ordinal") == F.col("first"), F.col("end"))).alias("a"), F.max(F.when(F.col("ordinal") == F.col("last"), F.col("end"))).alias("b"))
    )
    a, b = (F.coalesce(c, F.lit(0)).cast("int") for c in ("a", "b"))  # a cut before all units asks for no unit
    whole = asked.join(offsets, "key", "left").withColumns({"a": a, "b": b})
    prefix, middle = F.substr("text", F.lit(1), F.col("a")), F.substr("text", F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substr("text", F.col("b") + 1)
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    output = F.when(F.col("form") == "psm", said(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", said(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    moved = F.col("form") != "plain"
    return whole.select(
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"), "doc_id", "n", "form",
        F.when(moved, F.col("a").cast("long")).alias("prefix_chars"), F.when(moved, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"),
        "text", output.alias("output"),
    ).drop("_copy")


def op11_fim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    restored = rebuilt(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units
  from documents
),
c as (
  select doc_id, text, units, cast(len(units) as bigint) as n,
         list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as h
  from d
),
f as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as c1, greatest(h[1] % (n + 1), h[2] % (n + 1)) as c2,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 then 'plain'
              when h[4] % 100 < 50 then 'spm' else 'psm' end as form
  from c
),
p as (
  select doc_id, n, form, text, array_to_string(units[1:c1], '') as prefix,
         array_to_string(units[c1 + 1:c2], '') as middle, array_to_string(units[c2 + 1:], '') as suffix
  from f
)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
