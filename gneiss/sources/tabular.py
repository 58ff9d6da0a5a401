"""One interface over all sources (P1, P1a, S1-S12): columns, tensors, and projection by tensor.

A source knows its feature schema and the tensors that its columns make. Projecting names tensors: a projection of a
projection is taken from the original, and keeps the original's specifications. What a projection means for reading
depends on the source: example and sequence records decode fewer features, Parquet reads fewer columns, CSV lines are
split whole and only the tensors are fewer, raw records have one column and one tensor whatever is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators import relational, tensors
from gneiss.plans import features as feat
from gneiss.plans.features import FeatureSchema, Representation
from gneiss.sources import csv, examples, records, tables


class TabularSource:
    """Subclasses say how raw rows are read and decoded, and how a schema narrows."""

    def __init__(self, schema: FeatureSchema | None, representations: dict[str, Representation] | None = None, raw_record: str | None = None):
        self.schema, self.raw_record = schema, raw_record
        if schema is not None and raw_record is not None and schema.feature(raw_record) is not None:
            raise ValueError(f"{raw_record} is a feature already")
        self._representations = representations
        self._origin: TabularSource | None = None

    # -- what a source gives

    def load(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def representations(self) -> dict[str, Representation]:
        """Explicit representations of the schema, inferred ones for the columns that they leave."""
        if self._representations is not None:
            return self._representations
        if self.schema is None:
            raise ValueError("without a schema there are no tensors")
        return feat.infer_mixed(self.schema)

    def spark_schema(self) -> T.StructType:
        if self.schema is None:
            raise ValueError("without a schema the columns are known only when they have been read")
        fields = list(self.schema.spark_type().fields)
        return T.StructType([*fields, *([T.StructField(self.raw_record, T.ArrayType(T.BinaryType()))] if self.raw_record else [])])

    def adapter(self, df: DataFrame) -> tensors.TensorAdapter:
        origin = self._origin.representations() if self._origin else None
        return tensors.TensorAdapter(df.schema, self.representations(), origin)

    def tensors(self, spark: SparkSession) -> DataFrame:
        df = self.load(spark)
        return self.adapter(df).to_tensors(df)

    def batches(self, spark: SparkSession, batch_size: int, **options) -> Iterator[list]:
        """Batches of decoded rows for a local consumer."""
        return relational.record_batches(self.load(spark), batch_size, **options)

    def labelled(self, spark: SparkSession, batch_size: int, label: str | None = None, **options) -> Iterator:
        """Batches of tensors, a label apart if one is named."""
        return relational.labelled_batches(self.tensors(spark), label, batch_size=batch_size, **options)

    # -- projection

    def project(self, names: list[str]) -> "TabularSource":
        origin = self._origin or self
        have = origin.representations()
        if unknown := [n for n in names if n not in have]:
            raise ValueError(f"no such tensor: {', '.join(unknown)}")
        keep = {n: have[n] for n in names}
        out = origin._narrowed(keep)
        out._representations, out._origin = keep, origin
        return out

    def _narrowed(self, keep: dict[str, Representation]) -> "TabularSource":
        raise NotImplementedError

    def _narrow_schema(self, keep: dict[str, Representation]) -> FeatureSchema:
        paths = {c for r in keep.values() for c in feat.source_columns(r)}
        kept = []
        for f in self.schema.features:
            if any(p[0] == f.name for p in paths):
                kept.append(replace(f, children=tuple(c for c in f.children if (f.name, c.name) in paths)) if f.type == "STRUCT" else f)
        return FeatureSchema(tuple(kept), tuple(s for s in self.schema.sparse if s.name in keep), {})


class Examples(TabularSource):
    """Example records, from files or from a function that gives a DataFrame with a record column."""

    def __init__(self, paths: str | list[str] | Callable[[SparkSession], DataFrame], schema: FeatureSchema | None = None, raw_record: str | None = None, column: str = "record"):
        super().__init__(schema, None, raw_record)
        self.paths, self.column = paths, column

    def raw(self, spark: SparkSession) -> DataFrame:
        return self.paths(spark) if callable(self.paths) else records.read_records(spark, self.paths, self.column)

    def load(self, spark: SparkSession) -> DataFrame:
        return examples.decode_examples(self.raw(spark), self.column, self.schema, self.raw_record)

    def _narrowed(self, keep):
        return type(self)(self.paths, self._narrow_schema(keep), self.raw_record, self.column)


class Sequences(Examples):
    """Sequence-example records."""

    def load(self, spark: SparkSession) -> DataFrame:
        return examples.decode_sequences(self.raw(spark), self.column, self.schema, raw_record=self.raw_record)


class Csv(TabularSource):
    """CSV files, or lines at hand."""

    def __init__(self, paths: str | list[str] | Callable[[SparkSession], DataFrame], form: csv.CsvFormat, schema: FeatureSchema | None = None, raw_record: str | None = None, skip_header_lines: int = 0, column: str = "value"):
        super().__init__(schema, None, raw_record)
        self.paths, self.form, self.skip, self.column = paths, form, skip_header_lines, column
        if schema is not None:
            csv.types_from_schema(form.column_names, schema)

    def load(self, spark: SparkSession) -> DataFrame:
        if callable(self.paths):
            return csv.decode(self.paths(spark), self.column, self.form, self.schema, self.raw_record)
        return csv.read(spark, self.paths, self.form, self.schema, self.raw_record, self.skip)

    def spark_schema(self) -> T.StructType:
        return csv.spark_schema(self.form.column_names, self.schema, self.raw_record)

    def _narrowed(self, keep):
        return Csv(self.paths, self.form, self.schema, self.raw_record, self.skip, self.column)


class Parquet(TabularSource):
    """Parquet files whose columns are lists; only the columns of the schema are read."""

    def __init__(self, paths: str | list[str], schema: FeatureSchema | None = None, columns: list[str] | None = None):
        super().__init__(schema)
        self.paths, self.columns = paths, columns

    def load(self, spark: SparkSession) -> DataFrame:
        names = self.columns or ([f.name for f in self.schema.features] if self.schema else None)
        return tables.read_parquet(spark, self.paths, names)

    def _narrowed(self, keep):
        return Parquet(self.paths, self._narrow_schema(keep))


class RawRecords(TabularSource):
    """Undecoded records, one column, one tensor."""

    def __init__(self, paths: str | list[str] | Callable[[SparkSession], DataFrame], name: str = "raw_record", column: str = "record"):
        super().__init__(FeatureSchema((feat.Feature(name, "BYTES"),)), {name: Representation("dense", (name,), shape=(1,))})
        self.paths, self.name, self.column = paths, name, column

    def load(self, spark: SparkSession) -> DataFrame:
        raw = self.paths(spark) if callable(self.paths) else records.read_records(spark, self.paths, self.column)
        return raw.select(F.array(self.column).alias(self.name))

    def project(self, names: list[str]) -> "RawRecords":
        if names != [self.name]:
            raise ValueError(f"the one tensor is {self.name}")
        return self


class Decoded(TabularSource):
    """Records and a decoder of one's own; projection keeps the columns and takes fewer tensors."""

    def __init__(self, paths: str | list[str] | Callable[[SparkSession], DataFrame], decoder: examples.RecordDecoder, representations: dict[str, Representation], raw_record: str | None = None, column: str = "record"):
        super().__init__(None, representations, raw_record)
        self.paths, self.decoder, self.column = paths, decoder, column

    def load(self, spark: SparkSession) -> DataFrame:
        raw = self.paths(spark) if callable(self.paths) else records.read_records(spark, self.paths, self.column)
        return examples.decode_with(raw, self.column, self.decoder, self.raw_record)

    def _narrowed(self, keep):
        return Decoded(self.paths, self.decoder, keep, self.raw_record, self.column)


class Custom(TabularSource):
    """Any reader and decoder."""

    def __init__(self, read: Callable[[SparkSession], DataFrame], decode: Callable[[DataFrame], DataFrame], schema: FeatureSchema | None = None):
        super().__init__(schema)
        self.read, self.decode = read, decode

    def load(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).transform(self.decode)

    def _narrowed(self, keep):
        return Custom(self.read, self.decode, self.schema)
