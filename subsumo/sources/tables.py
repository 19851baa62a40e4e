"""The table registry: which tables and columns take part, and under which ids.

A column id keeps the table number in its high bits and the column index in its low
``column_bits`` bits; a table's own id has all column bits set. Candidate order depends
on column-id order, so ids follow the order in which the tables are given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsumo.functions.text import group_key, has_digest, value_text
from subsumo.functions.words import int_array
from subsumo.operators.sampling import round_robin_sample
from subsumo.session import materialize, small_table


@dataclass
class Table:
    """One input table. ``fields`` and ``nulls`` are, over ``df``, the texts of its columns
    and whether they are null, which is cheaper to ask for than the text."""

    name: str
    number: int
    df: DataFrame
    column_names: list[str]
    fields: list[Column]
    nulls: list[Column]
    types: list[T.DataType]
    #: What values are grouped by, where that is already at hand.
    key_columns: list[Column] | None = None

    @property
    def width(self) -> int:
        return len(self.fields)

    def text(self, indices: Sequence[int] | None = None) -> DataFrame:
        """Columns as text, named c<index>. Only the asked-for columns reach the scan."""
        wanted = range(self.width) if indices is None else indices
        return self.df.select(*[self.fields[i].alias(f"c{i}") for i in wanted])

    def tuples(self) -> DataFrame:
        return self.text().select(F.array(*[f"c{i}" for i in range(self.width)]).alias("f"))


@dataclass
class ColumnInfo:
    member: int
    column_id: int
    table_number: int
    index: int
    name: str


@dataclass
class TableSet:
    spark: SparkSession
    tables: list[Table]
    column_bits: int = 16
    digest_long: bool = True
    columns: list[ColumnInfo] = field(init=False)
    #: Of delimited files: (table_id, lines), the lines that have another width than expected.
    width_violations: DataFrame | None = field(init=False, default=None)
    #: Joint copies of tables that n-ary levels read in their place, see :mod:`subsumo.operators.lineup`.
    lineups: list = field(init=False, default_factory=list)

    def __post_init__(self):
        self.columns = []
        for table in self.tables:
            if self.table_id(table.number) >= 1 << 31:
                raise ValueError(f"{table.name} needs an id beyond 31 bits; use fewer column bits or fewer tables")
            if table.width > self.mask:
                raise ValueError(f"{table.name} has {table.width} columns, more than {self.column_bits} bits can number")
            for index, name in enumerate(table.column_names):
                self.columns.append(
                    ColumnInfo(len(self.columns), (table.number << self.column_bits) + index, table.number, index, name)
                )

    @classmethod
    def from_dataframes(
        cls,
        spark: SparkSession,
        frames: Mapping[str, DataFrame],
        column_bits: int = 16,
        max_columns: int = -1,
        sample_percent: int = -1,
        null_string: str | None = None,
        digest_long: bool = True,
        spread: int | None = None,
    ) -> "TableSet":
        """Typed DataFrames; SQL nulls are the nulls, and ``null_string`` names a text that is one too.

        ``spread`` deals the rows of every table to that many tasks first. Only for inputs
        that cannot be split, such as one big compressed file; others are best read as they lie."""
        tables = []
        for number, (name, df) in enumerate(frames.items()):
            if 0 <= max_columns < len(df.columns):
                df = df.select(*[_quoted(c) for c in df.columns[:max_columns]])
            if sample_percent != -1:
                # Every level must see the same rows, so the sample is drawn once.
                df = materialize(round_robin_sample(df, sample_percent))
            if spread:
                df = df.repartition(spread)
            fields, nulls, types = [], [], []
            names = list(df.columns)
            if len(set(map(str.lower, names))) < len(names):
                # Names may repeat, so columns are told apart by their position.
                df = df.toDF(*[f"_{i}" for i in range(len(names))])
            for f in df.schema.fields:
                value = F.col(_quoted(f.name))
                text, null = value_text(value, f.dataType), value.isNull()
                if null_string is not None:
                    text = F.when(text != F.lit(null_string), text)
                    null = text.isNull()
                fields.append(text)
                nulls.append(null)
                types.append(f.dataType)
            tables.append(Table(name, number, df, names, fields, nulls, types))
        return cls(spark, tables, column_bits, digest_long)

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: Mapping[str, str], file_format: str = "parquet", **options):
        """Named files that carry their own schema (Parquet, ORC, ...)."""
        frames = {name: spark.read.format(file_format).load(path) for name, path in paths.items()}
        return cls.from_dataframes(spark, frames, **options)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None, **options) -> "TableSet":
        """All tables of a catalog database, by name."""
        listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
        names = sorted(t.name for t in listed if not t.isTemporary)
        prefix = f"{_quoted(database)}." if database else ""
        return cls.from_dataframes(spark, {n: spark.table(prefix + _quoted(n)) for n in names}, **options)

    def stored(self, distinct: Sequence[str] = ()) -> "TableSet":
        """The same set over Parquet copies in the shared folder, texts with their grouping keys.

        Worth it before an n-ary run over joins, views or delimited files: every level reads
        the tables again, and a copy is neither joined nor parsed again and lets a level
        scan only the columns it needs.

        ``distinct`` names tables whose equal rows are kept once. Values, dependencies and rules stay the
        same; what counts rows, such as nulls of a column, counts distinct ones then."""
        tables = []
        for t in self.tables:
            if not t.width:
                tables.append(t)
                continue
            # Only texts that can be long have a key of their own; the others are their key.
            own = [i for i in range(t.width) if self.digest_long and has_digest(t.types[i])]
            keys = [self._key(t, i).alias(f"k{i}") for i in own]
            once, told = t.name in distinct, all(map(_equal_as_text, t.types))
            # A join that has brought equal rows together already need not do so again.
            df = t.df.distinct() if once and told else t.df
            copied = df.select(*[t.fields[i].alias(f"c{i}") for i in range(t.width)], *keys)
            copy = materialize(copied.distinct() if once and not told else copied)
            columns = [F.col(f"c{i}") for i in range(t.width)]
            grouped = [F.col(f"k{i}") if i in own else columns[i] for i in range(t.width)]
            nulls = [c.isNull() for c in columns]
            types = [T.StringType()] * t.width
            tables.append(replace(t, df=copy, fields=columns, nulls=nulls, types=types, key_columns=grouped))
        out = TableSet(self.spark, tables, self.column_bits, self.digest_long)
        out.width_violations = self.width_violations
        return out

    def _key(self, table: Table, index: int) -> Column:
        if table.key_columns is not None:
            return table.key_columns[index]
        return group_key(table.fields[index], table.types[index], self.digest_long)

    @property
    def mask(self) -> int:
        return (1 << self.column_bits) - 1

    def table_id(self, number: int) -> int:
        return (number << self.column_bits) | self.mask

    def keys(self, table: Table, indices: Sequence[int] | None = None) -> DataFrame:
        """Like :meth:`Table.text`, but long values are replaced by their digest key."""
        wanted = range(table.width) if indices is None else indices
        return table.df.select(*[self._key(table, i).alias(f"c{i}") for i in wanted])

    def column_id_of(self, member: Column) -> Column:
        return F.get(int_array([c.column_id for c in self.columns]), member)

    def table_number_of(self, column_id: Column) -> Column:
        return F.shiftright(column_id, self.column_bits)

    def registry(self) -> DataFrame:
        """(column_id, table_id, table_name, idx, name): one row per column."""
        names = {t.number: t.name for t in self.tables}
        schema = pa.schema(
            [("column_id", pa.int32()), ("table_id", pa.int32()), ("table_name", pa.string()), ("idx", pa.int32()),
             ("name", pa.string())]
        )
        rows = [(c.column_id, self.table_id(c.table_number), names[c.table_number], c.index, c.name) for c in self.columns]
        return small_table(self.spark, rows, schema)

    def column_id(self, table: str, column: str | int) -> int:
        number = next(t.number for t in self.tables if t.name == table)
        return next(c.column_id for c in self.columns if c.table_number == number and column in (c.name, c.index))


def _equal_as_text(data_type: T.DataType) -> bool:
    """Whether values are equal just when their texts are; of doubles, 0.0 and -0.0 are equal."""
    return isinstance(data_type, (T.IntegralType, T.BooleanType, T.DateType)) or data_type == T.StringType()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
