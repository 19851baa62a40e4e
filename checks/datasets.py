"""Table sets that the queries run on: the given tables, whole, or tables that are joined
or projected from them. Every relation exists twice, as a DataFrame and as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from subsumo import TableSet

GIVEN = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


@dataclass(frozen=True)
class Relation:
    """``sql`` is understood by both engines and selects exactly ``columns``."""

    columns: tuple[str, ...]
    sql: str


def given(name: str, columns: list[str] | None = None) -> Relation:
    columns = columns or GIVEN[name]
    return Relation(tuple(columns), f"SELECT {', '.join(columns)} FROM {name}")


def relation(columns: str, tail: str) -> Relation:
    """``columns`` as in a select list; an alias follows AS."""
    names = tuple(c.split(" AS ")[-1].split(".")[-1].strip() for c in columns.split(", "))
    return Relation(names, f"SELECT {columns} {tail}")


ALL_TABLES = {name: given(name) for name in GIVEN}

DOCUMENT_LABELS = relation(
    "d.doc_id, d.lang, d.source, l.quality, l.toxic",
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)

#: Labels that are missing for some documents, and a table in which all of them are missing.
NULLS = {
    "documents": given("documents"),
    "labels": given("labels"),
    "document_labels": DOCUMENT_LABELS,
    "unlabelled": relation(
        "d.doc_id, d.lang, l.quality, l.toxic",
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL",
    ),
    "conversations": given("conversations"),
    "benchmark": given("benchmark"),
}

#: Dimension and fact tables together with their denormalised forms.
STAR = {
    "nation": given("nation"),
    "supplier_nation": relation(
        "s.s_suppkey, s.s_nationkey, n.n_name, n.n_regionkey",
        "FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
    ),
    "orders": given("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "order_lines": relation(
        "l.l_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority",
        "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    ),
}

#: Columns that are never filled together, next to the columns they come from.
ROLES = {
    "turns": relation(
        "conv_id, turn, CASE WHEN role = 'user' THEN text END AS user_text, "
        "CASE WHEN role = 'assistant' THEN text END AS assistant_text",
        "FROM conversations",
    ),
    "messages": relation("conv_id, turn, text, text AS reviewed_text", "FROM conversations"),
}

#: Labels with a table that only holds the documents of one outcome, so that columns are constant.
OUTCOMES = {
    "labels": given("labels"),
    "toxic": relation("doc_id, quality, toxic", "FROM labels WHERE toxic = 1"),
    "document_labels": DOCUMENT_LABELS,
}


_FLAGS = "doc_id, quality, toxic, quality AS quality2, toxic AS toxic2, 1 - quality AS poor, 1 - toxic AS mild"

#: Many columns with the same few values, so that one level has well over a thousand candidates.
FLAGS = {
    "flags": relation(_FLAGS, "FROM labels"),
    "good_flags": relation(_FLAGS, "FROM labels WHERE quality = 1 OR toxic = 1"),
}


#: More columns than 32 words of 63 bits hold. Four neighbours share values, the first of them the fewest.
WIDE_COLUMNS = 2100
WIDE = {
    "wide": Relation(
        tuple(f"c{i}" for i in range(WIDE_COLUMNS)),
        "SELECT " + ", ".join(f"'{i // 4}:' || (doc_id % {i % 4 + 1}) AS c{i}" for i in range(WIDE_COLUMNS)) + " FROM labels",
    )
}


def load(spark: SparkSession, sf_dir: str, relations: dict[str, Relation]) -> dict[str, DataFrame]:
    """The relations as DataFrames. Views are only registered under names used here."""
    for name in GIVEN:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return {name: spark.sql(r.sql) for name, r in relations.items()}


def table_set(spark: SparkSession, sf_dir: str, relations: dict[str, Relation], **options) -> TableSet:
    return TableSet.from_dataframes(spark, load(spark, sf_dir, relations), **options)


def column_ids(relations: dict[str, Relation], column_bits: int = 16) -> list[tuple[int, str, str]]:
    """(column id, table, column) of every column, for the SQL side."""
    return [
        ((number << column_bits) + index, table, column)
        for number, (table, r) in enumerate(relations.items())
        for index, column in enumerate(r.columns)
    ]
