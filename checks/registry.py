"""The registered queries. Every entry has a DataFrame side and, where SQL can say it, a SQL side."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from checks.datasets import ALL_TABLES, FLAGS, NULLS, OUTCOMES, ROLES, STAR, WIDE, WIDE_COLUMNS, column_ids, given, load, table_set
from checks.oracle import Script
from subsumo import (
    Dialect,
    DiscoveryError,
    count_unary_inds,
    csv_tables,
    discover,
    discover_with_rules,
    overlap_histogram,
    partial_unary_inds,
    unary_inds,
    unary_overlaps,
    void_unary_inds,
)
from subsumo.operators import algebra, naming, unary
from subsumo.operators.candidates import apriori_candidates, binder_candidates, combos, restrict_combos, with_chunk, without_void
from subsumo.operators.cells import cell_values, tuples
from subsumo.operators.groups import inclusion_lists
from subsumo.operators.lineup import lined_up
from subsumo.operators.sampling import complete_tuples, key_sample
from subsumo.plans import stats
from subsumo.plans.borders import Border
from subsumo.plans.discovery import as_ind_table, validated
from subsumo.session import materialize, new_folder
from subsumo.sinks import read_collection, read_measurements, save, save_collection, save_measurements
from subsumo.sources.csv import apply_width_policy, file_tables, parse_lines, width_violations
from subsumo.sources.lines import any_charset, scan_lines
from subsumo.sources.tables import TableSet

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: Callable[[], str] | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: Callable[[], str] | None = None):
    def register(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return register


# --- shapes of results --------------------------------------------------------------


def ids(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat_ws(",", F.transform(column, lambda c: c.cast("string")))


def flat(inds: DataFrame) -> DataFrame:
    return inds.select(F.size("dep").alias("arity"), ids("dep").alias("dep"), ids("ref").alias("ref"))


def flat_rules(rules: DataFrame) -> DataFrame:
    return rules.select(
        ids("lhs_dep").alias("lhs_dep"), ids("lhs_ref").alias("lhs_ref"),
        F.get("rhs_dep", F.lit(0)).alias("rhs_dep"), F.get("rhs_ref", F.lit(0)).alias("rhs_ref"),
    )


def star(spark: SparkSession, sf: str) -> TableSet:
    """The joined tables are written once, since every level reads them, and without the lines' repeated rows."""
    return table_set(spark, sf, STAR).stored(distinct=["order_lines"])


# --- unary --------------------------------------------------------------------------


@query("unary_inds", lambda: Script(ALL_TABLES).unary().select("SELECT dep, ref, n AS size FROM unary_inds"))
def _(spark, sf):
    return unary_inds(table_set(spark, sf, ALL_TABLES))


@query("unary_inds_with_void", lambda: Script(NULLS).unary().select("SELECT dep, ref, n AS size FROM unary_inds"))
def _(spark, sf):
    return unary_inds(table_set(spark, sf, NULLS))


@query(
    "unary_inds_keep_nulls",
    lambda: Script(NULLS, drop_nulls=False).unary().select("SELECT dep, ref, n AS size FROM unary_inds"),
)
def _(spark, sf):
    return unary_inds(table_set(spark, sf, NULLS), drop_nulls=False)


@query("void_inds", lambda: Script(NULLS).unary().select("SELECT dep, ref, n AS size FROM void"))
def _(spark, sf):
    return void_unary_inds(table_set(spark, sf, NULLS))


@query("unary_ind_count", lambda: Script(NULLS).unary().select("SELECT count(*) AS n FROM proper"))
def _(spark, sf):
    return count_unary_inds(table_set(spark, sf, NULLS))


@query(
    "unary_overlaps",
    lambda: Script(ALL_TABLES).unary().select("SELECT dep, ref, n AS size, o AS overlap FROM shared JOIN sizes ON dep = cid"),
)
def _(spark, sf):
    return unary_overlaps(table_set(spark, sf, ALL_TABLES))


def _partial_sql(script: Script, least: float) -> str:
    return script.unary().select(
        "SELECT dep, ref, n AS dep_size, CAST(o AS DOUBLE) / n AS overlap FROM shared JOIN sizes ON dep = cid "
        f"WHERE CAST(o AS DOUBLE) / n >= {least}"
    )


@query("partial_inds_90", lambda: _partial_sql(Script(ALL_TABLES), 0.9))
def _(spark, sf):
    return partial_unary_inds(table_set(spark, sf, ALL_TABLES))


@query("partial_inds_any_overlap", lambda: _partial_sql(Script(NULLS, drop_nulls=False), 0))
def _(spark, sf):
    return partial_unary_inds(table_set(spark, sf, NULLS), 0.0, drop_nulls=False)


@query("partial_inds_max_error", lambda: _partial_sql(Script(NULLS), 0.75))
def _(spark, sf):
    return partial_unary_inds(table_set(spark, sf, NULLS), max_error=0.25)


def _histogram_sql() -> str:
    n = len(column_ids(ALL_TABLES))
    bounds = [(None, 0.1), (0.1, 0.9), (0.9, 0.99), (0.99, 1), (1, None)]
    parts = []
    for label, (low, high) in zip(unary.OVERLAP_BUCKETS[1:], bounds):
        tests = ([f"r >= {low}"] if low is not None else []) + ([f"r < {high}"] if high is not None else [])
        parts.append(f"SELECT '{label}' AS bucket, count(*) AS n FROM ratios WHERE {' AND '.join(tests)}")
    parts.append(f"SELECT '{unary.OVERLAP_BUCKETS[0]}' AS bucket, {n * (n - 1)} - count(*) AS n FROM ratios")
    script = Script(ALL_TABLES).unary()
    script.step("ratios", "SELECT CAST(o AS DOUBLE) / n AS r FROM shared JOIN sizes ON dep = cid")
    return script.select(" UNION ALL ".join(parts))


@query("overlap_histogram", _histogram_sql)
def _(spark, sf):
    return overlap_histogram(table_set(spark, sf, ALL_TABLES))


def _groups(script: Script) -> Script:
    script.unary()
    script.step("by_value", "SELECT string_agg(CAST(cid AS VARCHAR), ',' ORDER BY cid) AS g, v FROM cells GROUP BY v")
    return script.step("grouped", "SELECT g, count(*) AS n FROM by_value GROUP BY g")


@query("attribute_groups", lambda: _groups(Script(ALL_TABLES)).select("SELECT g AS columns, n FROM grouped"))
def _(spark, sf):
    return unary.attribute_group_lists(table_set(spark, sf, ALL_TABLES)).select(ids("columns").alias("columns"), "n")


@query(
    "inclusion_lists",
    lambda: _groups(Script(NULLS))
    .step("ones", "SELECT DISTINCT cid AS dep, g, n FROM cells JOIN by_value USING (v) JOIN grouped USING (g)")
    .step("others", "SELECT dep, g, n, unnest(string_split(g, ',')) AS ref FROM ones")
    .select(
        "SELECT dep, coalesce(string_agg(ref, ',' ORDER BY CAST(ref AS INTEGER)) FILTER (WHERE CAST(ref AS INTEGER) <> dep), '')"
        " AS refs, n FROM others GROUP BY dep, g, n"
    ),
)
def _(spark, sf):
    tables = table_set(spark, sf, NULLS)
    lists = inclusion_lists(unary.column_groups(tables))
    return lists.select(
        tables.column_id_of(F.col("dep")).alias("dep"),
        ids(F.transform("refs", tables.column_id_of)).alias("refs"),
        "n",
    )


_WIDE_INDS = f"""
WITH cells AS (
  SELECT DISTINCT CAST(i AS INTEGER) AS cid, (i // 4) || ':' || (doc_id % (i % 4 + 1)) AS v FROM labels, range({WIDE_COLUMNS}) AS r(i)),
sizes AS (SELECT cid, count(*) AS n FROM cells GROUP BY cid),
shared AS (SELECT a.cid AS dep, b.cid AS ref, count(*) AS o FROM cells a JOIN cells b ON a.v = b.v AND a.cid <> b.cid GROUP BY ALL)
SELECT dep, ref, n AS size FROM shared JOIN sizes ON dep = cid WHERE o = n"""


@query("wide_unary_inds", lambda: _WIDE_INDS)
def _(spark, sf):
    """Over two thousand columns: more words than are kept as columns of one row."""
    return unary_inds(table_set(spark, sf, WIDE), include_void=False)


# --- statistics ---------------------------------------------------------------------


def _heights(relations) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST({len(r.columns)} AS BIGINT) AS width, count(*) AS height FROM t_{name}"
        for name, r in relations.items()
    )


@query("table_stats", lambda: Script(NULLS).select(_heights(NULLS)))
def _(spark, sf):
    return stats.table_stats(table_set(spark, sf, NULLS))


@query(
    "dataset_stats",
    lambda: Script(ALL_TABLES)
    .step("h", _heights(ALL_TABLES))
    .select("SELECT CAST(sum(width) AS BIGINT) AS columns, CAST(sum(height) AS BIGINT) AS tuples FROM h"),
)
def _(spark, sf):
    return stats.dataset_stats(table_set(spark, sf, ALL_TABLES))


def _column_stats_sql(relations, drop_nulls: bool) -> str:
    script = Script(relations, drop_nulls).unary()
    script.nulls(1)
    return script.select(
        "SELECT tab AS table_name, col AS name, c.cid AS column_id, coalesce(s.n, 0) AS size, x.n AS nulls "
        "FROM cols c LEFT JOIN sizes s ON c.cid = s.cid JOIN nulls1 x ON x.c1 = c.cid"
    )


@query("column_stats", lambda: _column_stats_sql(NULLS, True))
def _(spark, sf):
    return stats.column_stats(table_set(spark, sf, NULLS))


@query("column_stats_keep_nulls", lambda: _column_stats_sql(NULLS, False))
def _(spark, sf):
    return stats.column_stats(table_set(spark, sf, NULLS), drop_nulls=False)


@query("cell_counts", lambda: Script(ALL_TABLES).unary().select("SELECT cid AS column_id, count(*) AS n FROM all_cells WHERE v IS NOT NULL GROUP BY cid"))
def _(spark, sf):
    return cell_values(table_set(spark, sf, ALL_TABLES)).groupBy("column_id").agg(F.count(F.lit(1)).alias("n"))


# --- n-ary --------------------------------------------------------------------------


@query("nary_inds", lambda: Script(STAR).levels(4).select(Script(STAR).all_inds(4)))
def _(spark, sf):
    return flat(discover(star(spark, sf)).inds())


@query("nary_inds_maximal", lambda: Script(STAR).levels(4).select(Script(STAR).maximal(4)))
def _(spark, sf):
    return flat(discover(star(spark, sf)).maximal())


@query("nary_inds_chunked", lambda: Script(STAR).levels(3).select(Script(STAR).all_inds(3)))
def _(spark, sf):
    return flat(discover(star(spark, sf), max_arity=3, chunk_size=12).inds())


@query("nary_inds_binder", lambda: Script(STAR).levels(3, generator="binder").select(Script(STAR).all_inds(3)))
def _(spark, sf):
    return flat(discover(star(spark, sf), max_arity=3, generator="binder").maximal())


@query("nary_inds_with_nulls", lambda: Script(OUTCOMES).levels(3).select(Script(OUTCOMES).all_inds(3)))
def _(spark, sf):
    return flat(discover(table_set(spark, sf, OUTCOMES), max_arity=3).inds())


@query(
    "nary_inds_keep_nulls",
    lambda: Script(OUTCOMES, drop_nulls=False).levels(3).select(Script(OUTCOMES).all_inds(3)),
)
def _(spark, sf):
    return flat(discover(table_set(spark, sf, OUTCOMES), max_arity=3, drop_nulls=False).inds())


@query("nary_void_inds", lambda: Script(ROLES).levels(3).select(Script(ROLES).all_inds(3)))
def _(spark, sf):
    return flat(discover(table_set(spark, sf, ROLES), max_arity=3).inds())


@query(
    "nary_inds_no_void_generation",
    lambda: Script(NULLS).levels(2, without_void=True).select(
        "SELECT 1 AS arity, CAST(dep AS VARCHAR) AS dep, CAST(ref AS VARCHAR) AS ref FROM unary_inds UNION ALL "
        + Script(NULLS).all_inds(2, 2)
    ),
)
def _(spark, sf):
    return flat(discover(table_set(spark, sf, NULLS), max_arity=2, generator="apriori-no-void").inds())


def _restricted(name: str) -> None:
    label = name.lower()

    @query(f"nary_inds_{label}", lambda: Script(OUTCOMES).levels(3, name).select(Script(OUTCOMES).all_inds(3, 2)))
    def _(spark, sf):
        found = discover(table_set(spark, sf, OUTCOMES), max_arity=3, restrictions=name).inds()
        return flat(found.where(F.size("dep") > 1))


for _name in algebra.RESTRICTIONS:
    _restricted(_name)


@query(
    "run_stats",
    lambda: Script(STAR)
    .levels(4)
    .select(
        f"SELECT 1 AS arity, CAST({len(column_ids(STAR)) * (len(column_ids(STAR)) - 1)} AS BIGINT) AS candidates, "
        "(SELECT count(*) FROM ind1) AS inds UNION ALL "
        + " UNION ALL ".join(
            f"SELECT {n} AS arity, (SELECT count(*) FROM cand{n}) AS candidates, (SELECT count(*) FROM ind{n}) AS inds"
            for n in (2, 3, 4)
        )
    ),
)
def _(spark, sf):
    return discover(star(spark, sf)).run_stats().select("arity", "candidates", "inds")


def _validated_sql() -> str:
    script = Script(STAR).levels(2)
    return script.select(
        f"SELECT {', '.join(['concat_ws(chr(44), d1, d2) AS dep', 'concat_ws(chr(44), r1, r2) AS ref'])}, n AS size, o = n AS holds "
        "FROM ind2_checked"
    )


@query("validated_candidates", _validated_sql)
def _(spark, sf):
    tables = star(spark, sf)
    level = as_ind_table(unary_inds(tables))
    checked, _ = validated(tables, apriori_candidates(level, None, 2))
    return checked.select(ids("dep").alias("dep"), ids("ref").alias("ref"), "size", "holds")


# --- rules --------------------------------------------------------------------------


@query("rule_inds", lambda: Script(STAR).rules(4).select(Script(STAR).maximal(4, "kept")))
def _(spark, sf):
    return flat(discover_with_rules(star(spark, sf)).maximal())


@query("augmentation_rules", lambda: Script(STAR).rules(4).select(Script(STAR).all_rules(4)))
def _(spark, sf):
    return flat_rules(discover_with_rules(star(spark, sf)).rules())


@query("augmentation_rules_with_nulls", lambda: Script(OUTCOMES).rules(3).select(Script(OUTCOMES).all_rules(3)))
def _(spark, sf):
    return flat_rules(discover_with_rules(table_set(spark, sf, OUTCOMES), max_arity=3).rules())


@query("zero_ary_rules", lambda: Script(NULLS).rules(1).select(Script(NULLS).all_rules(1)))
def _(spark, sf):
    return flat_rules(discover_with_rules(table_set(spark, sf, NULLS), max_arity=1).rules())


@query("void_rules", lambda: Script(ROLES).rules(2).select(Script(ROLES).all_rules(2)))
def _(spark, sf):
    return flat_rules(discover_with_rules(table_set(spark, sf, ROLES), max_arity=2).rules())


@query(
    "rendered_rules",
    lambda: Script(NULLS)
    .rules(1)
    .step("named", "SELECT cid, tab || '[' || (cid % 65536) || ']' AS t FROM cols")
    .select(
        "SELECT '〈[] ⊆ []〉 ⇉ 〈' || a.t || ' ⊆ ' || b.t || '〉' AS text FROM rule1 "
        "JOIN named a ON a.cid = rhs_dep JOIN named b ON b.cid = rhs_ref"
    ),
)
def _(spark, sf):
    tables = table_set(spark, sf, NULLS)
    rules = discover_with_rules(tables, max_arity=1).rules()
    return rules.select(naming.rendered_rule(tables).alias("text"))


# --- candidates ---------------------------------------------------------------------


def _candidate_query(name: str) -> None:
    label = name.lower()

    @query(
        f"apriori_candidates_{label}",
        lambda: _candidates_only(name, OUTCOMES).select(
            "SELECT 2 AS arity, concat_ws(',', d1, d2) AS dep, concat_ws(',', r1, r2) AS ref FROM cand2 UNION ALL "
            "SELECT 3 AS arity, concat_ws(',', d1, d2, d3) AS dep, concat_ws(',', r1, r2, r3) AS ref FROM cand3"
        ),
    )
    def _(spark, sf):
        """Candidates of arity 3 as if all candidates of arity 2 had been valid."""
        level = as_ind_table(unary_inds(table_set(spark, sf, OUTCOMES)))
        two = apriori_candidates(level, level, 2, name)
        three = apriori_candidates(two, level, 3, name)
        return flat(two.unionByName(three))


def _candidates_only(name: str, relations=STAR) -> Script:
    script = Script(relations).unary()
    script.step("ind1", "SELECT dep AS d1, ref AS r1, n FROM unary_inds")
    script.candidates(2, "ind1", name, "cand2")
    script.candidates(3, "cand2", name, "cand3")
    return script


for _name in algebra.RESTRICTIONS:
    _candidate_query(_name)


def _binder_sql() -> str:
    script = Script(NULLS).unary()
    script.step("ind1", "SELECT dep AS d1, ref AS r1, n FROM unary_inds WHERE n > 0")
    script.candidates(2, "ind1", "NO_REPETITIONS", "cand2", "binder")
    return script.select("SELECT 2 AS arity, concat_ws(',', d1, d2) AS dep, concat_ws(',', r1, r2) AS ref FROM cand2")


@query("binder_candidates", _binder_sql)
def _(spark, sf):
    level = without_void(as_ind_table(unary_inds(table_set(spark, sf, NULLS))))
    return flat(binder_candidates(level, level, 2))


@query(
    "combos",
    lambda: _candidates_only("NO_REPETITIONS")
    .step("sides", "SELECT DISTINCT d1 AS a, d2 AS b FROM cand2 UNION SELECT DISTINCT r1 AS a, r2 AS b FROM cand2")
    .select("SELECT a >> 16 AS tab, concat_ws(',', a, b) AS cols FROM sides"),
)
def _(spark, sf):
    level = as_ind_table(unary_inds(star(spark, sf)))
    return combos(apriori_candidates(level, None, 2)).select(F.col("table").alias("tab"), ids("cols").alias("cols"))


@query(
    "candidate_chunks",
    lambda: _candidates_only("NO_REPETITIONS")
    .step("total", "SELECT count(*) AS t FROM cand2")
    .step("numbers", "SELECT unnest(range(0, (SELECT t // 10 + 1 FROM total))) AS chunk")
    .select("SELECT CAST(chunk AS BIGINT) AS chunk, least(10, t - chunk * 10) AS n FROM numbers, total WHERE chunk * 10 < t"),
)
def _(spark, sf):
    level = as_ind_table(unary_inds(star(spark, sf)))
    return with_chunk(apriori_candidates(level, None, 2), 10).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query(
    "restricted_combos",
    lambda: _candidates_only("NO_REPETITIONS")
    .step("few", "SELECT * FROM cand2 WHERE d1 >> 16 = 1")
    .step("sides", "SELECT DISTINCT d1 AS a, d2 AS b FROM few UNION SELECT DISTINCT r1 AS a, r2 AS b FROM few")
    .select("SELECT a >> 16 AS tab, concat_ws(',', a, b) AS cols FROM sides"),
)
def _(spark, sf):
    """Of all combos those that the candidates of one table need."""
    candidates = materialize(apriori_candidates(as_ind_table(unary_inds(star(spark, sf))), None, 2))
    few = candidates.where(F.shiftright(F.element_at("dep", 1), 16) == 1)
    return restrict_combos(combos(candidates), few).select(F.col("table").alias("tab"), ids("cols").alias("cols"))


@query(
    "combo_numbers",
    lambda: _candidates_only("NO_REPETITIONS")
    .step("sides", "SELECT DISTINCT d1 AS a, d2 AS b FROM cand2 UNION SELECT DISTINCT r1 AS a, r2 AS b FROM cand2")
    .select("SELECT row_number() OVER () - 1 AS combo_id FROM sides"),
)
def _(spark, sf):
    """Ids are dense."""
    level = as_ind_table(unary_inds(star(spark, sf)))
    return combos(apriori_candidates(level, None, 2)).select(F.col("combo_id").cast("bigint").alias("combo_id"))


@query(
    "validated_flags",
    lambda: Script(FLAGS).levels(2).select(
        "SELECT concat_ws(',', d1, d2) AS dep, concat_ws(',', r1, r2) AS ref, n AS size, o = n AS holds FROM ind2_checked"
    ),
)
def _(spark, sf):
    """Well over a thousand candidates of one level, in one scan."""
    tables = table_set(spark, sf, FLAGS)
    checked, _ = validated(tables, apriori_candidates(as_ind_table(unary_inds(tables)), None, 2))
    return checked.select(ids("dep").alias("dep"), ids("ref").alias("ref"), "size", "holds")


@query(
    "flags_run_stats",
    lambda: Script(FLAGS).levels(2).select(
        f"SELECT 1 AS arity, CAST({len(column_ids(FLAGS)) * (len(column_ids(FLAGS)) - 1)} AS BIGINT) AS candidates, "
        "(SELECT count(*) FROM ind1) AS inds, 0 AS scans UNION ALL "
        "SELECT 2 AS arity, (SELECT count(*) FROM cand2) AS candidates, (SELECT count(*) FROM ind2) AS inds, 2 AS scans"
    ),
)
def _(spark, sf):
    return discover(table_set(spark, sf, FLAGS), max_arity=2, refute=True).run_stats().select("arity", "candidates", "inds", "scans")


@query("partial_levels", lambda: Script(OUTCOMES).levels(2).select(Script(OUTCOMES).all_inds(2)))
def _(spark, sf):
    """What a run had found before a level failed."""

    def failing(last, unary, arity, restrictions, column_bits):
        if arity == 3:
            raise RuntimeError("no third level")
        return apriori_candidates(last, unary, arity, restrictions, column_bits)

    try:
        discover(table_set(spark, sf, OUTCOMES), generator=failing)
    except DiscoveryError as error:
        return flat(error.partial.inds())
    raise AssertionError("the run did not fail")


@query(
    "saved_inds",
    lambda: Script(NULLS).unary().select("SELECT dep, ref, n AS size, 'unary' AS algorithm, 'nulls' AS dataset FROM unary_inds"),
)
def _(spark, sf):
    """Results read back from where they were saved."""
    folder = new_folder(spark, "saved")
    run = save(unary_inds(table_set(spark, sf, NULLS)), path=folder, algorithm="unary", dataset="nulls")
    return spark.read.parquet(folder).where(F.col("run_id") == run).select("dep", "ref", "size", "algorithm", "dataset")


@query(
    "saved_measurements",
    lambda: Script(OUTCOMES)
    .levels(3)
    .select(
        f"SELECT 0 AS arity, 'run' AS phase, 'columns' AS measure, CAST({len(column_ids(OUTCOMES))} AS DOUBLE) AS value UNION ALL "
        f"SELECT 1, 'generation', 'candidates', {len(column_ids(OUTCOMES)) * (len(column_ids(OUTCOMES)) - 1)} UNION ALL "
        + " UNION ALL ".join(f"SELECT {n}, 'generation', 'candidates', count(*) FROM cand{n}" for n in (2, 3))
        + "".join(f" UNION ALL SELECT {n}, 'level', 'inds', count(*) FROM ind{n}" for n in (1, 2, 3))
    ),
)
def _(spark, sf):
    """Figures of one of two kept runs, saved twice and read back."""
    folder = new_folder(spark, "measurements")
    other, own = (discover(table_set(spark, sf, OUTCOMES), max_arity=n) for n in (1, 3))
    save_measurements(other.measurements(), folder, dataset="outcomes")
    run = save_measurements(other.measurements(), folder, dataset="outcomes")
    save_measurements(own.measurements(), folder, run, dataset="outcomes")
    kept = F.concat_ws(" ", "phase", "measure").isin("run columns", "generation candidates", "level inds")
    return read_measurements(spark, folder, run).where(kept).select("arity", "phase", "measure", "value")


@query(
    "saved_collections",
    lambda: Script(NULLS).unary().select(
        "SELECT d.tab || '.' || d.col AS dep, r.tab || '.' || r.col AS ref, n AS size, 'unary' AS algorithm, 'nulls' AS dataset "
        "FROM unary_inds JOIN cols d ON d.cid = dep JOIN cols r ON r.cid = ref"
    ),
)
def _(spark, sf):
    """A collection that was saved twice has its last results, by the names saved with them."""
    folder = new_folder(spark, "collections")
    first, last = (table_set(spark, sf, relations) for relations in (OUTCOMES, NULLS))
    save_collection(unary_inds(first), folder, "inds", first, "unary", "outcomes")
    save_collection(unary_inds(first), folder, "other", first, "unary", "outcomes")
    save_collection(unary_inds(last), folder, "inds", last, "unary", "nulls")
    inds, columns, run = read_collection(spark, folder, "inds")
    named = columns.select("column_id", F.concat_ws(".", "table_name", "name").alias("name"))
    dep, ref = (named.select(F.col("column_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")) for side in ("dep", "ref"))
    joined = inds.join(dep, F.col("dep") == F.col("dep_id")).join(ref, F.col("ref") == F.col("ref_id"))
    found = run.first()
    stamps = [F.lit(found[c]).alias(c) for c in ("algorithm", "dataset")]
    return joined.select(F.col("dep_name").alias("dep"), F.col("ref_name").alias("ref"), "size", *stamps)


# --- algebra ------------------------------------------------------------------------


def _star_inds(spark, sf) -> DataFrame:
    return discover(star(spark, sf)).inds()


def _star(select: Callable[[Script], str]) -> Callable[[], str]:
    return lambda: select(Script(STAR).levels(4))


@query(
    "coprojections",
    _star(
        lambda s: s.select(
            " UNION ALL ".join(
                f"SELECT {_pick('d', range(3))} AS dep, {_pick('r', range(3))} AS ref, {drop} AS position, "
                f"{_pick('d', [i for i in range(3) if i != drop])} AS c_dep, "
                f"{_pick('r', [i for i in range(3) if i != drop])} AS c_ref FROM ind3"
                for drop in range(3)
            )
        )
    ),
)
def _(spark, sf):
    spread = algebra.coprojections(algebra.of_arity(_star_inds(spark, sf), 3))
    return spread.select(*[ids(c).alias(c) for c in ("dep", "ref", "c_dep", "c_ref")], "position")


def _pick(prefix: str, positions) -> str:
    return "concat_ws(',', " + ", ".join(f"{prefix}{i + 1}" for i in positions) + ")"


@query(
    "projections",
    _star(
        lambda s: s.select(
            " UNION ALL ".join(
                f"SELECT {_pick('d', range(2))} AS dep, {_pick('r', range(2))} AS ref, {i} AS position, "
                f"{_pick('d', [i])} AS p_dep, {_pick('r', [i])} AS p_ref FROM ind2"
                for i in range(2)
            )
        )
    ),
)
def _(spark, sf):
    spread = algebra.projections(algebra.of_arity(_star_inds(spark, sf), 2))
    return spread.select(*[ids(c).alias(c) for c in ("dep", "ref", "p_dep", "p_ref")], "position")


def _implied_sql(s: Script) -> str:
    parts = []
    for n in (2, 3, 4):
        for i in range(n):
            for j in range(i + 1, n):
                parts.append(f"SELECT {_pick('d', [i, j])} AS dep, {_pick('r', [i, j])} AS ref FROM ind{n}")
    return s.select(" UNION ".join(parts))


@query("implied_inds", _star(_implied_sql))
def _(spark, sf):
    return algebra.implied(_star_inds(spark, sf), 2).select(ids("dep").alias("dep"), ids("ref").alias("ref"))


@query("positive_border", _star(lambda s: s.select(s.maximal(4))))
def _(spark, sf):
    return flat(algebra.positive_border(_star_inds(spark, sf)))


@query("kept_positive_border", _star(lambda s: s.select(s.maximal(4))))
def _(spark, sf):
    """A border that every finished level is taken into."""
    border = Border(spark)
    discover(star(spark, sf), on_level=border.on_level)
    return flat(border.df)


def _failed_sql(s: Script) -> str:
    """Failing candidates of arity 2, and of arity 3 as if all of arity 2 had held, minimal ones."""
    s.candidates(3, "cand2", "NO_REPETITIONS", "more3")
    s.validate(3, "more3", "every3")
    s.step("bad2", "SELECT d1, d2, r1, r2 FROM ind2_checked WHERE o <> n")
    s.step("bad3", "SELECT d1, d2, d3, r1, r2, r3 FROM every3_checked WHERE o <> n")
    inner = " OR ".join(
        f"(b.d1 = c.d{i} AND b.r1 = c.r{i} AND b.d2 = c.d{j} AND b.r2 = c.r{j})" for i, j in ((1, 2), (1, 3), (2, 3))
    )
    return s.select(
        f"SELECT 2 AS arity, {_pick('d', range(2))} AS dep, {_pick('r', range(2))} AS ref FROM bad2 UNION ALL "
        f"SELECT 3 AS arity, {_pick('c.d', range(3))} AS dep, {_pick('c.r', range(3))} AS ref FROM bad3 c "
        f"WHERE NOT EXISTS (SELECT 1 FROM bad2 b WHERE {inner})"
    )


def _failed(spark, sf) -> list[DataFrame]:
    tables = star(spark, sf)
    level = materialize(as_ind_table(unary_inds(tables)))
    two = materialize(apriori_candidates(level, None, 2).select("dep", "ref"))
    tables = lined_up(tables, two)
    return [
        validated(tables, candidates)[0].where(~F.col("holds")).select("dep", "ref")
        for candidates in (two, apriori_candidates(two, None, 3))
    ]


@query("negative_border", _star(_failed_sql))
def _(spark, sf):
    two, three = _failed(spark, sf)
    return flat(algebra.negative_border(two.unionByName(three)))


@query("kept_negative_border", _star(_failed_sql))
def _(spark, sf):
    """The bigger ones come first, so that most of them leave the border again."""
    two, three = _failed(spark, sf)
    return flat(Border(spark, "negative").add(three).add(two).df)


@query(
    "consolidated_inds",
    _star(lambda s: s.select(" UNION ALL ".join(p for p in s.maximal(3).split(" UNION ALL ") if p.startswith("SELECT 2 "))
    )),
)
def _(spark, sf):
    found = _star_inds(spark, sf)
    return flat(algebra.consolidate(algebra.of_arity(found, 2), algebra.of_arity(found, 3)))


def _set_tests_sql(s: Script) -> str:
    return s.select(
        f"SELECT {_pick('d', range(2))} AS dep, {_pick('r', range(2))} AS ref, FALSE AS trivial, "
        "(d1 <> d2 AND r1 <> r2) AS sides_distinct, "
        "(d1 <> d2 AND r1 <> r2 AND d1 <> r1 AND d1 <> r2 AND d2 <> r1 AND d2 <> r2) AS all_distinct, "
        "(d1 <> d2 AND r1 <> r2 AND d1 <> r2 AND d2 <> r1) AS no_repetitions, "
        "(d1 <> d2 AND r1 <> r2) AS no_intra_repetitions, (d1 <> r2 AND d2 <> r1) AS no_inter_repetitions FROM ind2"
    )


@query("ind_set_tests", lambda: _set_tests_sql(Script(STAR).levels(2, "ANY_REPETITION")))
def _(spark, sf):
    found = discover(star(spark, sf), max_arity=2, restrictions="ANY_REPETITION").inds()
    return algebra.of_arity(found, 2).select(
        ids("dep").alias("dep"),
        ids("ref").alias("ref"),
        algebra.is_trivial().alias("trivial"),
        algebra.is_non_repeating().alias("sides_distinct"),
        algebra.is_non_repeating(each_side=False).alias("all_distinct"),
        algebra.satisfies("NO_REPETITIONS").alias("no_repetitions"),
        algebra.satisfies("NO_INTRA_REPETITIONS").alias("no_intra_repetitions"),
        algebra.satisfies("NO_INTER_REPETITIONS").alias("no_inter_repetitions"),
    )


def _relations_sql(s: Script) -> str:
    shared = " + ".join(f"CASE WHEN u.d1 = b.d{i} AND u.r1 = b.r{i} THEN 1 ELSE 0 END" for i in (1, 2))
    return s.select(
        f"SELECT u.d1 AS u_dep, u.r1 AS u_ref, {_pick('b.d', range(2))} AS dep, {_pick('b.r', range(2))} AS ref, "
        f"({shared}) = 1 AS implied, ({shared}) = 1 AS specialized, ({shared}) = 0 AS disjoint "
        "FROM ind1 u JOIN ind2 b ON u.d1 = b.d1"
    )


@query("ind_relations", _star(_relations_sql))
def _(spark, sf):
    found = discover(star(spark, sf), max_arity=2).inds()
    one = algebra.of_arity(found, 1).select(F.col("dep").alias("ud"), F.col("ref").alias("ur"))
    two = algebra.of_arity(found, 2)
    small, big = (F.col("ud"), F.col("ur")), (F.col("dep"), F.col("ref"))
    return one.join(two, F.get("ud", F.lit(0)) == F.get("dep", F.lit(0))).select(
        F.get("ud", F.lit(0)).alias("u_dep"), F.get("ur", F.lit(0)).alias("u_ref"),
        ids("dep").alias("dep"), ids("ref").alias("ref"),
        algebra.is_implied_by(*small, *big).alias("implied"),
        algebra.is_specializing(*big, *small).alias("specialized"),
        algebra.is_disjoint(*small, *big).alias("disjoint"),
    )


@query(
    "canonical_inds",
    _star(
        lambda s: s.select(
            "SELECT concat_ws(',', least(r1, r2), greatest(r1, r2)) AS dep, CASE WHEN r1 < r2 THEN concat_ws(',', d1, d2) "
            "ELSE concat_ws(',', d2, d1) END AS ref FROM ind2"
        )
    ),
)
def _(spark, sf):
    """Binary dependencies read from right to left, brought back into canonical order."""
    two = algebra.of_arity(_star_inds(spark, sf), 2)
    turned = two.select(F.col("ref").alias("dep"), F.col("dep").alias("ref"))
    return algebra.canonical(turned).select(ids("dep").alias("dep"), ids("ref").alias("ref"))


@query(
    "subspaces",
    _star(
        lambda s: s.select(
            " UNION ALL ".join(
                f"SELECT d1 >> 16 AS dep_table, r1 >> 16 AS ref_table, {n} AS arity, count(*) AS n FROM ind{n} GROUP BY ALL"
                for n in (1, 2, 3, 4)
            )
        )
    ),
)
def _(spark, sf):
    return algebra.by_subspace(_star_inds(spark, sf))


@query(
    "inds_by_dependent",
    _star(
        lambda s: s.select(
            f"SELECT dep, string_agg(ref, ' ' ORDER BY r1, r2) AS refs FROM (SELECT {_pick('d', range(2))} AS dep, "
            f"{_pick('r', range(2))} AS ref, r1, r2 FROM ind2) GROUP BY dep"
        )
    ),
)
def _(spark, sf):
    grouped = algebra.by_dependent(_star_inds(spark, sf), 2)
    return grouped.select(ids("dep").alias("dep"), F.array_join(F.transform("refs", ids), " ").alias("refs"))


def _order_sql(order: str) -> str:
    script = Script(STAR).levels(4)
    lists = lambda side, n: "[" + ", ".join(f"{side}{i}" for i in range(1, n + 1)) + "]"
    script.step("listed", " UNION ALL ".join(f"SELECT {n} AS arity, {lists('d', n)} AS d, {lists('r', n)} AS r FROM ind{n}" for n in (1, 2, 3, 4)))
    return script.select(
        f"SELECT row_number() OVER (ORDER BY {order}) AS position, array_to_string(d, ',') AS dep, array_to_string(r, ',') AS ref FROM listed"
    )


def _positions(ordered: DataFrame) -> DataFrame:
    """Rows with their place in the order they come in; sorted parts follow one another."""
    placed = ordered.withColumn("at", F.monotonically_increasing_id())
    position = F.row_number().over(Window.orderBy("at")).cast("bigint")
    return placed.select(position.alias("position"), ids("dep").alias("dep"), ids("ref").alias("ref"))


@query("inds_by_arity", lambda: _order_sql("arity, d, r"))
def _(spark, sf):
    return _positions(algebra.by_arity(_star_inds(spark, sf)))


@query("inds_lexicographic", lambda: _order_sql("d, r"))
def _(spark, sf):
    return _positions(algebra.lexicographic(_star_inds(spark, sf)))


# --- catalog ------------------------------------------------------------------------

#: Tables of a database by name. Partition columns come last.
_CATALOG = {
    "conversations": given("conversations", ["conv_id", "turn", "text", "role"]),
    "documents": given("documents"),
    "labels": given("labels"),
}


@query("catalog_unary_inds", lambda: Script(_CATALOG).unary().select("SELECT dep, ref, n AS size FROM unary_inds"))
def _(spark, sf):
    """A database with a partitioned, a plain and a bucketed table."""
    database = "subsumo_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {database} LOCATION '{new_folder(spark, 'database')}'")
    tables = load(spark, sf, _CATALOG)
    tables["conversations"].write.partitionBy("role").saveAsTable(f"{database}.conversations")
    tables["documents"].write.saveAsTable(f"{database}.documents")
    tables["labels"].write.bucketBy(4, "doc_id").sortBy("doc_id").saveAsTable(f"{database}.labels")
    return unary_inds(TableSet.from_catalog(spark, database))


# --- names --------------------------------------------------------------------------


def _names_sql(pattern: str) -> str:
    script = Script(STAR).levels(2)
    script.step("named", f"SELECT cid, {pattern} AS t, tab FROM cols")
    return script


@query(
    "named_inds",
    lambda: _names_sql("tab || '.' || col").select(
        "SELECT '[' || a.t || ', ' || b.t || '] ⊆ [' || c.t || ', ' || d.t || ']' AS text FROM ind2 "
        "JOIN named a ON a.cid = d1 JOIN named b ON b.cid = d2 JOIN named c ON c.cid = r1 JOIN named d ON d.cid = r2"
    ),
)
def _(spark, sf):
    tables = star(spark, sf)
    two = algebra.of_arity(discover(tables, max_arity=2).inds(), 2)
    return naming.rendered_named(two, tables).select("text")


@query(
    "named_columns",
    lambda: _names_sql("col").select(
        "SELECT a.tab || '.' || a.t || ' ' || b.tab || '.' || b.t AS dep, c.tab || '.' || c.t || ' ' || d.tab || '.' || d.t AS ref "
        "FROM ind2 JOIN named a ON a.cid = d1 JOIN named b ON b.cid = d2 JOIN named c ON c.cid = r1 JOIN named d ON d.cid = r2"
    ),
)
def _(spark, sf):
    tables = star(spark, sf)
    two = algebra.of_arity(discover(tables, max_arity=2).inds(), 2)
    text = lambda names: F.array_join(F.transform(names, lambda x: F.concat(x.table, F.lit("."), x.column)), " ")
    return naming.named(two, tables).select(text("dep_names").alias("dep"), text("ref_names").alias("ref"))


@query(
    "rendered_inds",
    lambda: _names_sql("(cid % 65536)").select(
        "SELECT a.tab || '[' || a.t || ', ' || b.t || '] ⊆ ' || c.tab || '[' || c.t || ', ' || d.t || ']' AS text FROM ind2 "
        "JOIN named a ON a.cid = d1 JOIN named b ON b.cid = d2 JOIN named c ON c.cid = r1 JOIN named d ON d.cid = r2"
    ),
)
def _(spark, sf):
    tables = star(spark, sf)
    two = algebra.of_arity(discover(tables, max_arity=2).inds(), 2)
    return two.select(naming.rendered(tables).alias("text"))


@query(
    "named_rules",
    lambda: Script(NULLS)
    .rules(1)
    .step("named", "SELECT cid, tab || '.' || col AS t FROM cols")
    .select(
        "SELECT '〈[] ⊆ []〉 ⇉ 〈[' || a.t || '] ⊆ [' || b.t || ']〉' AS text FROM rule1 "
        "JOIN named a ON a.cid = rhs_dep JOIN named b ON b.cid = rhs_ref"
    ),
)
def _(spark, sf):
    tables = table_set(spark, sf, NULLS)
    return naming.rendered_named_rules(discover_with_rules(tables, max_arity=1).rules(), tables).select("text")


# --- projections, samples, delimited lines -------------------------------------------


@query("max_columns_inds", lambda: Script(ALL_TABLES, max_columns=3).unary().select("SELECT dep, ref, n AS size FROM unary_inds"))
def _(spark, sf):
    return unary_inds(table_set(spark, sf, ALL_TABLES, max_columns=3))


@query(
    "key_sample",
    lambda: f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 100 IN ({', '.join(str(int(i * (100.0 / 30))) for i in range(30))})",
)
def _(spark, sf):
    return key_sample(load(spark, sf, {"o": STAR["orders"]})["o"], F.col("o_orderkey"), 30).select("o_orderkey", "o_custkey")


@query(
    "complete_tuples",
    lambda: Script(NULLS).select("SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM t_document_labels WHERE quality IS NOT NULL AND toxic IS NOT NULL"),
)
def _(spark, sf):
    rows = tuples(table_set(spark, sf, {"document_labels": NULLS["document_labels"]}))
    return complete_tuples(rows).select(F.get("f", F.lit(0)).alias("doc_id"))


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _lines(df: DataFrame, value: Column) -> DataFrame:
    """Rows written as delimited lines, as if scanned from one file."""
    return df.select(
        F.lit(65535).alias("table_id"), F.lit("rows").alias("path"), F.lit(0).cast("bigint").alias("block_start"),
        F.monotonically_increasing_id().alias("row_in_block"), value.alias("value"),
    )


@query(
    "csv_plain_lines",
    lambda: "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _CUSTOMER) + " FROM customer",
)
def _(spark, sf):
    df = load(spark, sf, ALL_TABLES)["customer"]
    parsed = parse_lines(_lines(df, F.concat_ws(";", *_CUSTOMER)))
    return parsed.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(_CUSTOMER)])


@query(
    "csv_quoted_lines",
    lambda: "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang, source, CAST(n_chars AS VARCHAR) AS n_chars "
    "FROM documents",
)
def _(spark, sf):
    df = load(spark, sf, ALL_TABLES)["documents"]
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "doc_id", quoted, "lang", "source", "n_chars")
    parsed = parse_lines(_lines(df, line), Dialect(separator=",", quote='"'))
    return parsed.select(
        F.get("f", F.lit(0)).alias("doc_id"), F.md5(F.get("f", F.lit(1))).alias("text_md5"),
        *[F.get("f", F.lit(i)).alias(c) for i, c in ((2, "lang"), (3, "source"), (4, "n_chars"))],
    )


@query(
    "csv_inner_quotes",
    lambda: "SELECT 'a\"' || doc_id || '\"b' AS first_field, 'x' || source AS middle_field, 'a\"' || lang || ',\"b' AS last_field FROM documents",
)
def _(spark, sf):
    """Quotes amid the text of a first and a later field are kept, wherever they stand."""
    df = load(spark, sf, ALL_TABLES)["documents"]
    amid = lambda c: F.concat(F.lit('a"'), F.col(c).cast("string"), F.lit('"b'))
    last = F.concat(F.lit('a"'), F.col("lang"), F.lit(',"b'))
    quoted = F.concat(F.lit('"x'), F.col("source"), F.lit('"'))
    parsed = parse_lines(_lines(df, F.concat_ws(",", amid("doc_id"), quoted, last)), Dialect(separator=",", quote='"'))
    return parsed.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("first_field", "middle_field", "last_field"))])


_DOCUMENT_FIELDS = (
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"
)


def _escaped(column: str) -> Column:
    """Text in quotes, with a backslash in front of quotes and backslashes."""
    text = F.replace(F.replace(F.col(column).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _document_fields(parsed: DataFrame) -> DataFrame:
    field = lambda i: F.get("f", F.lit(i))
    names = ((0, "doc_id"), (2, "lang"), (3, "source"), (4, "n_chars"))
    return parsed.select(*[field(i).alias(c) for i, c in names], F.md5(field(1)).alias("text_md5"))


@query("csv_strict_quotes", lambda: _DOCUMENT_FIELDS)
def _(spark, sf):
    """Only what stands in quotes counts; escapes protect quotes and themselves."""
    df = load(spark, sf, ALL_TABLES)["documents"]
    fields = [F.concat(F.lit("out "), _escaped(c), F.lit(" out")) for c in df.columns]
    dialect = Dialect(separator=",", quote='"', escape="\\", strict_quotes=True)
    return _document_fields(parse_lines(_lines(df, F.concat_ws(",", *fields)), dialect))


@query("csv_leading_blanks", lambda: _DOCUMENT_FIELDS)
def _(spark, sf):
    """White space in front of a quote is no data."""
    df = load(spark, sf, ALL_TABLES)["documents"]
    fields = [F.concat(F.lit(" \t " if i % 2 else ""), _escaped(c)) for i, c in enumerate(df.columns)]
    dialect = Dialect(separator=",", quote='"', escape="\\", ignore_leading_whitespace=True)
    return _document_fields(parse_lines(_lines(df, F.concat_ws(",", *fields)), dialect))


_STORED = {"documents": ALL_TABLES["documents"], "labels": ALL_TABLES["labels"]}


@query(
    "stored_cell_values",
    lambda: Script(_STORED).unary().select("SELECT cid AS column_id, md5(v) AS value_md5, length(v) AS n FROM all_cells WHERE v IS NOT NULL"),
)
def _(spark, sf):
    """Stored tables give back whole texts, not the digests they are grouped by."""
    cells = cell_values(table_set(spark, sf, _STORED).stored())
    return cells.select("column_id", F.md5("v").alias("value_md5"), F.length("v").cast("bigint").alias("n"))


_LABELLED = NULLS["document_labels"].columns


@query(
    "csv_null_string",
    lambda: Script(NULLS).select("SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _LABELLED) + " FROM t_document_labels"),
)
def _(spark, sf):
    df = load(spark, sf, NULLS)["document_labels"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
    parsed = parse_lines(_lines(df, F.concat_ws("\t", *map(text, _LABELLED))), Dialect(separator="\t"), "\\N")
    return parsed.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(_LABELLED)])


def _ragged(spark, sf) -> DataFrame:
    """Documents without labels give lines that are two fields short."""
    df = load(spark, sf, NULLS)["document_labels"]
    return parse_lines(_lines(df, F.concat_ws(";", "doc_id", "lang", "quality", "toxic")))


@query(
    "ragged_lines_dropped",
    lambda: Script(NULLS).select("SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM t_document_labels WHERE quality IS NOT NULL"),
)
def _(spark, sf):
    return apply_width_policy(_ragged(spark, sf), {65535: 4}, "drop").select(F.get("f", F.lit(0)).alias("doc_id"))


@query(
    "ragged_lines_counted",
    lambda: Script(NULLS).select("SELECT 65535 AS table_id, count(*) AS lines FROM t_document_labels WHERE quality IS NULL"),
)
def _(spark, sf):
    return width_violations(_ragged(spark, sf), {65535: 4})


_WRITTEN = {"region": ALL_TABLES["region"], "nation": ALL_TABLES["nation"], "orders": ALL_TABLES["orders"], "labels": ALL_TABLES["labels"]}


@query(
    "ragged_fail_overlong",
    lambda: Script(NULLS).select("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(toxic AS VARCHAR) AS toxic FROM t_document_labels"),
)
def _(spark, sf):
    """Shorter lines than declared are kept, with nulls at their end."""
    kept = apply_width_policy(_ragged(spark, sf), {65535: 4}, "fail_overlong")
    return kept.select(F.get("f", F.lit(0)).alias("doc_id"), F.get("f", F.lit(3)).alias("toxic"))


def _lines_folder(spark, lines: dict[str, DataFrame], kind: str = "text", **options) -> str:
    """Subfolders with a file for each task."""
    folder = new_folder(spark, "lines")
    for name, df in lines.items():
        df.write.options(**options).format(kind).save(f"{folder}/{name}")
    return folder


def _line(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws(";", *(columns or df.columns)).alias("value"))


@query(
    "csv_carriage_returns",
    lambda: "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'a' || chr(13) || coalesce(CAST(toxic AS VARCHAR), '') AS marked FROM labels",
)
def _(spark, sf):
    """Lines end with a newline, with or without a carriage return; one amid a line is data."""
    df = load(spark, sf, ALL_TABLES)["labels"].withColumn("marked", F.concat(F.lit("a\r"), F.coalesce(F.col("toxic").cast("string"), F.lit(""))))
    folder = _lines_folder(spark, {"labels": _line(df, "doc_id", "marked")}, lineSep="\r\n")
    parsed = parse_lines(scan_lines(spark, f"{folder}/labels", 65535))
    return parsed.select(F.get("f", F.lit(0)).alias("doc_id"), F.get("f", F.lit(1)).alias("marked"))


def _joined_sql(table: str) -> str:
    return f"SELECT concat_ws(';', {', '.join(f'CAST({c} AS VARCHAR)' for c in ALL_TABLES[table].columns)}) AS value FROM {table}"


@query("file_name_lines", lambda: _joined_sql("customer"))
def _(spark, sf):
    """Files are chosen by a pattern of their names and by a glob."""
    given_tables = load(spark, sf, ALL_TABLES)
    folder = new_folder(spark, "lines")
    _line(given_tables["customer"]).write.text(f"{folder}/a")
    _line(given_tables["labels"]).write.csv(f"{folder}/b")
    return scan_lines(spark, folder, 1, recursive=True, name_regex=r"part-.*\.txt", glob="part-*").select("value")


@query("file_depth_lines", lambda: _joined_sql("customer"))
def _(spark, sf):
    given_tables = load(spark, sf, ALL_TABLES)
    folder = _lines_folder(spark, {"near": _line(given_tables["customer"]), "far/away": _line(given_tables["labels"])})
    return scan_lines(spark, folder, 1, max_depth=2).select("value")


@query(
    "file_ids",
    lambda: " UNION ALL ".join(
        f"SELECT {len(ALL_TABLES[t].columns)} AS width, count(*) AS lines, CAST(1 AS BIGINT) AS ids FROM {t}" for t in ("region", "nation", "labels")
    ),
)
def _(spark, sf):
    """Each file has an id of its own, which a second scan gives again."""
    given_tables = load(spark, sf, ALL_TABLES)
    text = lambda df: df.select(F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    folder = _lines_folder(spark, {t: text(given_tables[t]).coalesce(1) for t in ("region", "nation", "labels")})
    first = file_tables(spark, folder, recursive=True)
    again = file_tables(spark, f"{folder}/*").select("path", F.col("table_id").alias("id_again"))
    return first.join(again, "path").groupBy("path").agg(
        F.max("width").alias("width"), F.max("lines").alias("lines"),
        F.count_distinct(F.when(F.col("table_id") == F.col("id_again"), F.col("table_id"))).alias("ids"),
    ).drop("path")


@query("charset_lines", lambda: "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'ä' || lang || 'ß' AS marked FROM documents")
def _(spark, sf):
    """The bytes of another charset, read by the engine."""
    df = load(spark, sf, ALL_TABLES)["documents"]
    line = F.concat(F.col("doc_id").cast("string"), F.lit(";ä"), F.col("lang"), F.lit("ß"))
    encoded = df.select(F.encode(line, "ISO-8859-1").cast("string").alias("value"))
    folder = _lines_folder(spark, {"documents": encoded})
    parsed = parse_lines(scan_lines(spark, f"{folder}/documents", 65535, encoding="ISO-8859-1"))
    return parsed.select(F.get("f", F.lit(0)).alias("doc_id"), F.get("f", F.lit(1)).alias("marked"))


_ENCODED = (
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5('漢字' || replace(text, chr(10), '¶')) AS text_md5, lang, source, "
    "CAST(n_chars AS VARCHAR) AS n_chars FROM documents"
)


def _encoded_documents(spark, sf, charset: str, **options) -> DataFrame:
    """Documents, whole, written in another charset and read back."""
    df = load(spark, sf, ALL_TABLES)["documents"]
    text = F.concat(F.lit("漢字"), F.replace(F.col("text"), F.lit("\n"), F.lit("¶")))
    with any_charset(spark):
        line = F.encode(F.concat_ws("\x1f", "doc_id", text, "lang", "source", "n_chars"), charset)
        encoded = df.select(line.cast("string").alias("value"))
    folder = _lines_folder(spark, {"documents": encoded}, **options)
    parsed = parse_lines(scan_lines(spark, f"{folder}/documents", 65535, encoding=charset), Dialect(separator="\x1f"))
    return parsed.select(
        F.get("f", F.lit(0)).alias("doc_id"), F.md5(F.get("f", F.lit(1))).alias("text_md5"),
        *[F.get("f", F.lit(i)).alias(c) for i, c in ((2, "lang"), (3, "source"), (4, "n_chars"))],
    )


@query("charset_multibyte_lines", lambda: _ENCODED)
def _(spark, sf):
    return _encoded_documents(spark, sf, "GB18030")


@query("charset_utf16_lines", lambda: _ENCODED)
def _(spark, sf):
    """Lines end with a newline of two bytes."""
    return _encoded_documents(spark, sf, "UTF-16LE", lineSep="\n", encoding="UTF-16LE")


@query("marked_lines", lambda: "SELECT doc_id || ';' || quality || ';' || toxic AS value FROM labels")
def _(spark, sf):
    """A byte order mark in front is no data; the encoding may announce it."""
    df = load(spark, sf, ALL_TABLES)["labels"]
    marked = df.select(F.concat(F.lit("\ufeff"), F.concat(F.col("doc_id"), F.lit(";"), F.col("quality"), F.lit(";"), F.col("toxic"))).alias("value"))
    folder = _lines_folder(spark, {"labels": marked})
    return scan_lines(spark, f"{folder}/labels", 1, encoding="UTF_8:UTF-8", strip_bom=False).select("value")


def _written(spark, sf, relations, **options) -> dict[str, str]:
    """Tables written as delimited files to the shared folder."""
    folder = new_folder(spark, "lines")
    paths = {}
    for name, df in load(spark, sf, relations).items():
        paths[name] = f"{folder}/{name}"
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
        df.select(line.alias("value")).write.options(**options).text(paths[name])
    return paths


@query("csv_files_unary_inds", lambda: Script(_WRITTEN).unary().select("SELECT dep, ref, n AS size FROM unary_inds"))
def _(spark, sf):
    return unary_inds(csv_tables(spark, _written(spark, sf, _WRITTEN), Dialect(separator="|")))


@query(
    "csv_header_inds",
    lambda: Script(_WRITTEN).unary().select(
        "SELECT d.tab || '.' || d.col AS dep, r.tab || '.' || r.col AS ref, n AS size "
        "FROM unary_inds JOIN cols d ON d.cid = dep JOIN cols r ON r.cid = ref"
    ),
)
def _(spark, sf):
    """Names come from the first line of the files, which is no data in any of them."""
    folder, paths = new_folder(spark, "lines"), {}
    for name, df in load(spark, sf, _WRITTEN).items():
        paths[name] = f"{folder}/{name}"
        text = df.select(*[F.col(c).cast("string") for c in df.columns])
        text.repartition(3).write.csv(paths[name], sep="|", header=True)
    tables = csv_tables(spark, paths, Dialect(separator="|"), header=True)
    text = lambda names: F.array_join(F.transform(names, lambda x: F.concat(x.table, F.lit("."), x.column)), " ")
    named = naming.named(as_ind_table(unary_inds(tables)), tables)
    return named.select(text("dep_names").alias("dep"), text("ref_names").alias("ref"), "size")


@query("csv_gzip_partial_inds", lambda: _partial_sql(Script(_WRITTEN), 0.5))
def _(spark, sf):
    """Compressed files come as one task each, so their rows are dealt out after the read."""
    paths = _written(spark, sf, _WRITTEN, compression="gzip")
    n = spark.sparkContext.defaultParallelism
    return partial_unary_inds(csv_tables(spark, paths, Dialect(separator="|"), spread=n), 0.5)


@query("csv_files_nary_inds", lambda: Script(OUTCOMES).levels(3).select(Script(OUTCOMES).all_inds(3)))
def _(spark, sf):
    paths = _written(spark, sf, OUTCOMES)
    tables = csv_tables(spark, paths, Dialect(separator="|"), null_string="\\N", policy="drop")
    return flat(discover(tables.stored(), max_arity=3).inds())
