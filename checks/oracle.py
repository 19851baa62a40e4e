"""SQL with the same results, written from the definitions and run level by level."""

from __future__ import annotations

from itertools import permutations, product

from typing import NamedTuple

from checks.datasets import Relation, column_ids

Relations = dict[str, Relation]


class Allowed(NamedTuple):
    """Whether a column may be on both sides, twice on one side, and paired with itself."""

    inter: bool
    intra: bool
    trivial: bool


RESTRICTIONS = {
    "NO_REPETITIONS": Allowed(False, False, False),
    "NO_INTRA_REPETITIONS_NO_TRIVIAL": Allowed(True, False, False),
    "NO_INTRA_REPETITIONS": Allowed(True, False, True),
    "NO_TRIVIAL": Allowed(True, True, False),
    "NO_INTER_REPETITIONS": Allowed(False, True, False),
    "ANY_REPETITION": Allowed(True, True, True),
}


def _indexed(prefix: str, n: int, alias: str = "") -> list[str]:
    dot = f"{alias}." if alias else ""
    return [f"{dot}{prefix}{i}" for i in range(1, n + 1)]


def _list(names: list[str]) -> str:
    return ", ".join(names)


def _joined(names: list[str]) -> str:
    """Ids as one text, like 1,2,3."""
    return "concat_ws(',', " + _list(names) + ")"


def _equal(left: list[str], right: list[str]) -> str:
    return " AND ".join(f"{a} = {b}" for a, b in zip(left, right)) or "TRUE"


class Script:
    """A chain of named subqueries over one table set."""

    def __init__(self, relations: Relations, drop_nulls: bool = True, max_columns: int | None = None):
        if max_columns is not None:
            relations = {n: Relation(r.columns[:max_columns], r.sql) for n, r in relations.items()}
        self.relations, self.drop_nulls = relations, drop_nulls
        self.columns = column_ids(relations)
        self.steps: list[tuple[str, str]] = [(f"t_{name}", r.sql) for name, r in relations.items()]
        self.combos_done: set[tuple[int, bool]] = set()

    def step(self, name: str, sql: str) -> "Script":
        self.steps.append((name, sql))
        return self

    def select(self, sql: str) -> str:
        return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in self.steps) + "\n" + sql

    def value(self, column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return text if self.drop_nulls else f"coalesce('=' || {text}, 'null')"

    # unary -------------------------------------------------------------------------

    def unary(self) -> "Script":
        parts = [f"SELECT {cid} AS cid, {self.value(column)} AS v FROM t_{table}" for cid, table, column in self.columns]
        self.step("all_cells", " UNION ALL ".join(parts))
        self.step("cells", "SELECT DISTINCT cid, v FROM all_cells WHERE v IS NOT NULL")
        values = ", ".join(f"({cid}, '{table}', '{column}')" for cid, table, column in self.columns)
        self.step("cols", f"SELECT * FROM (VALUES {values}) AS c(cid, tab, col)")
        self.step("sizes", "SELECT cid, count(*) AS n FROM cells GROUP BY cid")
        self.step(
            "shared",
            "SELECT a.cid AS dep, b.cid AS ref, count(*) AS o FROM cells a JOIN cells b ON a.v = b.v AND a.cid <> b.cid "
            "GROUP BY a.cid, b.cid",
        )
        self.step("proper", "SELECT dep, ref, n FROM shared JOIN sizes ON dep = cid WHERE o = n")
        self.step(
            "void",
            "SELECT a.cid AS dep, b.cid AS ref, CAST(0 AS BIGINT) AS n FROM cols a JOIN cols b ON a.cid <> b.cid "
            "WHERE a.cid NOT IN (SELECT cid FROM sizes)",
        )
        self.step("unary_inds", "SELECT * FROM proper UNION ALL SELECT * FROM void")
        return self

    # n-ary -------------------------------------------------------------------------

    def combos(self, n: int, repeated: bool) -> None:
        """keyed{n}: the distinct values of every ordered combination of n columns of a table."""
        if (n, repeated) in self.combos_done:
            return
        self.combos_done.add((n, repeated))
        parts = []
        for table in self.relations:
            own = [(cid, column) for cid, t, column in self.columns if t == table]
            for combo in product(own, repeat=n) if repeated else permutations(own, n):
                ids = _list([f"{cid} AS c{i}" for i, (cid, _) in enumerate(combo, 1)])
                keys = _list([f"{self.value(column)} AS k{i}" for i, (_, column) in enumerate(combo, 1)])
                full = " AND ".join(f"{column} IS NOT NULL" for _, column in combo) if self.drop_nulls else "TRUE"
                parts.append(f"SELECT DISTINCT {ids}, {keys} FROM t_{table} WHERE {full}")
        self.step(f"keyed{n}", " UNION ALL ".join(parts))
        c = _list(_indexed("c", n))
        self.step(f"size{n}", f"SELECT {c}, count(*) AS n FROM keyed{n} GROUP BY {c}")

    def nulls(self, n: int) -> None:
        """nulls{n}: rows with a null in the combination."""
        parts = []
        for table in self.relations:
            own = [(cid, column) for cid, t, column in self.columns if t == table]
            for combo in permutations(own, n):
                ids = _list([f"{cid} AS c{i}" for i, (cid, _) in enumerate(combo, 1)])
                missing = " OR ".join(f"{column} IS NULL" for _, column in combo) if self.drop_nulls else "FALSE"
                parts.append(f"SELECT {ids}, count(*) AS n FROM t_{table} WHERE {missing}")
        self.step(f"nulls{n}", " UNION ALL ".join(parts))

    def candidates(self, n: int, source: str, restrictions: str, name: str, generator: str = "apriori") -> None:
        rules = RESTRICTIONS[restrictions]
        d, r = _indexed("d", n - 1, "a"), _indexed("r", n - 1, "a")
        same = "a.d1 >> 16 = b.d1 >> 16 AND a.r1 >> 16 = b.r1 >> 16"
        if generator == "binder":
            new_d, new_r = "b.d1", "b.r1"
            ok = [f"{new_d} > {x}" for x in d] + [f"{new_r} <> {x}" for x in r + d] + [f"{new_d} <> {x}" for x in r]
            sql = f"FROM {source} a JOIN ind1 b ON {same} AND " + " AND ".join(ok)
        else:
            new_d, new_r = f"b.d{n - 1}", f"b.r{n - 1}"
            prefix = _equal(d[:-1] + r[:-1], _indexed("d", n - 2, "b") + _indexed("r", n - 2, "b"))
            if rules.intra:
                order = f"({d[-1]} < {new_d} OR ({d[-1]} = {new_d} AND {r[-1]} < {new_r}))"
            else:
                order = f"{d[-1]} < {new_d} AND {r[-1]} <> {new_r}"
            if not rules.inter:
                order += f" AND {d[-1]} <> {new_r} AND {new_d} <> {r[-1]}"
            sql = f"FROM {source} a JOIN {source} b ON {same} AND {prefix} AND {order}"
            whole_d, whole_r = d + [new_d], r + [new_r]
            for drop in range(n - 2):
                left_d, left_r = whole_d[:drop] + whole_d[drop + 1 :], whole_r[:drop] + whole_r[drop + 1 :]
                known = _equal(_indexed("d", n - 1, "g") + _indexed("r", n - 1, "g"), left_d + left_r)
                sql += (" WHERE " if drop == 0 else " AND ") + f"EXISTS (SELECT 1 FROM {source} g WHERE {known})"
        names = _list([f"{x} AS {y}" for x, y in zip(d + [new_d] + r + [new_r], _indexed("d", n) + _indexed("r", n))])
        self.step(name, f"SELECT {names} {sql}")

    def validate(self, n: int, candidates: str, name: str) -> None:
        d, r = _indexed("d", n), _indexed("r", n)
        dr = _list(d + r)
        self.step(
            f"{name}_shared",
            f"SELECT {dr}, count(*) AS o FROM {candidates} JOIN keyed{n} x ON {_equal(_indexed('c', n, 'x'), d)} "
            f"JOIN keyed{n} y ON {_equal(_indexed('c', n, 'y'), r)} AND "
            f"{_equal(_indexed('k', n, 'x'), _indexed('k', n, 'y'))} GROUP BY {dr}",
        )
        self.step(
            f"{name}_checked",
            f"SELECT {_list(_indexed('d', n, 'c') + _indexed('r', n, 'c'))}, coalesce(s.n, 0) AS n, coalesce(o, 0) AS o "
            f"FROM {candidates} c LEFT JOIN size{n} s ON {_equal(_indexed('c', n, 's'), _indexed('d', n, 'c'))} "
            f"LEFT JOIN {name}_shared h ON "
            f"{_equal(_indexed('d', n, 'c') + _indexed('r', n, 'c'), _indexed('d', n, 'h') + _indexed('r', n, 'h'))}",
        )
        self.step(name, f"SELECT {dr}, n FROM {name}_checked WHERE o = n")

    def levels(
        self, max_arity: int, restrictions: str = "NO_REPETITIONS", generator: str = "apriori", without_void: bool = False
    ) -> "Script":
        self.unary()
        self.step("ind1", "SELECT dep AS d1, ref AS r1, n FROM unary_inds" + (" WHERE n > 0" if without_void else ""))
        for n in range(2, max_arity + 1):
            self.combos(n, RESTRICTIONS[restrictions].intra)
            self.candidates(n, f"ind{n - 1}", restrictions, f"cand{n}", generator)
            self.validate(n, f"cand{n}", f"ind{n}")
        return self

    def all_inds(self, max_arity: int, min_arity: int = 1, name: str = "ind") -> str:
        return " UNION ALL ".join(
            f"SELECT {n} AS arity, {_joined(_indexed('d', n))} AS dep, {_joined(_indexed('r', n))} AS ref FROM {name}{n}"
            for n in range(min_arity, max_arity + 1)
        )

    def maximal(self, max_arity: int, name: str = "ind") -> str:
        parts = []
        for n in range(1, max_arity + 1):
            sql = f"SELECT {n} AS arity, {_joined(_indexed('d', n, 'i'))} AS dep, {_joined(_indexed('r', n, 'i'))} AS ref FROM {name}{n} i"
            if n < max_arity:
                sql += f" WHERE NOT EXISTS (SELECT 1 FROM {name}{n + 1} b WHERE " + self._a_projection(n + 1, "i", "b") + ")"
            parts.append(sql)
        return " UNION ALL ".join(parts)

    @staticmethod
    def _a_projection(n: int, small: str, big: str) -> str:
        """small is big without one pair."""
        options = []
        for drop in range(n):
            d, r = _indexed("d", n, big), _indexed("r", n, big)
            left = d[:drop] + d[drop + 1 :] + r[:drop] + r[drop + 1 :]
            options.append(f"({_equal(_indexed('d', n - 1, small) + _indexed('r', n - 1, small), left)})")
        return " OR ".join(options)

    # rules -------------------------------------------------------------------------

    def rules(self, max_arity: int) -> "Script":
        """kept{n}: dependencies without those that rules restore; rule{n}: the rules."""
        self.unary()
        self.step("size1", "SELECT cid AS c1, n FROM sizes")
        self.nulls(1)
        trivial = "u.n = 0 OR s.n = 1"
        source = "FROM unary_inds u LEFT JOIN sizes s ON u.ref = s.cid"
        self.step("kept1", f"SELECT dep AS d1, ref AS r1, u.n {source} WHERE NOT coalesce({trivial}, FALSE)")
        self.step("rule1", f"SELECT '' AS lhs_dep, '' AS lhs_ref, dep AS rhs_dep, ref AS rhs_ref {source} WHERE {trivial}")
        for n in range(2, max_arity + 1):
            self.combos(n, False)
            self.nulls(n)
            self.candidates(n, f"kept{n - 1}", "NO_REPETITIONS", f"cand{n}")
            self.validate(n, f"cand{n}", f"hold{n}")
            r = _indexed("r", n, "i")
            flags, joins, rules = [], "", []
            joins += f" LEFT JOIN size{n} w ON {_equal(_indexed('c', n, 'w'), r)} LEFT JOIN nulls{n} wn ON {_equal(_indexed('c', n, 'wn'), r)}"
            for drop in range(n):
                rest = r[:drop] + r[drop + 1 :]
                joins += f" LEFT JOIN size{n - 1} p{drop} ON {_equal(_indexed('c', n - 1, f'p{drop}'), rest)}"
                joins += f" LEFT JOIN nulls{n - 1} pn{drop} ON {_equal(_indexed('c', n - 1, f'pn{drop}'), rest)}"
                flags.append(f"coalesce(i.n = 0 OR (w.n = p{drop}.n AND wn.n = pn{drop}.n), FALSE) AS f{drop}")
            self.step(f"judged{n}", f"SELECT i.*, {_list(flags)} FROM hold{n} i{joins}")
            none = " AND ".join(f"NOT f{drop}" for drop in range(n))
            self.step(f"kept{n}", f"SELECT {_list(_indexed('d', n) + _indexed('r', n))}, n FROM judged{n} WHERE {none}")
            for drop in range(n):
                d, r = _indexed("d", n), _indexed("r", n)
                rules.append(
                    f"SELECT {_joined(d[:drop] + d[drop + 1:])} AS lhs_dep, {_joined(r[:drop] + r[drop + 1:])} AS lhs_ref, "
                    f"{d[drop]} AS rhs_dep, {r[drop]} AS rhs_ref FROM judged{n} WHERE f{drop}"
                )
            self.step(f"rule{n}", " UNION ALL ".join(rules))
        return self

    def all_rules(self, max_arity: int, min_arity: int = 1) -> str:
        return " UNION ALL ".join(f"SELECT * FROM rule{n}" for n in range(min_arity, max_arity + 1))
