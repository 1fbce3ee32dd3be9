"""Literal tables that a query and its SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.session import table

_DUCK = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


class Values:
    """Rows under a schema such as ``path string, n long``."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        names = [c.split()[0] for c in self.schema.split(", ")]
        kinds = [_DUCK[c.split()[1]] for c in self.schema.split(", ")]
        cell = lambda v, k: f"CAST(NULL AS {k})" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({str(v).lower()} AS {k})")
        rows = ", ".join("(" + ", ".join(cell(v, k) for v, k in zip(r, kinds)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS v({', '.join(names)}))"


class Grown(Values):
    """A literal table, and rows that both engines derive from given tables: parts are (table, condition, expressions)
    in SQL that both understand."""

    def __init__(self, base: Values, *parts: tuple[str, str, list[str]]):
        super().__init__(base.schema, base.rows)
        self.parts = parts

    def frame(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        """Without ``sf`` the literal rows alone."""
        out = super().frame(spark)
        for name, where, exprs in self.parts if sf else ():
            columns = [f"CAST({e} AS {'BIGINT' if c.split()[1] == 'long' else c.split()[1]}) AS {c.split()[0]}" for e, c in zip(exprs, self.schema.split(", "))]
            out = out.unionByName(table(spark, sf, name).filter(where).selectExpr(*columns))
        return out

    def sql(self) -> str:
        kinds = [(c.split()[0], _DUCK[c.split()[1]]) for c in self.schema.split(", ")]
        parts = [f"SELECT {', '.join(f'CAST({e} AS {k}) AS {n}' for e, (n, k) in zip(exprs, kinds))} FROM {name} WHERE {where}" for name, where, exprs in self.parts]
        return "(" + " UNION ALL ".join([f"SELECT * FROM {super().sql()}", *parts]) + ")"
