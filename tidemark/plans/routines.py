"""Stored procedures: CREATE PROCEDURE and CALL through Spark's SQL scripting."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_PARAMETER = re.compile(r"\s*(?:(IN|OUT|INOUT)\s+)?(\w+)\s+(\w+(?:\s*\([\d\s,]+\))?)\s*(?:,|$)", re.I)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Routines:
    spark: SparkSession
    procedures: dict[str, tuple[list[tuple[str, str, str]], str]] = field(default_factory=dict)

    def create(self, name: str, parameters: str, body: str) -> None:
        """CREATE PROCEDURE name (parameters): each IN (the default), OUT or INOUT, a name and a type."""
        if name in self.procedures:
            raise ValueError(f"procedure {name} exists")
        found, at = [], 0
        while at < len(parameters.rstrip()):
            m = _PARAMETER.match(parameters, at)
            if not m:
                raise ValueError(f"no parameter: {parameters[at:]}")
            found.append(((m[1] or "IN").upper(), m[2], m[3]))
            at = m.end()
        self.procedures[name] = (found, body.strip().rstrip(";"))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.procedures.pop(name, None) is None and not if_exists:
            raise KeyError(name)

    def call(self, name: str, *values: object) -> DataFrame:
        """CALL name(values): one row of the OUT and INOUT parameters, or without those the body's last result.

        Values of OUT parameters are ignored: they start as NULL.
        """
        parameters, body = self.procedures[name]
        if len(values) != len(parameters):
            raise ValueError(f"procedure {name} takes {len(parameters)} values")
        outer = " ".join(f"DECLARE {p} {kind} DEFAULT {'NULL' if mode == 'OUT' else _literal(v)};" for (mode, p, kind), v in zip(parameters, values, strict=True))
        back = ", ".join(p for mode, p, _ in parameters if mode != "IN")
        result = f" SELECT {back};" if back else ""
        return self.spark.sql(f"BEGIN {outer} BEGIN {body}; END;{result} END")
