"""The register of named queries, their SQL, and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with SQL where SQL can express it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def runs(src: str, flag: str, keys: str = "session_id", order: str = "frame") -> str:
    """SQL: src with _f (flag), _r (run number) and _n (rows of the run)."""
    w = f"partition by {keys} order by {order}"
    return f"""(select *, count(*) over (partition by {keys}, _r) as _n from
      (select *, sum(_c) over ({w} rows unbounded preceding) as _r from
        (select *, case when _f = lag(_f) over ({w}) then 0 else 1 end as _c from
          (select *, coalesce({flag}, false) as _f from {src}))))"""


def sustain(src: str, flag: str, rows: int, out: str, keys: str = "session_id", order: str = "frame") -> str:
    return f"(select * exclude (_f, _c, _r, _n), (_f and _n >= {rows}) as {out} from {runs(src, flag, keys, order)})"


def filled(src: str, flag: str, gap: int, out: str, keys: str = "session_id", order: str = "frame") -> str:
    return f"""(select * exclude (_f, _c, _r, _n), (_f or (_r > min(_r) over (partition by {keys})
      and _r < max(_r) over (partition by {keys}) and _n + 1 <= {gap})) as {out} from {runs(src, flag, keys, order)})"""


def bout_list(src: str, flag: str, keys: str = "session_id", order: str = "frame", pos: str = "rn") -> str:
    return f"""(select {keys}, min({pos}) as "start", max({pos}) as "end" from {runs(src, flag, keys, order)}
      where _f group by {keys}, _r)"""


def median(value: str, rows: int, keys: str = "session_id, field") -> str:
    return (
        f"quantile_cont({value}, 0.5) over (partition by {keys} order by frame "
        f"rows between {rows // 2} preceding and {(rows - 1) // 2} following)"
    )
