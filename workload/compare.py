"""Side-by-side run of registered queries and their SQL in DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from . import ORACLES, QUERIES, load_all


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, sf: str, name: str) -> str | None:
    """None when both results are equal, else what differs. Queries without SQL must return rows."""
    df = QUERIES[name](spark, sf)
    columns, mine = df.columns, [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return None if mine else "no rows"
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(ORACLES[name])
    theirs_columns, theirs = [c[0] for c in found.description], found.fetchall()
    if sorted(columns) != sorted(theirs_columns):
        return f"columns {sorted(columns)} != {sorted(theirs_columns)}"
    a, b = _rows(columns, mine), _rows(theirs_columns, theirs)
    if a == b:
        return None
    extra, lacking = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows, {len(b)} expected; only here {[x[:700] for x in extra]}; only there {[x[:700] for x in lacking]}"


def main() -> None:
    from atlasloom.session import build_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    load_all()
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, sf, name)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.1f}s {name}{'' if problem is None else ': ' + problem}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
