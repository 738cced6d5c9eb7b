"""Run registered queries against their SQL counterparts and compare values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(df, con, sql: str) -> tuple[str, int]:
    """'' if names, types and values agree, else what differs; and the row count."""
    table = df.toArrow()
    mine = [tuple(r.values()) for r in table.to_pylist()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(mine)
    for name, kind in df.dtypes:
        if FAMILY.get(kind) != types[name]:
            return f"type of {name}: {kind} vs {types[name]}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}", len(mine)
    a, b = _sorted(mine, df.columns), _sorted(theirs, names)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, e.g. {wrong[0][0]} != {wrong[0][1]}", len(mine)
    return "", len(mine)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tideline.session import local_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                t1 = time.time()
                message, rows = compare(df, con, oracles[name])
            else:
                rows = df.count()
                message = "" if rows else "no rows"
            state = "ok " if not message else "BAD"
        except Exception as error:  # report and go on with the next query
            state, message, rows = "ERR", str(error)[:1500], -1
        bad += state != "ok "
        kind = "sql " if name in oracles else "rows"
        print(f"{state} {kind} {name:32s} rows={rows:<8d} {time.time() - t0:6.2f}s {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
