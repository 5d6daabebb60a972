"""Spark SQL over tables: names become temp views; `fts(table, 'query JSON')` is a search's result."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FTS = re.compile(r"\bfts\s*\(\s*(?:'([^']+)'|\"([^\"]+)\"|([A-Za-z_]\w*))\s*,\s*'((?:[^'\\]|\\.|'')*)'\s*\)", re.IGNORECASE)
_INSERT = re.compile(r"\s*INSERT\s+(INTO|OVERWRITE)\s+(?:TABLE\s+)?([A-Za-z_]\w*)\s+(.*)", re.IGNORECASE | re.DOTALL)
_FTS_ANY = re.compile(r"\bfts\s*\(", re.IGNORECASE)


def fts_frame(table, query) -> DataFrame:
    """The table's columns and _score of every match."""
    from ..operators import fts, index
    from ..sources.snapshot import ROW_ID

    q = query if isinstance(query, fts.FtsQuery) else fts.from_dict(query)
    hits = fts.Search(table.spark, index.fts_sources(table)).run(q)
    return table.scan().join(hits, ROW_ID).select(*[F.col(f"`{c}`") for c in table.columns], "_score")


def run(database, text: str, tables: dict) -> DataFrame:
    """The SQL with every table of the database that it names, the given ones, and its fts() calls as views.

    INSERT INTO and INSERT OVERWRITE write the query's rows to a table, and give one row with their number.
    """
    spark = database.spark
    if (insert := _INSERT.fullmatch(text)) is not None:
        mode, name, rest = insert.groups()
        target = tables.get(name, name)
        target = database.open_table(target) if isinstance(target, str) else target
        rows = run(database, rest, tables)
        if len(rows.columns) != len(target.columns):
            raise ValueError(f"{name} has {len(target.columns)} columns, the query {len(rows.columns)}")
        done = target.add(rows.toDF(*target.columns), "append" if mode.upper() == "INTO" else "overwrite")
        return spark.createDataFrame([(done.inserted,)], "inserted long")
    held = {n: (database.open_table(t) if isinstance(t, str) else t) for n, t in tables.items()}
    known = set(database.table_names(limit=None))

    def resolve(name: str):
        if name in held:
            return held[name]
        if name in known:
            held[name] = database.open_table(name)
            return held[name]
        raise ValueError(f"no table {name}")

    def searched(m: re.Match) -> str:
        view = f"fts_{uuid.uuid4().hex}"
        query = m.group(4).replace("''", "'").replace("\\'", "'")
        fts_frame(resolve(m.group(1) or m.group(2) or m.group(3)), query).createOrReplaceTempView(view)
        return view

    text = _FTS.sub(searched, text)
    if _FTS_ANY.search(text):
        raise ValueError("fts takes a table name and a query, both literal")
    words = set(re.findall(r"[A-Za-z_]\w*", text))
    for name in known & words - set(held):
        held[name] = database.open_table(name)
    for name, table in held.items():
        table.view(name)
    return spark.sql(text)
