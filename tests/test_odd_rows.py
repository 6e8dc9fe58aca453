"""Queries with SQL on rows that the smallest tables lack, against the comparison engine."""

from __future__ import annotations

import duckdb

from siltstone.plans import ORACLES, QUERIES


def same(spark, sf_dir, name, **tables):
    """The query's rows, which are its SQL's; tables: rows and schema by name."""
    c = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf_dir}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(sf_dir))
    cursor = c.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    found = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert found == sorted(cursor.fetchall(), key=repr)
    return found


def test_memory_blocks_end_at_line_ends(spark, tmp_path):
    """A line end that is the block's first character stays; lines without text or turn."""
    rows = [(1, 0, "a", "x" * 30), (1, 1, "a", "y" * 499), (2, 0, "a", "x" * 30), (2, 1, "a", "y" * 500), (3, 0, "a", "x"), (3, 1, "a", "y" * 498), (4, 0, "a", None), (4, 1, "a", None), (5, 0, "a", None), (5, 1, "a", "z"), (6, None, "a", "last"), (6, 7, "a", "first"), (7, 0, "a", ""), (7, 1, "a", "")]
    found = dict(same(spark, tmp_path, "o260_memory_blocks", conversations=(rows, "conv_id long, turn long, role string, text string")))
    assert found[1] == "\n" + "y" * 499 and found[3] == "x\n" + "y" * 498 and found[4] is None and found[6] == "first\nlast"


def test_names_whose_stem_is_a_word_too(spark, tmp_path):
    """Thoned loses its ending and then equals another word of its claim."""
    said = ["Thoned was here before the thon itself", "then Jamen met a Bociones among bocion again", "today Jamen met Jamen and Ulm and the Passes", "nothing has a name among these words"]
    documents = [(i, x, "en", "s", len(x)) for i, x in enumerate(said)]
    found = dict(same(spark, tmp_path, "o118_names", documents=(documents, "doc_id long, text string, lang string, source string, n_chars long")))
    assert sorted(found.values()) == [1, 2]
