"""Every corpus query with SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from ringside.llm import queries

from ..test_oracle import plain


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, small, duck, name):
    ours = queries.queries()[name](spark, small).toPandas()
    theirs = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


#: SQL of the columns that SQL can express, of queries that are trained in others: query to columns and SQL.
PLAIN = {
    "op1_sharding": (["doc_id", "size"], "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents"),
    "op2_mixing": (["doc_id", "size", "source_size"], r"WITH told AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents) SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM told"),
    "op6_secrets": (
        ["doc_id", "n_assign", "n_access", "n_hex"],
        r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents""",
    ),
    "op7_quality": (
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        r"""WITH told AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
line AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM told),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line GROUP BY doc_id),
place AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS k FROM told),
win AS (SELECT doc_id, k, concat_ws(' ', words[k], words[k + 1], words[k + 2]) AS w FROM place),
hot AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, k FROM hot UNION ALL SELECT doc_id, k + 1 FROM hot UNION ALL SELECT doc_id, k + 2 FROM hot) GROUP BY doc_id)
SELECT t.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
FROM told t LEFT JOIN dup d ON d.doc_id = t.doc_id LEFT JOIN rep r ON r.doc_id = t.doc_id""",
    ),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_plain_columns(spark, small, duck, name):
    columns, sql = PLAIN[name]
    ours = queries.queries()[name](spark, small).select(*columns).toPandas()
    theirs = duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
