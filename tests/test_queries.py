"""Every registered query of the library against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from larder import queries as library

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    number = lambda x: str(int(x)) if x.is_integer() else f"{x:.6g}"  # noqa: E731  (whole numbers in full: pandas makes nullable ones floats)
    return sorted(tuple("NULL" if pd.isna(x) else number(x) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(library.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, wanted = library.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(library.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry_ranks_by_score(spark):
    best = library.entry(spark, FOLDER).toPandas().sort_values(["query_id", "rank"])
    assert len(best) and (best.groupby("query_id")["score"].diff().dropna() <= 0).all()


def test_tokens_of_texts_without_words(spark, duck, tmp_path):
    texts = [(1, "One two"), (2, ""), (3, None), (4, "?! ..."), (5, "\u00e9t\u00e9"), (6, "\u2026")]
    spark.createDataFrame([(i, t, "s", "en", len(t or "")) for i, t in texts], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = library.QUERIES["d3_tokenize"](spark, str(tmp_path)).toPandas()
    wanted = duck.execute(library.ORACLES["d3_tokenize"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).df()
    assert rows(found) == rows(wanted)
