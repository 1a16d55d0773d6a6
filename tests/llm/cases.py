"""Rows that every text operator must take: nulls, empty and long texts, ties, repeated rows."""

import random

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and token river mountain secret banana école straße niño 12 x y z quick brown fox".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(words))


def rows():
    long = prose(1, 20_000)
    texts = [
        (1, prose(2, 60), "en", "a"), (2, prose(2, 60), "en", "a"), (3, None, None, None), (4, "", "en", None), (5, "   \n\t ", None, "b"),
        (6, "one", "en", "b"), (7, "One TWO", "fr", "b"), (8, long, "en", "c"), (9, long + " tail", "en", "c"), (None, prose(3, 30), "en", "c"),
        (None, None, None, None), (10, "x" * 50_000, "en", "d"), (11, "1234 !!! ???", None, "d"), (12, "日本語 テキスト 😀", "ja", "d"), (1, prose(2, 60), "en", "a"),
        (13, prose(2, 59) + " other", "en", "e"), (14, "a\x00b ▁ c", "en", "e"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """With columns whose names operators use for their own."""
    from pyspark.sql import functions as F

    names = "score ids begins ends decoded hits spans statistics lang_pred key node region held_out n_tokens".split()
    return df.withColumns({n: F.lit("mine") for n in names})


def table(sf, name):
    return duckdb.connect().execute(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


def same(spark, query, sql, sf):
    """Rows of a registered query beside those of its SQL."""
    import check

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canonical(got) == check.canonical(want)
    return got
