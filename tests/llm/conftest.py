import random

import pytest

from tabsmith.llm.common import column

WORDS = "the of and house river stone quick brown light über señor être 日本 a-b c.d 12 $5".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Documents at the edges: NULLs in every column, empty and long texts, repeats, ties."""
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    long_ = text(20_000)
    rows = [(i, text(r.randint(1, 60)), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "", None])) for i in range(40)]
    copy = rows[3][1]
    rows += [(40, None, "en", "s1"), (41, "", "en", "s1"), (42, " \t\n", None, None), (43, long_, "en", "s2"), (44, copy, "en", "s1")]
    rows += [(45, copy, "de", "s2"), (45, copy, "de", "s2"), (None, copy, None, "s1"), (None, "alone without id", None, None), (7, "another text of id seven", "en", "s3")]
    rows += [(46, "x" * 50_000, "en", "s1"), (47, "\x00  line\u0085end", "en", "s1"), (47, "\x00  line\u0085end", "en", "s1")]
    return rows


@pytest.fixture()
def frames(spark, odd_rows):
    """Make a documents frame from rows, with extra columns of clashing names."""

    def make(rows=odd_rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)
        for i, name in enumerate(["row", "digest", "rank", "size", "fp", "score", "key", "row_no", "n", "number", "print", "l0", "id", "win", "place", "row.x"]):
            df = df.selectExpr("*", f"{i} AS `{name}`")
        return df

    return make


def rows_of(df):
    return sorted(df.select(*[column(df, c) for c in df.columns]).collect(), key=str)
