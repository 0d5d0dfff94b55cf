import random

import pytest

WORDS = "the a of shore winter lamp grey turn river wheel candle stone under over quiet letter".split()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, a clashing extra column."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    base = text(120)
    near = " ".join(base.split()[:-2] + ["changed", "end"])
    rows = [
        (1, base, "en", "s1"), (2, base.upper(), "en", "s2"), (3, near, "en", None), (4, None, None, None), (5, "", "en", "s1"), (6, " \n\t ", "de", "s2"), (None, base, "en", "s1"),
        (7, "one two", "en", "s3"), (8, "One  two", "en", "s3"), (9, "three", "en", "s4"), (10, text(30_000), "de", "s1"), (10, text(5), "de", "s1"), (11, text(200), "fr", "s5"), (11, text(200), "fr", "s5"),
        (12, "x" * 200_000, "en", "s2"), (13, "tab\tsep\x0bvt\x0cff\x85nel nbsp words", "en", "s1"),
    ]
    rows += [(100 + i, text(rng.randrange(1, 60)) + f"\nshared boiler plate line\n{text(4)}", "en", f"s{i % 9}") for i in range(60)]
    rows.append(rows[0])
    return spark.createDataFrame([(*r, f"extra{i}") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, size string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, size string")
