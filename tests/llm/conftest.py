import pytest

#: Whole texts that every operator must take: null, empty, white space, copies, ties, long, other scripts, special strings.
LONG = " ".join(f"word{i % 97}" for i in range(6000))
TEXTS = [
    None,
    "",
    " \t\n",
    "The same text, twice.",
    "The same text, twice.",
    "the SAME text, twice.",
    LONG,
    LONG + " tail",
    "x" * 30_000,
    "日本語のテキスト と é́ and İ <|endoftext|> 's don't",
    "a  b   c \n\n d\x1ce",
    "MIT license, CC-BY; GNU General Public License v2",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long, part int, label long, answers string"


def _rows(texts):
    return [(i, t, None if i % 4 == 0 else "en", "s", None, "clash", 1, 2, 3, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def messy(spark):
    """All TEXTS, extra columns whose names operators use themselves, and a row that repeats."""
    rows = _rows(TEXTS)
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
