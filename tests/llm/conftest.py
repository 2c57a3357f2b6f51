import random

import pytest

#: Values of columns whose names the operators use themselves.
MORE = (7, "c", 7, 7, "b", 7, "b", "r")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key long, n int, rest string, _keep long, _row string, w long, id long, body string, shard int, best string, row string"


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeats, passages of all lengths around the limits."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghéßñ") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(90), "Some Shared Line of text"
    long = "\n".join(prose(40) for _ in range(120))
    texts = [
        None, "", " \n\t ", "one", "one two", "One  TWO", "a b c", "\n\n", line, f"  {line.upper()}\t", f"{line}\n{line}\nx", "short\nshort",
        long, long, long[:-1] + "!", long[500:3000] + "é" + long[2600:3500], shared, f"{prose(30)} {shared} {prose(20)}", f"{shared}\n{shared}", "x" * 399, "x" * 400, "y" * 401, "z" * 1500,
        "\x00nul\x00", "日本語のテキスト" * 30, "1" * 3000, "🙂" * 200, shared + ".", prose(200), "ÀÉ " * 40,
    ]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), None if t is None else len(t), "s", i, 1, "r", *MORE) for i, t in enumerate(texts)]
    rows += [rows[12], rows[9], (None, line, *[None] * 15), (None, long, "en", "a", 1, None, 0, 0, "", *MORE)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_pairs():
    return [(x[0], x[1]) for x in odd_rows()]
