"""Documents with every odd case, and helpers to run operators on them."""

from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"

#: Columns whose names operators use inside; they must go through untouched.
CLASHES = ["rest", "keys", "kept", "component_id", "label", "score", "bin", "p", "rate", "fp", "_gone"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{c}` string" for c in CLASHES
)


def _texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(40)
    line = "A line that is long enough, everywhere"
    texts = {
        0: base,
        1: base.replace(" ", "\t", 3),
        2: " ".join([*base.split()[:-2], "other", "end"]),
        3: "changed start " + base,
        4: None,
        5: "",
        6: " \n\t ",
        7: "three short words",
        8: "Three SHORT words",
        9: prose(50) + " " + passage + " " + prose(50),
        10: passage,
        11: prose(20) + " " + passage,
        12: f"{line}\n{prose(10)}\n  {line.upper()} \n\n{line}",
        13: f"{prose(5)}\n{line}",
        14: f"\t{line}\x0b\n{prose(6)}",
        15: "x" * 30_000,
        16: prose(30_000),
        17: "Ünïcödé ß 漢字 　 ￼ naïve don't <|endoftext|> a<|startoftext|>b \x1c ́ end " * 3,
        18: "\n".join([line] * 50),
        19: "!!! ### $$$ " * 40,
        20: base,
        21: passage + "\n" + passage,
    }
    return sorted(texts.items())


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs = ["en", "de", "fr", "es", None]
    rows = [
        (i, t, langs[i % 5], f"src{i % 3}" if i % 4 else None, len(t) if t is not None else None)
        + tuple(f"{c}{i}" if i % 2 else None for c in CLASHES)
        for i, t in texts
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i != 19 and i % 7 != 6), 0) for i in range(30)] + [(None, 1, None), (3, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    """A table of the smallest data folder."""
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


def by_id(df, *columns):
    """{first column: tuple of the other named columns}"""
    return {row[0]: tuple(row[c] for c in columns) for row in df.collect()}
