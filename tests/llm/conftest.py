import os
import sys

import pytest
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
if HERE not in sys.path:
    sys.path.insert(0, HERE)

_WORDS = "the of and river stone Night 42 über naïve light; a. walk, see (far) home ran тест 日本 x".split()


def _prose(n: int, seed: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(_WORDS[x >> 8 & 15] + (str(x >> 12 & 255) if x >> 20 & 1 else ""))
    return " ".join(out)


def sample_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, copies, near copies, shared passages, runs, repeated rows."""
    base, passage = _prose(120, 1), _prose(30, 2)
    near = [" ".join(w if k != cut else "changed" for k, w in enumerate(base.split())) for cut in (10, 60, 100)]
    rows = [
        (1, base), (2, base), (3, near[0]), (4, near[1]), (5, near[2]), (6, None), (7, ""), (8, " \t\n "), (9, "...!!! ,"),
        (10, _prose(40, 3) + " " + passage + " " + _prose(40, 4)), (11, passage), (12, passage + "\n" + _prose(20, 5)),
        (13, "a " * 200), (14, "b a " * 40 + "a " * 30), (15, _prose(30_000, 6)), (16, _prose(3, 7)), (17, _prose(3, 7)),
        (18, "word"), (19, "z" * 100_000), (20, _prose(90, 8)), (20, _prose(90, 8)), (None, base), (None, None),
        (21, "\x00nul \x01 words \x7f of\x0bcontrol\x0ccharacters " + passage), (22, base.upper()), (23, "  " + base + "\n"), (-5, _prose(15, 9) + " " + _prose(90, 8)),
    ]
    return rows + [(100 + k, _prose(60 + k, 30 + k % 7) + " " + passage) for k in range(20)]


CLASHING = ["id", "g", "key", "codes", "code", "_k0", "_text", "_n", "size", "shard", "rank", "copies", "bucket", "target"]


@pytest.fixture(scope="session")
def samples():
    return sample_texts()


@pytest.fixture(scope="session")
def sample_docs(spark, samples):
    """The samples as documents with a source, and columns whose names clash with inner ones."""
    rows = [(i, t, [None, "b", "a", "ü"][k % 4] if k % 9 else "a", "xx") for k, (i, t) in enumerate(samples)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHING]).repartition(5)


@pytest.fixture(scope="session")
def no_docs(sample_docs):
    return sample_docs.filter("false")
