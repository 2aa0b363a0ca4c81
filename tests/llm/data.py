"""Small inputs for the training-data operators."""

from __future__ import annotations

import random

import duckdb

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOC_FIELDS = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [None, "", " ", "\n\t", "a", "a b", "É", "日本語 \U0001f600 x", "▁x ▁▁ y", "##### </turn> \\",
             "nul \x00 in", "x" * 50_000, "word " * 20_000, "a  b   c", "line\r\nend\v\f"]


def docs(spark, texts, first=0, lang="en"):
    """Documents of the texts, ids from ``first`` on."""
    rows = [(first + i, t, lang, "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_FIELDS)


def given(name: str, columns: str, where: str = "true") -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' WHERE {where} "
                      f"ORDER BY ALL").fetchall()


def invented(n: int, seed: int = 3, least: int = 20, most: int = 80) -> list[str]:
    """Texts of random words."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(3000)]
    return [" ".join(r.choices(words, k=r.randint(least, most))) for _ in range(n)]
