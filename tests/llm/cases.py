"""Small tables of awkward rows, and plain versions of shared definitions."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "the quick brown fox jumps over the lazy dog and runs far away from here. "


def table(spark, texts, start=0):
    """Rows for the texts; ids count up from ``start``."""
    return spark.createDataFrame([(start + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


AWKWARD = [
    None, "", " ", "\n\n\t", "a", "one two three four", "x" * 5000, "word " * 3000,
    LINE * 3, LINE * 3, (LINE + "\n") * 6, "É à ü ñ ß € 𝄞 漢字 " * 30, "### $$$ *** " * 20 + LINE,
    " ".join(f"w{i}" for i in range(20000)), "tab\tand\x0bother\x0c spaces\r\n here. " * 4, " no break space   em " * 9,
]


def awkward(spark):
    """Nulls in every column, repeated rows, ties, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 2}", i) for i, t in enumerate(AWKWARD)]
    rows += [(100, LINE, "en", None, None), (100, LINE, "en", None, None), (None, "no id here " * 8, None, None, None), (101, LINE, "de", "src0", 5)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same rows with extra columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    names = "size slot shard digest norm best arrived words lines votes kept quality salt count n h bucket rank base class_id rate copies key part band copy mix_key node word bits seq row_key of_key row_doc_id of_doc_id of_source of_copies __leader __text_sha256 __rate __source __key __copies".split()
    return df.select("*", *(F.lit("clash").alias(n) for n in names))
