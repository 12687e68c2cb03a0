import pytest

#: A column of each name that an operator could take for its own.
CLASHING = ("row", "n", "id", "key", "cid", "h1", "slot", "pos", "block", "grp", "host", "words", "lines", "bucket", "rank_key", "label", "gone", "version", "size", "item", "doc", "_keep", "_leak", "hot", "side")


@pytest.fixture()
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source) rows; ``extra`` adds clashing columns."""

    def make(rows, extra=False):
        rows = [(*r, "src0", "en")[:2] + ((r[2] if len(r) > 2 else "src0"), "en", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
        if extra:
            df = df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])
        return df

    return make


#: Nulls, empty and odd texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "\n\n \t\n"), (5, "x"), (6, "é ü ß 漢字 " * 3), (7, "\x00 \u2028 \x85"), (None, None)]


@pytest.fixture()
def odd():
    return list(ODD)
