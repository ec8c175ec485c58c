import pytest

#: Extra columns named like those that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, k1 long, _text string, score double, kept boolean, component_id long, _doc string, _size long, draws string, _id long, end string, start string"
EXTRA = (7, 7, 7, "x", 0.5, True, 7, "d", 7, "d", 7, "e", "s")

BASE = " ".join(f"word{i} then thing{i * 7 % 13} and more" for i in range(60)) + "."
#: A passage of more than 200 bytes that several documents share.
PASSAGE = "The quick brown fox jumps over the lazy dog while nineteen careful librarians, counting every page twice, copy the ledger of the northern lighthouse into a new volume bound in green leather and locked with brass clasps for the winter."


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text, source) with clashing extra columns."""
        return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, *EXTRA) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    return [
        (1, BASE, "a"),
        (2, BASE.upper(), "a"),
        (3, BASE.replace("word5 ", "word five "), "b"),
        (4, None, "b"),
        (5, "", None),
        (6, " \t\n ", "a"),
        (7, PASSAGE + " alpha", "a"),
        (8, "Beta " + PASSAGE, None),
        (8, "Beta " + PASSAGE, None),
        (8, "another text under the same id", "b"),
        (None, "a text without an id", "a"),
        (None, None, None),
        (9, "Mail bob.smith@mail.example.org or +1 (555) 010-2345, card 4111 1111 1111 1111, host 10.0.0.255.", "c"),
        (10, "lang " * 40_000, "c"),
        (11, "naïve café — “quoted” 日本語 😀 <|endoftext|> don't", "c"),
        (12, BASE, "a"),
    ]
