import pytest
from pyspark.sql import functions as F

from bindery.functions import digests as D, identifiers as I, text as X


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


@pytest.mark.parametrize(
    ("left", "right"),
    [
        ("  Café\t:  A Tale​  ", "CAFÉ:A TALE"), ("A _ B", "A_B"), ("A - B", "A-B"), ("A ( B )", "A(B)"), ("A ; B", "A;B"), ("Book ? !", "BOOK?!"), ("Unknown", "UNKNOWN"),
        ("   ", None), ("​‎", None), ("", None), (None, None), ("straße", "STRAßE"), ("  the  book:a tale", "THE BOOK:A TALE"), ("The Book : A Tale", "THE BOOK:A TALE"),
    ],
)
def test_canonical(spark, left, right):
    assert one(spark, X.canonical(F.col("t")), t=left) == right


@pytest.mark.parametrize(
    ("a", "b"),
    [("The Book: A Tale", "The Book"), ("J. R. R. Tolkien", "J R R Tolkien"), ("J. R. R. Tolkien", "JRR Tolkien"), ("Doe, Jane", "Jane Doe"), ("Book-One", "Book—One"), ("The Book", "Book"), ("Book (Second Edition)", "Book"), ("Book [Illustrated]", "Book")],
)
def test_canonical_keeps_apart(spark, a, b):
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(X.canonical(F.col("a")), X.canonical(F.col("b"))).first()
    assert rows[0] != rows[1]


@pytest.mark.parametrize(("value", "usable"), [("Unknown", False), (" n/a ", False), ("?", False), ("", False), (None, False), ("Anonymous", True), ("é", True)])
def test_usable(spark, value, usable):
    assert one(spark, X.usable(F.col("t")), t=value) is usable


@pytest.mark.parametrize(("title", "found"), [("An Unabridged Tale", "ABRIDGED|UNABRIDGED"), ("Tale, 2nd edition revised", "2ND EDITION|REVISED"), ("Tale (Second Edition)", "SECOND EDITION"), ("Tale", None), (None, None)])
def test_edition(spark, title, found):
    assert one(spark, X.edition(F.col("t")), t=title) == found


@pytest.mark.parametrize(("path", "safe"), [("a/b", True), ("", False), (None, False), ("/a", False), ("\\a", False), ("c:x", False), ("a/../b", False), ("a\\..\\b", False), ("a/..b", True)])
def test_safe_path(spark, path, safe):
    assert one(spark, X.safe_path(F.col("t")), t=path) is safe


@pytest.mark.parametrize(
    ("kind", "value", "found"),
    [
        ("isbn", "978-0-306-40615-7", "ISBN:9780306406157"), ("ISBN10", "0-306-40615-2", "ISBN:0306406152"), ("isbn", "080442957x", "ISBN:080442957X"), ("isbn", "0306406153", None), ("isbn", "X306406152", None), ("isbn", "9780306406158", None),
        ("doi", " https://doi.org/10.1/ab ", "DOI:10.1/AB"), ("doi", "doi: 10.1/x", "DOI:10.1/X"), ("doi", "10.1x", None), ("doi", "10.1/a b", None), ("Amazon", "b00000000a", "ASIN:B00000000A"), ("asin", "short", None),
        ("worldcat", "ocm00012", "OCLC:12"), ("OCLC", "OCLC: 000", "OCLC:0"), ("oclc", "12x", None), ("other", "1", None), (None, "1", None), ("isbn", None, None),
    ],
)
def test_strong_identifiers(spark, kind, value, found):
    assert one(spark, I.strong(F.col("k"), F.col("v")), k=kind, v=value) == found


def test_isbn_variants_differ(spark):
    loose = [v for v in ("X000000018", "0306406152X") if one(spark, I.isbn(F.col("t"), strict=False), t=v)]
    assert loose and not any(one(spark, I.isbn(F.col("t")), t=v) for v in loose)


def test_frames_count_in_their_units(spark):
    assert one(spark, D.field16(F.col("t")), t="é😀") == "3:é😀;"
    assert one(spark, D.field8(F.col("t")), t="é😀") == "V6:é😀;"
    assert [one(spark, f(F.col("t")), t=None) for f in (D.field16, D.field8)] == ["0:;", "N;"]


def test_group_ids(spark):
    found = one(spark, D.metadata_group_id(F.col("t"), F.array(F.lit("É"), F.lit("B"))), t="A")
    assert found == "exact-metadata:v1|title|1:A|authors|2|2:É|1:B"
    assert one(spark, D.binary_group_id(F.lit(5).cast("long"), F.col("t")), t="AB") == "sha256:ab:5"


def test_fold_is_order_free(spark):
    rows = [(1, i, f"v{i}") for i in range(50)]
    out = {spark.createDataFrame(r, "g int, i int, t string").repartition(n).groupBy("g").agg(D.fold(["i"], F.col("t")).alias("d")).first().d for r, n in ((rows, 1), (rows[::-1], 7))}
    assert len(out) == 1
