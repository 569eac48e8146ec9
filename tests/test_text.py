import pytest
from pyspark.sql import functions as F

from folioscope.functions import identifiers as ids, markup as md, text as tx
from folioscope.functions.dates import parse_at, parse_date, week_of


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [
    ("注意力机制", ["注意", "意力", "力机", "机制"]), ("用a的", ["用", "a", "的"]), ("Graph 图网 x", ["graph", "图网", "x"]), ("Éa-B2, c", ["ea", "b2", "c"]), ("", [])])
def test_search_tokens(spark, given, wanted):
    assert value(spark, tx.search_tokens(F.lit(given))) == wanted


@pytest.mark.parametrize("given, wanted", [("Hello_World  Foo!", "hello-world-foo"), ("Néel Order — 图", "néel-order-图"), ("--a--b--", "a-b")])
def test_slug(spark, given, wanted):
    assert value(spark, tx.slug(F.lit(given))) == wanted


def test_slug_cut_on_a_word(spark):
    long = " ".join(["word"] * 30)
    got = value(spark, tx.slug(F.lit(long)))
    assert len(got) <= 80 and got.endswith("word") and value(spark, tx.slug(F.lit("x" * 120))) == "x" * 80


@pytest.mark.parametrize("given, wanted", [("ﬁne‐grain", "fine‐grain"), ("soft­hyphen", "softhyphen"), ("line-\nbreak", "linebreak"), ("“Quo’te”", '"quo\'te"'), ("图 像，和", "图像,和"), ("STRASSE straße", "strassestrasse")])
def test_loose(given, wanted):
    assert tx.loose_text(given) == wanted.replace("‐", "‐")


@pytest.mark.parametrize("given, wanted", [
    ("arXiv:2405.00208v3", "2405.00208"), ("COND-MAT/0506438", "cond-mat/0506438"), ("math.ag/0601001", "math.AG/0601001"), ("figures/1234567", None),
    ("https://arxiv.org/pdf/2301.00001v1.pdf", "2301.00001"), ("12345.67", None)])
def test_arxiv_id(spark, given, wanted):
    assert value(spark, ids.normalize_arxiv_id(F.lit(given))) == wanted


def test_titles(spark):
    assert value(spark, ids.titles_match(F.lit("Fractons"), F.lit("fractons!")))
    assert not value(spark, ids.titles_match(F.lit("Toric code order"), F.lit("Quantum Hall effect")))
    assert value(spark, ids.titles_match(F.lit(None).cast("string"), F.lit("x")))
    assert value(spark, ids.clean_title(F.lit("[2401.00506v2] A Paper | arXiv.org"))) == "A Paper"
    assert value(spark, ids.clean_title(F.lit(" [2401.00506] "))) == "[2401.00506]"


@pytest.mark.parametrize("given, wanted", [("a/b/../c.md", "a/c.md"), ("./x", "x"), ("../../up", "../../up"), ("/root/x", "root/x"), ("", "")])
def test_resolve_relative(spark, given, wanted):
    assert value(spark, md.resolve_relative(F.lit(""), F.lit(given))) == wanted


def test_front_matter_and_links(spark):
    got = value(spark, md.split_front_matter(F.lit("---\ntitle: x\n---\nbody [[A|b]]\n")))
    assert (got["front"], got["body"]) == ("title: x\n", "body [[A|b]]\n")
    assert value(spark, md.split_front_matter(F.lit("no fence")))["body"] == "no fence"
    assert value(spark, md.body_of(F.lit("---\na: 1\n---\nrest"))) == "\nrest"
    assert value(spark, md.markdown_links(F.lit("[a](<x y.md>) [b](z.md#t)"))) == ["x y.md", "z.md#t"]


def test_times(spark):
    assert str(value(spark, parse_at(F.lit("2026-02-03T04:05:06Z")))) == "2026-02-03 04:05:06"
    assert str(value(spark, parse_at(F.lit("1700000000")))) == str(value(spark, parse_at(F.lit("1700000000000"))))
    assert value(spark, parse_at(F.lit("soon"))) is None
    assert value(spark, week_of(F.to_timestamp(F.lit("2027-01-03")))) == "2026-W53"
    assert value(spark, parse_date(F.lit("2026-13-01"))) is None
