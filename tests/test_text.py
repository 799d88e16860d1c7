"""Scalar functions against input and expected pairs."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.functions import structured as st
from foliospark.functions import text as tx

CASES = {
    "parse_size": (tx.parse_size, [("20KB", 20480), ("20kb", 20480), ("1MB", 1048576), ("500B", 500), ("100", 100), ("", 0), ("invalid", None), ("1.5MB", None), ("1GB", None), ("-2K", -2048)]),
    "folder_name": (tx.folder_name, [("atividade.docx", "imagens atividade"), ("!!!.docx", "imagens doc"), ("Ação & Reação ß.docx", "imagens acao reacao"), ("a" * 60 + ".docx", "imagens " + "a" * 45), ("C:\\x\\Água.docx", "imagens agua")]),
    "card_label": (tx.card_label, [("10-cachorro-quente.webp", "Cachorro Quente"), ("01_banana.png", "Banana"), ("o'neil_USA.png", "O'Neil USA"), ("éclair.png", "Éclair"), ("straße-ß.png", "Straße ß")]),
    "strip_two_up": (tx.strip_two_up, [("x_2up_2up", "x"), ("teste_2UP", "teste"), ("a_2up b", "a_2up b")]),
    "path_key": (tx.path_key, [("Ficha – 1º  Ano.docx", "ficha - 1o ano.docx"), ("FICHA - 1o ano.docx", "ficha - 1o ano.docx")]),
    "obfuscate": (tx.obfuscate, [("12345678", "****"), ("sk-or-v1-abcdef", "sk-or-...cdef")]),
    "clean_lines": (tx.clean_lines, [("\t a \n\n  \n b\r\n", "a\nb"), ("", "")]),
    "html_escape": (tx.html_escape, [("<a href=\"x\">'&'", "&lt;a href=&#34;x&#34;&gt;&#39;&amp;&#39;")]),
    "format_whole": (lambda c: tx.format_whole(c.cast("double")), [("12.5", "12"), ("13.5", "14")]),
    "resilient_date": (
        tx.resilient_date,
        [("03/04/26", datetime.date(2026, 4, 3)), (" 03/04/2025 ", datetime.date(2025, 4, 3)), ("03/04", datetime.date(2026, 4, 3)), ("03/04/YY", datetime.date(2026, 4, 3)), ("29/02", datetime.date(2026, 3, 1)), ("01/01/75", datetime.date(1975, 1, 1)), ("31/02/26", None), ("x", None), ("3/3/26", None)],
    ),
    "strip_fences": (st.strip_fences, [("```json\n{}\n```", "{}"), (" {} ", "{}")]),
}


@pytest.mark.parametrize("name", CASES)
def test_pairs(spark, name):
    function, pairs = CASES[name]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string")
    got = [r[0] for r in df.orderBy("i").select(function(F.col("a"))).collect()]
    assert got == [b for _, b in pairs]


def test_slug(spark):
    rows = [(2, "Banana Prata", "02_banana_prata"), (10, "Cachorro & Gato", "10_cachorro__gato"), (5, "!!!", "05_item"), (100, "Água", "100_água")]
    df = spark.createDataFrame(rows, "n int, name string, want string")
    assert df.where(tx.slug(F.col("n"), F.col("name")) != F.col("want")).count() == 0


def test_natural_order(spark):
    names = ["img10.png", "img1.png", "img2.png", "img1_2.png", "img1_1.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(tx.natural_key(F.col("n"))).collect()] == ["img1.png", "img1_1.png", "img1_2.png", "img2.png", "img10.png"]


def test_saturation_and_clamp(spark):
    row = spark.range(1).select(tx.saturation(F.lit(255.0), F.lit(0.0), F.lit(0.0)), tx.saturation(F.lit(0.0), F.lit(0.0), F.lit(0.0)), tx.clamp(F.lit(300)), tx.clamp(F.lit(-3)), tx.ceil_div(F.lit(7), 6)).first()
    assert tuple(row) == (1.0, 0.0, 255, 0, 2)


def test_triage_verdict(spark):
    replies = ['{"should_colorize": true, "reason": "x"}', "Sure:\n```", '```json\n{"should_colorize": true}\n```', "{}", '{"should_colorize": "maybe"}', "none"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, r string").orderBy("i").select(st.triage_verdict(F.col("r")).alias("v")).select("v.*")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (True, "x", None) and got[2] == (True, "", None) and got[3] == (False, "", None)
    assert [g[2] for g in got] == [None, "no JSON object", None, None, "bad JSON", "no JSON object"]


def test_image_reference(spark):
    data = "data:image/webp;base64," + "QUJD" * 20
    cases = [(f"x {data} y", "data", data), ("see http://a/b.JPG.", "image_url", "http://a/b.JPG"), ("http://a/b now", "url", "http://a/b"), ("QUJD" * 30, "base64", "QUJD" * 30), ("short", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").orderBy("i").select(st.image_reference(F.col("t")).alias("r")).select("r.*")
    assert [tuple(r) for r in df.collect()] == [(c[1], c[2]) for c in cases]


def test_data_url(spark):
    row = spark.range(1).select(st.data_url(F.lit(b"a" * 100), F.lit("JPG"))).first()[0]
    assert row.startswith("data:image/jpeg;base64,") and "\n" not in row and len(row) == 23 + 136
