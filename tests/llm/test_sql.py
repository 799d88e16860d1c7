"""The SQL of the registered queries on hand-made documents: every licence template, alone and changed, and odd rows."""

import random

import pytest

from foliospark.llm import licences, queries

duckdb = pytest.importorskip("duckdb")


def licence_texts():
    rng = random.Random(2)
    texts = [None, "", "no notice here", "Licensed.\n\nReleased under the MIT License.\nmore"]
    for _, notice in licences.all_templates():
        words = notice.split()
        texts += [notice, f"Title\n{notice}\nbody", "\n".join([" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]), notice.upper()]
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts.append("\n\n".join(t for _, t in licences.all_templates()[:6]))
    return texts


def run(spark, tmp_path, name, rows, benchmark):
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    got = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(str(tuple(r)) for r in result.fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want
    return want


def test_licences(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(licence_texts())]
    want = run(spark, tmp_path, "op10_licence_dice", rows, [(1, "x")])
    assert len({r.split(", ")[3] for r in want}) >= 25


@pytest.mark.parametrize("name", ["op5_wu_manber", "op8_size_aware_jaccard", "op12_setsketch_near_dedup", "op13_source_divergence"])
def test_documents(spark, tmp_path, name):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "d", "é", "x1", "the"]) + str(rng.randrange(40)) * (rng.random() < 0.7) for _ in range(n))
    items = [(i, words(rng.choice([3, 12, 30]))) for i in range(20)] + [(100, None), (101, "")]
    rows = [(0, None, None, None), (1, "", "en", ""), (2, " \n", "en", "a")]
    for i in range(3, 120):
        text = words(rng.randrange(1, 200))
        if i % 6 == 0:
            text = f"{text} {rng.choice(items[:20])[1]} tail"
        rows.append((i, text if i % 5 else rows[-1][1], rng.choice(["en", "de"]), rng.choice("abc")))
    assert run(spark, tmp_path, name, rows, items)
