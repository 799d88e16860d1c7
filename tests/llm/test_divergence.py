"""The source audit against a direct computation with exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from foliospark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, lang string, source string"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, groups = [(Counter(TERM.findall((t or "").translate(lower))), lang or "", source or "") for _, t, lang, source in rows], defaultdict(Counter)
    found = defaultdict(Counter)
    for words, lang, source in docs:
        found[lang].update(set(words))
        groups[lang, source].update(words)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for w, n in found[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]

        def rates(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: rates(groups[lang, s]) for s in sources}
        q = rates(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if groups[lang, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "é", "ß", "日本", "Zz"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, "o'x"])
        source = rng.choice(["a", "b", "c", None, f"s{rng.randrange(6)}"])
        text = " ".join(rng.choice(words[: rng.randrange(5, 205)]) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice([text, text, text.upper(), text + "1two,THREE_x"]), lang, source))
    return [*rows, (None, None, "en", "a"), (1, "", "lone", "only"), (2, "few words", "thin", "a"), (2, "few words", "thin", "b"), rows[0], rows[0], (7, "w" * 100_000 + " wa" * 50_000, "en", "long")]


@pytest.mark.parametrize(("least", "top"), [(1, 3), (5, 50), (400, 5)])
def test_audit_against_brute_force(spark, least, top):
    rows = rows_of(400)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", term string, value int")
    out = divergence.audit_sources(df, least, top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect())) == brute(rows, least, top)


def test_blocks_of_sources(spark, monkeypatch):
    rows = [(i, f"common w{chr(97 + i % 7)} w{chr(97 + i % 11)}", "en", f"s{i % 40:02}") for i in range(400)]
    df = spark.createDataFrame(rows, KIND)
    want = brute(rows, 2, 4)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 7)
    assert sorted(map(tuple, divergence.audit_sources(df, 2, 4).collect())) == want


def test_no_documents(spark):
    assert divergence.audit_sources(spark.createDataFrame([], KIND)).count() == 0


def test_sql_of_the_query(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in rows_of(900) if r[0] != 7]
    df = spark.createDataFrame(rows, KIND)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, divergence.op13_source_divergence(spark, f"file://{tmp_path}").collect()))
    assert got == sorted(con.execute(divergence.SQL).fetchall()) and {r[2] for r in got} == {"pair", "term"}
