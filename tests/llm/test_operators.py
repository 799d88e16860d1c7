"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import components, decontaminate, jaccard, licences, media, packing, pages, sharding, suffixes, token_files, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def odd_docs(rng):
    base = words(rng, 300)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, base), (4, base), (5, base), (6, base + " tail"), (7, "one"), (8, "One"), (None, base), (None, None), (9, words(rng, 20000, 5000)), (10, "é" * 500), (11, "a" * 700)]
    return rows


# --- pages ------------------------------------------------------------------------------------------------------------------------

PAGE = '<html><head><title>T</title></head><body><header>Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div><article><h1>H {n}</h1><p>One &amp; {n}<br>two  <b>three</b>.</article><aside>side</aside><div id="comments"><p>reader</p></div><form>f</form><script>x</script><footer>f {n}</footer>'
OPEN = "<html><body><div>Menu</div><div>Welcome</div><p>Text {n} only here</p><p>More {n}</p><div>All rights</div></body></html>"


def test_pages(spark):
    rows = [(1, "http://a/x/1", PAGE.format(n=1)), (2, "http://a/x/2", PAGE.format(n=2)), (3, "http://b/1", OPEN.format(n=1)), (4, "http://b/2", OPEN.format(n=2)), (5, None, None), (6, "", ""), (7, "http://c/only", OPEN.format(n=7)), (None, "http://b/3", OPEN.format(n=3)), (4, "http://b/2", OPEN.format(n=2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "host": F.lit("h"), "part": F.lit(1)})
    out = pages.extract_main_text(df)
    assert out.columns == ["page_id", "url", "html", "host", "part", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect())
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    texts = {i: t for i, t, _ in got}
    assert texts[1] == "H 1 One & 1 two three." and texts[3] == "Text 1 only here More 1" and texts[0] == "Text 3 only here More 3"
    assert texts[5] == texts[6] == "" and texts[7] == "Menu Welcome Text 7 only here More 7 All rights"
    assert [t for i, t, _ in got if i == 4] == ["Text 2 only here More 2"] * 2
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_page_copies_keep_their_text(spark):
    body = lambda n: f"Text {n} only here More {n}"
    rows = [(1, "http://b/1", OPEN.format(n=1)), (2, "http://b/2", OPEN.format(n=2)), (2, "http://b/2", OPEN.format(n=2)), (3, "http://b/2?again", OPEN.format(n=2)), (4, "http://b/3", OPEN.format(n=2).replace("<body>", "<body><header>Tuesday</header>")), (5, "http://b/4", OPEN.format(n=5))]
    rows += [(i, f"http://m/{i:03}", OPEN.format(n=7)) for i in range(100, 160)] + [(160, "http://m/9", OPEN.format(n=8))]  # copies over several parts
    rows += [(200, "http://only/1", OPEN.format(n=9)), (201, "http://only/2", OPEN.format(n=9))]
    rows += [(300, "http://p/1", OPEN.format(n=3).replace("<div>All", "<div>More of it</div><div>All")), (301, "http://p/2", OPEN.format(n=3)), (302, "http://p/3", OPEN.format(n=4))]  # 300 has all of 301's lines
    rows += [(400, "http://q/a/9", "<p>Menu A</p><p>a9</p>"), (401, "http://q/b/1", "<p>Menu B</p><p>b1</p>"), (402, "http://q/b/2", "<p>Menu B</p><p>b2</p>")]
    rows += [(500, "http://r/1", OPEN.format(n=1)), (500, "http://r/1", "<p>Text first</p><p>Menu</p>"), (501, "http://r/2", OPEN.format(n=2))]
    out = pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and {r.text for r in out if r.page_id == 2} == {body(2)}
    assert texts[1] == body(1) and texts[3] == texts[4] == body(2) and texts[5] == body(5)
    assert {texts[i] for i in range(100, 160)} == {body(7)} and texts[160] == body(8)
    assert texts[200] == texts[201] == f"Menu Welcome {body(9)} All rights"
    assert texts[301] == body(3)
    assert texts[401] == "b1" and texts[402] == "b2"  # nearer to the next page than to the directory before
    assert {r.text for r in out if r.page_id == 500} == {f"Welcome {body(1)} All rights", "Text first"}  # a later crawl is the nearest; each has its own lines


def test_page_lines():
    assert pages.page_lines("<p>a<p>b <i>c</i>d<br/>e&nbsp;f<td>") == [(0, "a"), (0, "b cd"), (0, "e f")]
    assert pages.page_lines("<main><div class='ad'>x</div>y</main>z") == [(2, "x"), (1, "y"), (0, "z")]
    assert pages.page_lines("<div>" * 3000 + "deep") == [(0, "deep")]
    assert pages.page_lines("text only &lt;") == [(0, "text only <")]


def test_roles_of_wrappers():
    roles = lambda html: pages.page_lines(html)
    for name in ("wrap no-sidebar", "content has-sidebar", "page-with-header", "side-by-side", "related-content", "left_sidebar_layout"):
        assert roles(f"<div class='{name}'><p>x</p></div>") == [(0, "x")]
        assert roles(f"<div id='{name}'><article>x</article></div>") == [(1, "x")]
    for name in ("sidebar", "big header", "cookie-notice", "ad_slot", "site-footer", "social-links", "comments", "comment-list"):
        assert roles(f"<div class='{name}'><p>x</p></div>y") == [(2, "x"), (0, "y")]
    assert roles("<div class='header'><div><main>x<div class='ad'>a</div></main></div>b</div>") == [(1, "x"), (2, "a"), (2, "b")]
    assert roles("<div class='widget'><article>x<aside>a<article>t</article></aside></article></div>") == [(1, "x"), (2, "a"), (2, "t")]
    assert roles("<div class='sidebar'><article>teaser</article></div><main>the whole body</main>") == [(2, "teaser"), (1, "the whole body")]
    assert roles("<article>x<div id='comments'><article>c</article></div><div class='related'><article>r</article></div></article>") == [(1, "x"), (2, "c"), (2, "r")]
    assert roles("<main><h1>t</h1><div class='widget'><article>the whole body</article></div></main>") == [(1, "t"), (1, "the whole body")]
    assert roles("<div id='comments'><article>c</article></div>y") == [(2, "c"), (0, "y")]
    assert roles("<body><form action='/x.aspx'><nav>n</nav><h1>t</h1><p>x<button>Go</button></form>") == [(2, "n"), (0, "t"), (0, "x"), (2, "Go")]
    assert roles("<form><article>x</article>o</form>") == [(1, "x"), (0, "o")]
    assert roles("<main><h1>t</h1><form><p>the whole body</p></form></main>") == [(1, "t"), (1, "the whole body")]
    assert roles("<main><p>the whole body</p><form>Mail</form></main>") == [(1, "the whole body"), (2, "Mail")]


@pytest.mark.parametrize("bits", [1 << 27, 30])
def test_shared_lines(monkeypatch, bits):
    monkeypatch.setattr(pages, "ALIGN_BITS", bits)  # few: pages are halved
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        shared = sorted(pages.shared_lines(a, b))
        assert len(shared) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in shared)


def brute_text(page, rows):
    """The page's text by the docstring's rules: nearest page of other open lines in (host, path, page_id) order, longest alignment."""
    def place(r):
        bare = re.sub(r"^[a-z]+://", "", r[1] or "")
        host = re.match("[^/?#]*", bare).group().lower()
        return host, bare[len(host) :].split("#")[0], r[0]

    lines = {id(r): pages.page_lines(r[2]) for r in rows}
    opens = lambda r: [t for role, t in lines[id(r)] if role == 0]
    order = sorted(rows, key=place)
    at = next(i for i, r in enumerate(order) if r is page)
    sides = []
    for step in (-1, 1):
        near = [r for r in (order[at + 1 :] if step > 0 else order[:at][::-1]) if place(r)[0] == place(page)[0] and opens(r) != opens(page)]
        sides.append(near[0] if near else None)
    shared = lambda a, b: len(__import__("os").path.commonprefix((place(a)[1], place(b)[1])))
    if sides[0] is None or (sides[1] and shared(page, sides[1]) > shared(page, sides[0])):
        sides.reverse()
    own, gone = opens(page), set()
    for other in sides:
        if other is not None and (not gone or len(gone) == len(own)):
            table = {}

            def length(i, j, b, table=table):
                if (i, j) not in table:
                    table[i, j] = 0 if i == len(own) or j == len(b) else 1 + length(i + 1, j + 1, b) if own[i] == b[j] else max(length(i + 1, j, b), length(i, j + 1, b))
                return table[i, j]

            i = j = 0
            b, gone = [t for _, t in lines[id(other)]], set()
            while i < len(own) and j < len(b):
                if own[i] == b[j]:
                    gone.add(i)
                    i, j = i + 1, j + 1
                elif length(i + 1, j, b) >= length(i, j + 1, b):
                    i += 1
                else:
                    j += 1
    declared = any(role == 1 for role, _ in lines[id(page)])
    number, kept = -1, []
    for role, t in lines[id(page)]:
        number += role == 0
        if role == 1 or (role == 0 and not declared and number not in gone):
            kept.append(t)
    return " ".join(kept)


def test_extraction_equals_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(90):
        host = f"http://h{i % 4}.x"
        lines = [f"{host} menu", *rng.sample([f"block {k}" for k in range(3)], 2), *(f"own {i} {k}" for k in range(rng.randrange(4))), f"{host} foot"]
        body = "".join(f"<div>{x}</div>" for x in lines)
        if rng.random() < 0.3:
            body = f"<nav>n{i}</nav><article><p>part {i % 7}</p>{body}</article><p>beside</p>"
        rows.append((i, f"{host}/{rng.choice('ab')}/{i:03}", f"<body>{body}"))
    rows += [(1000 + k, f"{u}?copy", h) for k, (_, u, h) in enumerate(rng.sample(rows, 12))]
    rows += [(2000, "http://h9.x/1", "<body>" + "<p>same</p>" * 20_000 + "<p>one</p>"), (2001, "http://h9.x/2", "<body>" + "<p>same</p>" * 19_000 + "<p>two</p>")]
    out = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(out[r[0]] == brute_text(r, rows) for r in rows if r[0] < 2000)
    assert out[2000].endswith("one") and out[2000].count("same") == 1000 and out[2001] == "two"


# --- tokens, packing --------------------------------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_tokens_equal_the_library():
    encode, ours = library(), tokens.WordTokens(TOKENIZER)
    rng = random.Random(2)
    pool = [chr(c) for c in (*range(0x300), 0x3A3, 0x3C2, 0x5D0, 0x4E2D, 0xAC00, 0x1F600, 0xFB01, 0x2009)] + ["'s", "'RE", "<|endoftext|>", "é"]
    texts = ["".join(rng.choice(pool) for _ in range(60)) for _ in range(300)] + ["", "It's  THE\tend\n"]
    assert ours.split is not None
    assert [x.tolist() for x in ours.encode(texts)] == [encode(t) for t in texts]


def test_latin_texts_are_split_at_once():
    """The words of Latin-1 texts equal the pattern's, contractions and all, without a pass of the regular expression over each text."""
    ours, split = tokens.WordTokens(TOKENIZER), tokens._splitter(tokens._PATTERN, 0x250)
    rng = random.Random(5)
    pool = ["'", "'", "''", "s", "t", "re", "ve", "m", "ll", "d", "l", "r", "v", " ", "\n", "1", "23", "\u00b2", "\u00df", "\u00e9", "\u00a0", "\x85", "\x1c", "-", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(5000)] + ["".join(map(chr, range(256))).lower()]
    data = "\n".join([*texts, "\n"]).encode("latin-1")
    starts, found = tokens.latin_words(np.frombuffer(data, np.uint8))
    assert [w.decode("latin-1") for w in found.to_pylist()] == [w for t in texts for w in split(t)]
    assert all(data[i : i + len(w)] == w for i, w in zip(starts.tolist(), found.to_pylist(), strict=True))
    ours.split = lambda text: pytest.fail("a text split by itself")
    encode = library()
    assert [x.tolist() for x in ours.encode(texts)] == [encode(t) for t in texts]


def test_words_at_once_equal_the_library(tmp_path):
    ours, encode, rng = tokens.WordTokens(TOKENIZER), library(), random.Random(6)
    letters = "aabcdeeefghiiklmnnoprrsstttuvwxyz\u00e9\u00fc\u00df\u0142"
    made_up = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(5000)] + ["a" * 3000, "\x00", "\x7f", "</w>", "<", "'s"]
    assert [x.tolist() for x in ours.encode([*made_up, " ".join(made_up)])] == [*map(encode, made_up), encode(" ".join(made_up))]
    # a model whose entries don't show where a word ends
    file = json.loads(Path(TOKENIZER).read_text())
    names = [*tokens._byte_letters(), "ab", "abc"]
    file["model"] |= {"vocab": {n: i for i, n in enumerate(names)}, "merges": [["a", "b"], ["ab", "c"]], "end_of_word_suffix": None}
    file["added_tokens"] = []
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    odd = tokens.WordTokens(str(other))
    assert odd.split and [x.tolist() for x in odd.encode(["abc ab", "cab \u00e9", None])] == [odd.tokenizer.encode("abc ab").ids, odd.tokenizer.encode("cab \u00e9").ids, []]


def test_token_files(spark):
    rows = odd_docs(random.Random(3)) + [(-5, "negative"), (0, "zero")]
    from foliospark.llm.shared import shared_dir

    path = shared_dir(spark)
    token_files.write_token_files(spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit(1)), TOKENIZER, path, block_ids=2000)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    encode = library()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, np.array([*encode(t), 1], "<u4").tobytes()) for i, t in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    empty = shared_dir(spark)
    token_files.write_token_files(spark.createDataFrame([], DOCS), TOKENIZER, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def apart(sequence):
    """How often each pair occurs without overlaps."""
    counts, last = Counter(), {}
    for i, pair in enumerate(zip(sequence.tolist(), sequence.tolist()[1:], strict=False)):
        if last.get(pair, -9) < i - 1:
            counts[pair] += 1
            last[pair] = i
    return counts


def test_repair():
    rng = np.random.default_rng(4)
    made = [np.zeros(0, np.uint32), np.ones(1, np.uint32), np.zeros(1000, np.uint32), rng.integers(0, 5, 5000).astype(np.uint32), rng.integers(0, 40000, 500).astype(np.uint32), np.tile(rng.integers(0, 50, 20), 100).astype(np.uint32)]
    made += [rng.integers(0, rng.integers(1, 6), rng.integers(0, 400)).astype(np.uint32) for _ in range(150)]
    for ids in made:
        for frequent in (2, 3, token_files.FREQUENT):
            base, rules, sequence = token_files.repair(ids, frequent)
            lengths = token_files.expansion_lengths(base, rules)
            block = token_files.Block(base, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), token_files._pack(sequence))
            assert (block.ids(0, len(ids)) == ids).all()
            for a, b in [(0, 0), (3, 4), (10, 700), (len(ids) // 2, len(ids))]:
                assert (block.ids(a, min(b, len(ids))) == ids[a:b]).all()
            assert max(apart(sequence).values(), default=0) < frequent  # no frequent pair is left
            assert len(rules) == 0 or (rules.max(axis=1) < base + np.arange(len(rules))).all()
    assert len(token_files.repair(np.zeros(1000, np.uint32), 2)[2]) < 20


def check_plan(histogram, capacity):
    runs, opened = packing.plan_places(histogram, capacity)
    used, ranks = Counter(), Counter()
    placed = {}
    for length, rank, count, first, offset in runs:
        for k in range(count):
            ranks[length, rank + k] += 1
            placed.setdefault(first + k, []).append((offset, length))
    assert ranks == Counter({(n, r): 1 for n, c in histogram.items() for r in range(c)})
    for sequence in placed.values():
        end = 0
        for offset, length in sorted(sequence):
            assert offset == end
            end += length
        assert end <= capacity
    assert set(placed) == set(range(opened)) and not used
    return opened


def test_plan():
    rng = random.Random(5)
    for _ in range(100):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(12))}
        opened = check_plan(histogram, 64)
        bins: list[int] = []
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            fits = [f for f in bins if f >= n]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - n)
            else:
                bins.append(64 - n)
        assert opened == len(bins)  # as best-fit decreasing document by document
    with pytest.raises(ValueError):
        packing.plan_places({65: 1}, 64)


def test_packing(spark):
    rows = odd_docs(random.Random(6))
    df = spark.createDataFrame(rows, DOCS).withColumns({"length": F.lit("x"), "_rank": F.lit(0), "ids": F.lit(1)})
    out = packing.pack_documents(df, TOKENIZER, 512).collect()
    encode, want = library(), []
    for i, t in rows:
        ids = np.array([*encode(t), 1], "<u4")
        want += [(i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    assert Counter(tuple(r)[:5] for r in out) == Counter(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 512
    assert packing.pack_documents(df.limit(0), TOKENIZER).count() == 0


# --- suffixes ---------------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    windows = Counter()
    for _, t in rows:
        b = (t or "").encode()
        windows.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if windows[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffixes(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffixes, "SLAB", 3)
    rng = random.Random(7)
    shared = [words(rng, 60) for _ in range(5)]
    rows = odd_docs(rng)
    for i in range(60):
        parts = [words(rng, rng.randrange(30), 10**6)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(100)
            parts += [s[a : a + rng.randrange(300)], words(rng, rng.randrange(30), 10**6)]
        rows.append((100 + i, "".join(parts)))
    rows += [(200, "abc" * 150), (201, "x" + "cab" * 90), (202, "ß" * 99 + "b"), (203, "q" * 199), (204, "z" * 200)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit(1), "n_bytes": F.lit("x"), "part": F.lit(0)})
    out = suffixes.remove_repeats(df)
    assert Counter((r.doc_id, bytes(r.kept)) for r in out.select("doc_id", "kept").collect()) == Counter(brute_repeats(rows, 200))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    assert all(r.kept_text == bytes(r.kept).decode("utf-8", "ignore") for r in out.collect())


def test_merge_runs():
    rng = random.Random(8)
    for k in (0, 1, 2, 3, 7):
        lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(30))) for _ in range(k)]
        runs = []
        for s in lists:
            shared, lengths, tails = suffixes._front_coded(s) if s else (np.zeros(0, np.uint32),) * 3
            runs.append(suffixes._decoded(shared, lengths, tails.astype(np.uint8).tobytes()))
        got = list(suffixes.merge_runs(runs))
        order = [runs[r][i][1] for r, i, _ in got]
        assert order == sorted(x for s in lists for x in s)
        for a, b, (_, _, common) in zip(order, order[1:], got[1:], strict=False):
            assert common == suffixes._common(a, b, 0)


# --- sharding, licences -----------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    df = spark.range(3000).select(F.col("id").alias("k")).union(spark.createDataFrame([(None,), (None,), (5,), (5,)], "k long")).withColumn("shard", F.lit("old"))
    weights = [1.0, 2.0, 0.0, 1.0]
    rows = sharding.assign_shards(sharding.assign_shards(df, "k", weights), "k", [*weights, 1.0], "grown")
    got = [(r.k, r.shard, r.grown) for r in rows.collect()]
    assert len(got) == 3004 and all(g == s or g == 4 for _, s, g in got)
    count = Counter(s for _, s, _ in got)
    assert count[2] == 0 and 1.7 < count[1] / count[0] < 2.3
    assert len({s for k, s, _ in got if k == 5}) == len({s for k, s, _ in got if k is None}) == 1
    slots = sharding.number_slots(rows, "k").collect()
    for shard in count:
        assert sorted(r.slot for r in slots if r.shard == shard) == list(range(count[shard]))
    assert sharding.number_slots(sharding.assign_shards(df.limit(0), "k", [1.0]), "k").count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "k", [0.0])


def test_sharding_digest(spark, tmp_path):
    rows = odd_docs(random.Random(9))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op4_rendezvous_shards(spark, str(tmp_path)).collect()
    draw = {(r.k, r.s): r.h for r in spark.createDataFrame([(i,) for i, _ in rows], "k long").crossJoin(spark.range(17).select(F.col("id").cast("int").alias("s"))).select("k", "s", F.xxhash64("k", "s").alias("h")).collect()}
    nearest = lambda k, n: max(range(n), key=lambda s: ((draw[k, s] & (1 << 64) - 1) >> 11, -s))  # noqa: E731  equal weights: the largest draw wins
    assert all((r.shard, r.grown_shard) == (nearest(r.doc_id, 16), nearest(r.doc_id, 17)) for r in got)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = dict(reversed([t for t in licences.TEMPLATES if t[0] == "MIT"]))
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n", licences.TEMPLATES[1][1])
    rows = [(1, None), (2, ""), (3, f"x y\n  {apache.upper()}\nz"), (4, "Licensed under the Apache License, Version 2.0 only"), (5, f"{apache}\nReleased under the MIT License."), (6, f"a b c\n\n{wrapped}\n\nd"), (7, wrapped), (8, "word " * 30000), (3, "x"), (9, "license licensed"), (10, mit["MIT"])]
    df = spark.createDataFrame(rows, DOCS).withColumns({"licensed": F.lit("old"), "extra": F.lit(1)})
    got = {(r.doc_id, i): r for i, r in enumerate(licences.scan_licences(df).collect())}
    found = {k[0]: (r.license_ids, r.best_license, r.licensed) for k, r in got.items() if k != (3, 8)}
    assert found[3] == ("Apache-2.0", "Apache-2.0", True) and found[5] == ("Apache-2.0,MIT", "Apache-2.0", True)
    assert found[6] == found[7] == ("Apache-2.0", "Apache-2.0", True) and found[10][1] == "MIT"
    assert all(found[i] == ("", None, False) for i in (1, 2, 8, 9)) and found[4][0] == "Apache-2.0"
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_licence_headers(spark):
    known = licences.all_templates()
    assert len({i for i, _ in known}) >= 24
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(known)], DOCS)
    got = {r.doc_id: (r.best_license, r.best_dice) for r in licences.scan_licences(df).collect()}
    assert got == {i: (name, 1.0) for i, (name, _) in enumerate(known)}
    two = next(t for i, t in known if i == "GPL-2.0-or-later")
    assert [r.license_ids for r in licences.scan_licences(df.where(F.col("text") == two)).collect()] == ["GPL-2.0-or-later"]


# --- decontamination --------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, words(rng, n, 30)) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 25])] + [(8, None), (9, "W1, w2! É1"), (7, "w3 w4"), (None, "w5")]
    rows = [*odd_docs(rng), *((i, words(rng, rng.randrange(80), 30)) for i in range(20, 60)), (65, f"w5 w5 {words(rng, 30000, 30)}"), (66, "W5")]
    rows += [(60, f"x {items[6][1].upper()} y"), (61, items[5][1].replace(" ", "--")), (62, items[7][1][:60]), (60, "w1"), (63, "w1 w2 É1"), (64, "w1 w2 é1")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    for i, t in rows:
        w, hit, of = low(t), set(), set()
        for item, text in items:
            p = low(text)
            for q in [p[k : k + 10] for k in range(max(1, len(p) - 9))] if p else []:
                for k in range(len(w) - len(q) + 1):
                    if w[k] == q[0] and w[k : k + len(q)] == q:
                        hit.update(range(k, k + len(q)))
                        of.update([] if item is None else [item])  # words of an item without id are hit all the same
        want.append((i, len(w), len(hit), len(of), decontaminate.items_digest(of), bool(hit)))
    docs = spark.createDataFrame(rows, DOCS).withColumns({"items": F.lit("old"), "n_words": F.lit("x")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words_a_pass in (decontaminate.PASS_WORDS, 200):
        monkeypatch.setattr(decontaminate, "PASS_WORDS", words_a_pass)
        assert Counter(map(tuple, decontaminate.digest(decontaminate.find_contamination(docs, bench)).collect())) == Counter(want)
    assert decontaminate.digest(decontaminate.find_contamination(docs, bench.limit(0))).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        bad = i % 8 == 0
        text = words(rng, 40, 3000) + (f" {rng.choice(['foul', 'nasty'])} {rng.choice(['grumo', 'grumi'])}{rng.choice('xyz')}" if bad else "")
        rows.append((i, text))
        if i % 5:
            labels.append((i, 1, int(bad)))
    rows += [(None, None), (1000, ""), (1001, None), (1002, rows[8][1]), (1002, rows[8][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    out = toxicity.score_toxicity(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    right = sum(r.predicted == int(r.doc_id % 8 == 0) for r in held)
    assert right / len(held) > 0.98
    same = {r.score for r in out if r.doc_id in (8, 1002)}
    assert len(same) == 1 and len({r.score for r in out if r.doc_id in (None, 1000, 1001)}) == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    blind = toxicity.fit_toxicity(docs, marks.limit(0))
    assert toxicity.score_toxicity(docs, blind).where("predicted = 1").count() == 0


def test_label_model():
    rng = np.random.default_rng(12)
    truth = rng.random(3000) < 0.2
    accurate = np.where(truth, rng.random(3000) < 0.9, rng.random(3000) < 0.02)
    votes = np.stack([accurate, accurate, np.where(truth, rng.random(3000) < 0.6, rng.random(3000) < 0.05), rng.random(3000) < 0.3], axis=1).astype(np.float32)
    noisy = np.where(rng.random(3000) < 0.1, ~truth, truth).astype(int)
    seeds = np.where(rng.random(3000) < 0.3, noisy, toxicity.UNKNOWN)
    model = toxicity.LabelModel().fit(votes, seeds)
    assert np.allclose(model.weights, [0.5, 0.5, 1, 1])  # two copies count as one voter
    unseen = seeds == toxicity.UNKNOWN
    assert np.mean((model.posterior > 0.5)[unseen] == truth[unseen]) > 0.95 and np.mean((model.posterior > 0.5) == truth) > np.mean(noisy == truth)
    assert 0.85 < model.accuracy[0] < 0.95 and model.rate[1][0] > 0.75 > 0.1 > model.rate[0][0] and abs(model.rate[0][3] - 0.3) < 0.05
    rows, at = np.unique(np.column_stack((votes, seeds)), axis=0, return_counts=True)
    counted = toxicity.LabelModel().fit(rows[:, :4].astype(np.float32), rows[:, 4].astype(int), at)
    assert np.allclose(counted.rate, model.rate, atol=1e-4)


def test_scores_are_sums_of_features():
    rng = random.Random(18)
    pool = ["grumo", "grumi", "grumoso", "foul", "fouls", "x", "dirty", "thirty"]
    names = sorted(set().union(*(toxicity.features_of({w}) for w in pool))) + ["#grum", "#grumo"]
    model = toxicity.ToxicityModel({f: rng.uniform(-2, 2) for f in names}, -0.5)
    score = model.scorer()
    for text in [None, "", *(" ".join(rng.choices(pool, k=rng.randrange(1, 9))).title() for _ in range(50)), "clean " * 50_000 + "foul"]:
        x = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features_of(toxicity.words_of(text)))
        assert abs(score(text) - 1 / (1 + np.exp(-x))) < 1e-9


# --- Jaccard ----------------------------------------------------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return out


def near_docs(rng):
    rows = odd_docs(rng)
    for f in range(8):
        n = rng.choice([6, 9, 12, 16, 40, 150])
        base = [f"f{f}x{j}" for j in range(n)]
        for c in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                copy[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                copy = copy[: n - rng.randrange(1 + n // 12)]
            rows.append((1000 + 100 * f + c, " ".join(copy)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, monkeypatch, small):
    rows = near_docs(random.Random(13))
    df = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit("x"), "root": F.lit(1)})
    bounded = (4, 17, 20)
    if small:  # long lists, blocks and light sets as few as can be
        monkeypatch.setattr(jaccard, "LIST_SETS", 3)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
        monkeypatch.setattr(jaccard, "PIVOTS", 1)
        monkeypatch.setattr(jaccard, "choose_boundary", lambda sets, bound: 11)
        bounded = (3, 4, 5)
    got = jaccard.jaccard_components(df, *bounded)
    assert Counter(map(tuple, got.collect())) == Counter(brute_components(rows, *bounded))
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_small_sets_are_joined_by_their_subsets(spark):
    """Many small sets that share frequent shingles: lists are dear, so the boundary rises by itself."""
    rng = random.Random(19)
    rows = []
    for i in range(900):
        of = [f"c{rng.randrange(4)}x{j}" for j in range(10)]
        if rng.random() < 0.2:
            of[rng.randrange(10)] = f"e{i}"
        rows.append((i, " ".join(of) if i % 3 else " ".join(f"c{i % 2}x{j}" for j in range(rng.randrange(7, 12)))))
    df = spark.createDataFrame(rows, DOCS)
    bound = jaccard.Bound(1, 2)
    named = jaccard.name_sets(df, 1).where("d1 is not null")
    total = named.agg(F.sum("n")).first()[0]
    sets = jaccard.survivors(df, 1, bound, total, np.zeros((2, 0), np.int64), frozenset())
    assert jaccard.choose_boundary(sets, bound) > 0
    assert Counter(map(tuple, jaccard.jaccard_components(df, 1, 1, 2).collect())) == Counter(brute_components(rows, 1, 1, 2))


def test_hot_shingles_and_equal_digests(spark, monkeypatch):
    """Shingles of most sets are broadcast; sets of one 64-bit digest are told apart by the other."""
    rows = near_docs(random.Random(20))
    monkeypatch.setattr(jaccard, "HOT_SHARE", 5000)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 40)
    df = spark.createDataFrame(rows * 2, DOCS)
    found = jaccard.name_sets(df, 4)
    assert jaccard.hot_shingles(found, 7000).shape[1] > 0
    digest = jaccard.set_digest

    def poor(tokens):
        d1, d2 = digest(tokens)
        return d1 % 64, d2

    monkeypatch.setattr(jaccard, "set_digest", poor)
    want = Counter({k: 2 * n for k, n in Counter(brute_components(rows, 4, 17, 20)).items()})
    assert Counter(map(tuple, jaccard.jaccard_components(df, 4, 17, 20).collect())) == want


def test_size_classes(spark):
    for num, den in ((17, 20), (4, 5), (1, 2), (1, 1)):
        bound = jaccard.Bound(num, den)
        got = {r.n: r.c for r in spark.range(1, 3000).select(F.col("id").alias("n"), jaccard.size_class(F.col("id"), bound).alias("c")).collect()}
        assert all(got[m] - got[n] in (0, 1) for n in range(1, 1400) for m in (n, n * den // num))


def test_signatures():
    rng = np.random.default_rng(14)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(1, 900, 2))
        b = np.union1d(b[: len(b) // 3], a[: rng.integers(0, len(a) + 1)])
        words_ = jaccard._signatures([jaccard.signature(a, len(a)), jaccard.signature(b, len(b))])
        assert int(np.bitwise_count(words_[0] ^ words_[1]).sum()) <= len(np.setxor1d(a, b))


def test_shingles():
    column = pa.array(["a b c d e", "a b  c\td", "B A", None, "a b c d a b c d", ""])
    sets = list(jaccard.shingle_sets(column, 4))
    assert [len(s) for s in sets] == [2, 1, 1, 0, 4, 0] and sets[1][0] in sets[0] and sets[1][0] in sets[4]
    assert list(jaccard.shingle_sets(pa.array(["b a", "a b"]), 4))[0][0] == sets[2][0]


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "x long, y long").repartition(4)).collect()))
    forest = components.Forest()
    for a, b in edges:
        if a is not None and a != b:
            forest.join(a, b)
    assert got == {x: forest.root(x) for x in forest.parent}


# --- media ------------------------------------------------------------------------------------------------------------------------


def test_media(spark, tmp_path):
    rows = [*odd_docs(random.Random(16)), (20, "a" * 64), (21, "b\0")]
    rows = [(i, t) for i, t in rows if i is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op9_interleaved_media(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


@pytest.mark.parametrize("hot", [10_000, 1])
def test_sequences(spark, monkeypatch, hot):
    monkeypatch.setattr(media, "HOT_REFERENCES", hot)
    html = '<h1>T</h1><p>one <b>two</b></p><figure><img src="media:aa" alt="x"><figcaption>Cap &amp; tion</figcaption></figure>three<img src="media:bb" alt="alt"><img src="http://x/y.png"><script>no</script>'
    found = media.parse_sequence(html)
    assert [(x["pos"], x["kind"], x["text"], x["digest"]) for x in found] == [(0, "text", "T", None), (1, "text", "one two", None), (2, "media", "Cap & tion", "aa"), (3, "text", "three", None), (4, "media", "alt", "bb")]
    assert media.parse_sequence(None) == media.parse_sequence("") == []
    pages_ = spark.createDataFrame([(1, html), (2, None), (1, html)], "page_id long, html string").withColumn("sequence", F.lit("old"))
    store = spark.createDataFrame([("aa", 5)], "digest string, n int")
    got = media.resolve(media.interleave(pages_), store, ["page_id"])
    assert Counter((r.page_id, r.pos, r.caption, r.n) for r in got.collect()) == Counter([(1, 2, "Cap & tion", 5), (1, 4, "alt", None)] * 2)
    assert media.resolve(media.interleave(pages_.limit(0)), store, ["page_id"]).count() == 0


def test_wav():
    for data in (b"", b"a", bytes(range(256))):
        assert media.from_wav(media.to_wav(data)) == data
    for bad in (b"", b"RIFFxxxxWAVE", media.to_wav(b"abcd")[:-1]):
        with pytest.raises((ValueError, __import__("struct").error)):
            media.from_wav(bad)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    passage = words(rng, 70, 10**6)
    item = words(rng, 15, 10**6)
    clean = [(i, words(rng, 120, 10**6)) for i in range(1, 30)]
    toxic = [(100 + i, words(rng, 60, 10**6) + " foul nasty") for i in range(80)]
    copies = [(300, clean[0][1]), (301, clean[1][1] + " end")]
    shared = [(310 + i, f"{words(rng, 50, 10**6)} {passage} {words(rng, 50, 10**6)}") for i in range(2)]
    leaked = [(320, f"{words(rng, 80, 10**6)} {item}")]
    rows = [(i, t, "en", "s", len(t)) for i, t in clean + toxic + copies + shared + leaked]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = __import__("foliospark.llm.shared", fromlist=["x"]).materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id: r.text for r in docs.collect()})
    plain = {i for i, _ in clean}
    assert set(kept[0]) == plain | {300, 301, 310, 311, 320}
    assert set(kept[1]) == plain | {310, 311, 320}
    assert set(kept[2]) == set(kept[1]) and all(passage not in t for t in kept[2].values()) and all(kept[2][i] == t for i, t in clean)
    assert set(kept[3]) == plain | {310, 311}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[3])


