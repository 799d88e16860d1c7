"""Main text of web pages: nearest-URL page differencing over aligned text lines, with the roles that markup declares."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import dealt, mapped, materialise, shuffle_partitions

#: Roles of a line: inside a declared main part, inside declared boilerplate, or open (decided by differencing).
MAIN, BOILERPLATE, OPEN = 1, 2, 0
#: Roles that the whole page settles: inside an element with a boilerplate name, an article inside such an element, a form inside a main part.
NAMED, WEAK, FORM = 3, 4, 5

#: Elements whose content is no main text, never shown, raw text, without content, inline.
ASIDE = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "textarea"}
HIDDEN = {"script", "style", "template", "noscript", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Whole class or id tokens of boilerplate (a hyphen doesn't end a token: wrappers are named no-sidebar or page-with-header), those of comments, and roles.
NAMES = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|widget|pagination|pager|login|signup"
    r"|ads?[_-](?:banner|box|container|slot|unit)|cookies?[_-](?:banner|bar|consent|notice|popup)|(?:global|site)[_-](?:footer|header|nav|navigation)|(?:footer|main|primary|site|top)[_-](?:menu|nav|navigation)|nav[_-](?:bar|links|menu)|newsletter[_-](?:box|form|signup)|(?:share|sharing|social)[_-](?:bar|buttons|icons|links)|(?:recommended|related)[_-](?:articles|links|posts|stories))(?:$|\s)",
    re.I,
)
COMMENTS = re.compile(r"(?:^|\s)(?:comments?|replies|respond|disqus|disqus[_-]thread|comments?[_-](?:area|form|list|respond|section)|(?:post|user|reader)[_-]comments)(?:$|\s)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: An open element of the set ends where the named one starts.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}


class _Lines(HTMLParser):
    """Blocks of text in page order, each with its role."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.opened: Counter[str] = Counter()
        self.role = OPEN
        self.hidden = 0
        self.held: list[str] = []
        self.lines: list[tuple[int, str]] = []

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held = []
            if text:
                self.lines.append((self.role, text))

    def _role(self, tag: str, attrs: list) -> int:
        if self.role == BOILERPLATE or tag in ASIDE:
            return BOILERPLATE
        at = dict(attrs)
        declared = (at.get("role") or "").lower()
        if declared in ROLES or "hidden" in at:
            return BOILERPLATE
        main, article = tag == "main" or declared == "main", tag == "article" or declared == "article"
        named = f"{at.get('class') or ''} {at.get('id') or ''}"
        if tag not in ("html", "body") and not main and COMMENTS.search(named):
            return BOILERPLATE
        if main:
            return MAIN
        if article:
            return WEAK if self.role in (NAMED, WEAK) else MAIN
        if tag not in ("html", "body") and NAMES.search(named):
            return NAMED if self.role in (OPEN, NAMED, MAIN) and all(t != "article" for t, _ in self.stack) else BOILERPLATE
        if tag == "form" and self.role in (MAIN, WEAK):
            return FORM if self.role == MAIN else BOILERPLATE
        return self.role

    def _pop(self, to: int) -> None:
        self.flush()
        while len(self.stack) > to:
            tag, role = self.stack.pop()
            self.opened[tag] -= 1
            self.hidden -= tag in HIDDEN
            self.role = role

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag == "body":  # an unclosed head ends here
            self._pop(0)
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for i in range(len(self.stack) - 1, -1, -1) if any(self.opened[x] for x in ends) else ():
            if self.stack[i][0] in ends:
                self._pop(i)
                break
            if self.stack[i][0] not in INLINE and self.stack[i][0] not in ends:
                break
        if tag in VOID:
            return
        role = self._role(tag, attrs)
        if role != self.role:
            self.flush()
        self.stack.append((tag, self.role))
        self.opened[tag] += 1
        self.hidden += tag in HIDDEN
        self.role = role

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do, "/>" closes only elements without content

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1) if self.opened[tag] else ():
            if self.stack[i][0] == tag:
                if self.stack[i][1] == self.role and tag in INLINE:
                    self.opened[tag] -= 1
                    del self.stack[i]  # inline elements may be closed out of order
                else:
                    self._pop(i)
                return

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)


def page_lines(html: str | None) -> list[tuple[int, str]]:
    """(role, text) of each block of shown text, white space turned into single spaces."""
    if not html:
        return []
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return _settled(parser.lines)


def _settled(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Articles inside elements with a boilerplate name are the main part where they hold more text than the rest of it (else they are
    teasers); so is a form inside a main part."""
    size = {role: sum(len(t) for r, t in lines if r == role) for role in (MAIN, FORM, WEAK)}
    to = {NAMED: BOILERPLATE, WEAK: MAIN if size[WEAK] > size[MAIN] + size[FORM] else BOILERPLATE, FORM: MAIN if size[FORM] > size[MAIN] else BOILERPLATE}
    return [(to.get(role, role), t) for role, t in lines]


#: Bits of alignment rows that are kept for the way back; longer pages are halved first.
ALIGN_BITS = 1 << 27


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Row by row, the bits of the places of b where the length of the common subsequence doesn't grow (Hyyro's bit-parallel method)."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & whole
        yield row


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _align(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b, in time of len(a) * len(b) / 64 and bounded space."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > ALIGN_BITS:  # Hirschberg: where b is cut if a is cut in the middle
        half = len(a) // 2
        cut = int(np.argmax(_growth(a[:half], b) + _growth(a[:half - 1 : -1], b[::-1])[::-1]))
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of the lines of a longest common subsequence with b.

    Lines that the other page lacks can't be part of it; common ends always can. The rest is aligned by bit-parallel dynamic
    programming, so that pages of many repeated lines cost no more than others.
    """
    in_b, in_a = set(b), set(a)
    left = [i for i, x in enumerate(a) if x in in_b]
    right = [j for j, x in enumerate(b) if x in in_a]
    first = last = 0
    most = min(len(left), len(right))
    while first < most and a[left[first]] == b[right[first]]:
        first += 1
    while last < most - first and a[left[-1 - last]] == b[right[-1 - last]]:
        last += 1
    middle = left[first : len(left) - last]
    found = _align([a[i] for i in middle], [b[j] for j in right[first : len(right) - last]])
    return {*left[:first], *(middle[i] for i in found), *left[len(left) - last :]}


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _host_and_path(url) -> tuple:
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    return host, F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), "#.*$", "")


LINE_HASHES = "array<bigint>"


def find_shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, html_hash, shared) of the pages that have open lines shared with their nearest page of other content; shared are
    places among the page's open lines.

    Only line hashes take part. Keys are sorted by range over (host, path, page_id), so a host of any size spreads over tasks. Pages in
    a run of equal open lines (repeated rows, crawls, mirrors) are copies and aren't compared with each other, but with the content
    before or after the run: with the one whose path has the longer common prefix, the one before if equal. Where that one has every
    open line, the other decides. Runs at a part's ends find their neighbours, which may lie several parts away, by a join on the part
    number. The sorted parts are written to the shared folder first, so that all reads see the same parts.
    """
    host, path = _host_and_path(F.col("url"))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("html_hash"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, roles, digests = [], [], []
            for html in batch.column("html"):
                found = page_lines(html.as_py())
                hashes.append([_line_hash(t) for _, t in found])
                roles.append(bytes(r for r, _ in found))
                digests.append(_digest(_open_hashes(hashes[-1], roles[-1])))
            keep = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(hashes, pa.list_(pa.int64())), pa.array(roles, pa.binary()), pa.array(digests, pa.binary())], names=[*keep, "hashes", "roles", "digest"])

    schema = f"page_id {kind}, url string, host string, path string, html_hash bigint, hashes {LINE_HASHES}, roles binary, digest binary"
    parsed = materialise(keyed.transform(mapped, lines, schema))
    sort = ["host", "path", "page_id", "url", "html_hash"]
    ranged = parsed.repartitionByRange(shuffle_partitions(pages.sparkSession), *sort).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged)
    # One row for each part, however large the input.
    rows = ranged.join(F.broadcast(_neighbours(ranged, sort)), F.col("part") == F.col("_part"), "left").drop("_part").transform(dealt, shuffle_partitions(pages.sparkSession), "part", *sort)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = tail = None
        before: list[dict] = []  # the last page so far and the last one of other content
        run: list[tuple] = []  # copies wait for the content after them; of their lines, only the last one's are held
        last: dict | None = None
        out: list[tuple] = []

        def settle(after: list[dict]) -> None:
            if run:
                sides = [next((x for x in side or () if x["digest"] != last["digest"]), None) for side in (before, after)]
                sides = [x if x and x["host"] == last["host"] else None for x in sides]
                own, found = _open_hashes(last["hashes"], last["roles"]), {}
                for *key, path in run:
                    first = 1 if not sides[0] or sides[1] and _common(path, sides[1]["path"]) > _common(path, sides[0]["path"]) else 0
                    if first not in found:
                        found[first] = _shared_open(own, sides[first], sides[1 - first])
                    if found[first]:
                        out.append((*key, found[first]))
                run.clear()

        def result() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            out.clear()
            kinds = (page_type, pa.string(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "url", "html_hash", "shared"])

        for batch in batches:
            page_type = batch.schema.field("page_id").type
            for row in batch.to_pylist():
                if row["part"] != part:
                    settle(tail)
                    part, tail, before, last = row["part"], row["_after"], row["_before"] or [], None
                elif row["digest"] != last["digest"] or row["host"] != last["host"]:
                    settle([row])
                    before = [last]
                run.append((row["page_id"], row["url"], row["html_hash"], row["path"]))
                last = row
            yield result()
        if run:
            settle(tail)
            yield result()

    return rows.transform(mapped, compare, f"page_id {kind}, url string, html_hash bigint, shared array<int>")


def _neighbours(ranged: DataFrame, sort: list[str]) -> DataFrame:
    """(_part, _before, _after) of each part: the page next to it on either side and the nearest one there of other content."""
    key, line = F.struct(*sort), F.struct("host", "path", "digest", "hashes")
    ends = ranged.groupBy("part").agg(F.min_by(line, key).alias("first"), F.max_by(line, key).alias("last"))
    known = ranged.join(F.broadcast(ends.select(F.col("part").alias("_part"), F.col("first.digest").alias("_first"), F.col("last.digest").alias("_last"))), F.col("part") == F.col("_part"))
    other = known.groupBy("part").agg(F.min_by(line, F.when(F.col("digest") != F.col("_first"), key)).alias("second"), F.max_by(line, F.when(F.col("digest") != F.col("_last"), key)).alias("second_last"))
    # Parts are as many as shuffle partitions; those without rows are passed over.
    parts = sorted(ends.join(other, "part").collect(), key=lambda r: r["part"])

    def sweep(rows: list, near: str, next_near: str) -> dict[int, list]:
        held, out = [], {}
        for r in rows:
            out[r["part"]] = held
            ahead = [r[near]] + ([r[next_near]] if r[next_near] else [])
            held = ahead + [x for x in held if len(ahead) == 1 and x["digest"] != r[near]["digest"]][:1]
        return out

    before, after = sweep(parts, "last", "second_last"), sweep(parts[::-1], "first", "second")
    side = f"array<struct<host string, path string, digest binary, hashes {LINE_HASHES}>>"
    return ranged.sparkSession.createDataFrame([(p, before[p], after[p]) for p in before], f"_part int, _before {side}, _after {side}")


def _open_hashes(hashes: list[int], roles: bytes) -> list[int]:
    return [h for h, r in zip(hashes, roles, strict=True) if r == OPEN]


def _digest(hashes: list[int]) -> bytes:
    return hashlib.blake2b(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes), digest_size=16).digest()


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def _shared_open(own: list[int], near: dict | None, other: dict | None) -> list[int]:
    """Places in own of the lines shared with the near page; with the other one where the near page has them all."""
    if not own or not near:
        return []
    found = shared_lines(own, near["hashes"])
    if len(found) == len(own) and other:
        found = shared_lines(own, other["hashes"])
    return sorted(found)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Add text and n_chars: the main text of each page (page_id, url, html).

    Lines that markup declares boilerplate, by element, role or whole class or id token, go, but for a main part declared inside; a form
    around open lines declares nothing; lines shared with the nearest page of the host, by longest common subsequence, go too,
    unless they lie in a declared article (mirrored articles would lose their text). Pages of equal open lines are copies: the nearest
    page is one of other content. Where a page declares a main part, open lines outside it go as well. Null or empty HTML has an empty
    text; a null URL makes a host of its own; pages of equal URL are neighbours in page_id order; equal rows get equal texts; a page
    whose host has no other content is compared with none; an empty table gives none. Pages of any length are parsed whole, and aligned
    in bounded space. Columns of the result's names are replaced.
    """
    pages = pages.drop("text", "n_chars", "_shared")
    shared = find_shared_lines(pages)
    # Equal rows have one entry.
    shared = shared.groupBy(F.col("page_id").alias("_id"), F.coalesce("url", F.lit("")).alias("_url"), F.col("html_hash").alias("_html")).agg(F.first("shared").alias("_shared"))
    joined = pages.join(shared, F.col("page_id").eqNullSafe(F.col("_id")) & (F.coalesce("url", F.lit("")) == F.col("_url")) & (F.xxhash64("html") == F.col("_html")), "left").drop("_id", "_url", "_html")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, gone in zip(batch.column("html"), batch.column("_shared"), strict=True):
                texts.append(main_text(page_lines(html.as_py()), set(gone.as_py() or ())))
            keep = [n for n in batch.schema.names if n != "_shared"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return joined.transform(mapped, extract, schema)


def main_text(lines: list[tuple[int, str]], gone: set[int]) -> str:
    """The lines that stay; gone has places among the open ones."""
    declared = any(role == MAIN for role, _ in lines)
    opens = (i for i, (role, _) in enumerate(lines) if role == OPEN)
    gone = {i for at, i in enumerate(opens) if at in gone}
    kept = [t for i, (role, t) in enumerate(lines) if i not in gone and role != BOILERPLATE and (role == MAIN or not declared)]
    return " ".join(kept)


def op1_page_differencing(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


