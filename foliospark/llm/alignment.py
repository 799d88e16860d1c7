"""Cross-tokenizer alignment: groups of tokens between common byte offsets, and links of tokens that overlap."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import CACHES, mapped, materialise
from foliospark.llm.tokens import _LATIN, CACHE_WORDS, SLICE_ROWS, _byte_letters, runs

#: Id pairs whose counts are broadcast at most (some 60 bytes each); the others are joined by a shuffle.
BROADCAST_PAIRS = 1 << 20
#: Ids of the second tokenizer are below this, so that a pair is one long.
PAIR_BASE = 1 << 32
_cache: dict[tuple[str, str], "ByteLevelIds | SentenceIds"] = {}
CACHES.append(_cache.clear)


class Encoded:
    """Tokens of several texts on end: ids, the bytes of each, the tokens before each text (and after the last), and which texts they spell."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, spelt: np.ndarray):
        self.ids, self.lengths, self.bounds, self.spelt = ids, lengths, bounds, spelt


class ByteLevelIds:
    """A byte-level BPE file of the tokenizers library.

    Where its merges rank as its ids do, tiktoken runs the same merges several times as fast; texts beyond Latin Extended-A go to the
    tokenizers library itself, so that only its own character classes decide there.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        made = json.loads(self.tokenizer.to_str())
        shown = {c: b for b, c in enumerate(_byte_letters())}
        spelling = {bytes(shown[c] for c in token): i for token, i in made["model"]["vocab"].items() if all(c in shown for c in token)}
        spelling |= {t["content"].encode(): t["id"] for t in made["added_tokens"] if t["content"] not in made["model"]["vocab"]}
        self.bytes_of = np.zeros(1 + max(spelling.values()), np.int64)
        for token, i in spelling.items():
            self.bytes_of[i] = len(token)
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in made["model"]["merges"]]
        ids = [made["model"]["vocab"][m] for m in merges]
        special = {t["id"] for t in made["added_tokens"]}
        before = made["pre_tokenizer"] or {}
        self.ranked = None
        if ids == sorted(ids) and made["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={t: i for t, i in spelling.items() if i not in special}, special_tokens={})
        self.beyond = re.compile(f"[^\\x00-{chr(_LATIN - 1)}]").search

    def encode(self, texts: list[str]) -> Encoded:
        made = []
        for t in texts:
            if self.ranked is None or not t.isascii() and self.beyond(t):
                made.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32))
            else:
                made.append(np.array(self.ranked.encode_ordinary(t), np.int32))
        ids = np.concatenate(made) if made else np.zeros(0, np.int32)
        bounds = np.cumsum([0, *map(len, made)])
        lengths = self.bytes_of[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))[bounds]
        return Encoded(ids, lengths, bounds, np.diff(ends) == [len(t.encode()) for t in texts])


class SentenceIds:
    """A sentencepiece BPE model that keeps texts as they are, puts a space before them and has no piece with a space after another
    character: what begins with spaces and ends before the next ones is encoded by itself, and once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.split = re.compile(" +[^ ]*").findall
        pieces = range(self.model.get_piece_size())
        self.spelling = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("\u2581", " ").encode() for i in pieces]
        self.bytes_of = np.array(list(map(len, self.spelling)), np.int64)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.spelt = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        text = "".join(words)
        ids = np.array(self.model.encode(text[1:], num_threads=1), np.int32)
        ends = np.cumsum(self.bytes_of[ids])
        bounds = np.cumsum([len(w.encode()) for w in words])
        if not all(w.strip(" ") for w in words) or b"".join(map(self.spelling.__getitem__, ids.tolist())) != text.encode():
            made = [self._alone(w) for w in words]
            ids, sizes = np.array(list(chain.from_iterable(made)), np.int32), np.array(list(map(len, made)), np.int64)
            spelt = np.array([b"".join(self.spelling[i] for i in m) == w.encode() for m, w in zip(made, words, strict=True)], bool)
        else:
            sizes, spelt = np.diff(np.searchsorted(ends, bounds, side="right"), prepend=0), np.ones(len(words), bool)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.ids, self.sizes, self.spelt = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes)), np.concatenate((self.spelt, spelt))

    def _alone(self, word: str) -> list[int]:
        if word.strip(" "):
            return self.model.encode(word[1:], num_threads=1)
        ids, size = self.model.encode("x" + word, num_threads=1), 0  # spaces that end a text come after something
        for i, token in enumerate(ids):
            if size == 2:
                return ids[i:]
            size += len(self.spelling[token])
        raise ValueError("spaces are one piece with what they follow")

    def encode(self, texts: list[str]) -> Encoded:
        """texts begin with a space, which the model puts there itself."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        words = [self.split(t) for t in texts]
        index = self.index
        fresh = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in index]
        for part in ([w for w in fresh if w.strip(" ")], [w for w in fresh if not w.strip(" ")]):  # bare spaces would run into what follows
            if part:
                index.update(zip(part, range(len(index), len(index) + len(part)), strict=True))
                self._learn(part)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        sizes = self.sizes[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[at] - ends[:-1], sizes)]
        cuts = np.concatenate(([0], np.cumsum(counts)))
        broken = np.concatenate(([0], np.cumsum(~self.spelt[at])))[cuts]
        return Encoded(ids, self.bytes_of[ids], ends[cuts], broken[1:] == broken[:-1])


def _encoder(kind: type, path: str):
    if (kind.__name__, path) not in _cache:
        _cache[kind.__name__, path] = kind(path)
    return _cache[kind.__name__, path]


def _kept(made: Encoded, keep: np.ndarray) -> Encoded:
    """The same texts, those not kept without tokens."""
    sizes = np.diff(made.bounds)
    of = np.repeat(keep, sizes)
    return Encoded(made.ids[of], made.lengths[of], np.concatenate(([0], np.cumsum(np.where(keep, sizes, 0)))), made.spelt)


def _encoded(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple[pa.Array, Encoded, Encoded]]:
    """Keys and tokens by both tokenizers of runs of rows (key, text); texts that have no tokens by the contract have none."""
    first, second = _encoder(ByteLevelIds, path_a), _encoder(SentenceIds, path_b)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            texts = part.column(1).to_pylist()
            for i, j in runs(texts):
                spaced = [" " + (t or "") for t in texts[i:j]]
                a, b = first.encode(spaced), second.encode(spaced)
                keep = a.spelt & b.spelt & np.array([bool(t) for t in texts[i:j]])
                yield part.column(0).slice(i, j - i), _kept(a, keep), _kept(b, keep)


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


TOKENS = [T.StructField(c, T.ArrayType(T.IntegerType() if c in "ab" else T.LongType(), False)) for c in ("a", "a_ends", "b", "b_ends")]


def tokenise(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of both tokenizers (a, b) and the byte offsets in " " + text at which each token ends (a_ends, b_ends).

    Texts that are null or empty, or whose tokens of either kind don't spell " " + text, have empty arrays.
    """

    def columns(made: Encoded) -> list[pa.Array]:
        ends = np.cumsum(made.lengths)
        ends -= np.repeat(np.concatenate(([0], ends))[made.bounds[:-1]], np.diff(made.bounds))
        return [_lists(made.bounds, made.ids), _lists(made.bounds, ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, a, b in _encoded(batches, path_a, path_b):
            yield pa.RecordBatch.from_arrays([keys, *columns(a), *columns(b)], names=[doc_id, "a", "a_ends", "b", "b_ends"])

    return docs.select(doc_id, text).transform(mapped, run, T.StructType([docs.schema[doc_id], *TOKENS]))


#: Ids are written in so many digits at most, a byte of eight being their separator.
_DIGITS = 7


def _decimals(ids: np.ndarray) -> np.ndarray:
    """Each id's decimal digits in the first bytes of eight, the others 0."""
    most = int(ids.max()) + 1 if len(ids) else 0
    if most > 10**_DIGITS:
        raise ValueError(f"ids of more than {_DIGITS} digits")
    if len(_spelt[0]) < most:
        _spelt[0] = np.frombuffer(b"".join(b"%d" % i + bytes(8 - len(str(i))) for i in range(most)), "<u8")
    return _spelt[0][ids]


_spelt = [np.zeros(0, np.uint64)]


def _forget() -> None:
    _spelt[0] = np.zeros(0, np.uint64)


CACHES.append(_forget)


def align_texts(a: Encoded, b: Encoded) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts on end: each one's groups ("a1,a2|b1;a3|b2", empty without tokens), their numbers, links, and links before each text.

    A token's bytes are some, and both tokenizers' tokens spell the same texts. Offsets where tokens of both end cut a text into groups.
    A link (a's id * PAIR_BASE + b's id) is a pair of tokens whose byte ranges overlap: those of a token of a are the tokens of b from
    the one that its first byte is in to the one that its last byte is in. All steps are linear, whatever the length of a text or group.
    """
    ends_a, ends_b = np.cumsum(a.lengths), np.cumsum(b.lengths)
    size = int(ends_a[-1]) if len(ends_a) else 0
    at_a, at_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    at_a[ends_a] = at_b[ends_b] = True
    until = np.cumsum(at_b, dtype=np.int32)  # tokens of b that end at an offset or before
    first = until[ends_a - a.lengths]
    counts = until[ends_a - 1] - first + 1
    linked = np.concatenate(([0], np.cumsum(counts)))
    links = np.repeat(a.ids.astype(np.int64) * PAIR_BASE, counts) + b.ids[np.arange(int(linked[-1])) + np.repeat(first - linked[:-1], counts)]

    cut_a, cut_b = at_b[ends_a], at_a[ends_b]  # tokens that end a group
    groups_a, groups_b = np.concatenate(([0], np.cumsum(cut_a))), np.concatenate(([0], np.cumsum(cut_b)))
    after_a, after_b = np.flatnonzero(cut_a) + 1, np.concatenate(([0], np.flatnonzero(cut_b) + 1))
    written = np.empty(len(a.ids) + len(b.ids), np.uint64)  # a group's tokens of a, then those of b
    comma, bar, semicolon = (np.uint64(ord(c) << 8 * _DIGITS) for c in ",|;")
    written[np.arange(len(a.ids)) + after_b[groups_a[:-1]]] = _decimals(a.ids) | np.where(cut_a, bar, comma)
    written[np.arange(len(b.ids)) + after_a[groups_b[:-1]]] = _decimals(b.ids) | np.where(cut_b, semicolon, comma)
    bounds = (a.bounds + b.bounds).tolist()
    groups = [written[i:j].astype("<u8").tobytes().translate(None, b"\0")[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return groups, np.diff(groups_a[a.bounds]), links, linked[a.bounds]


def align(tokens: DataFrame) -> DataFrame:
    """The tokens' table with n_groups, groups ("a1,a2|b1" for each) and links (see align_texts).

    Both arrays of ends rise strictly and end alike. Rows without tokens have no groups and links.
    """

    def read(batch: pa.RecordBatch, name: str) -> Encoded:
        ids, ends = batch.column(name), batch.column(f"{name}_ends").flatten().to_numpy()
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))))
        lengths = np.diff(ends, prepend=0)
        begins = bounds[:-1][np.diff(bounds) > 0]
        lengths[begins] = ends[begins]
        return Encoded(ids.flatten().to_numpy(), lengths, bounds, np.ones(batch.num_rows, bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                groups, n_groups, links, bounds = align_texts(read(part, "a"), read(part, "b"))
                listed = pa.array([g.decode().split(";") if g else [] for g in groups], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_groups), listed, _lists(bounds, links)], names=[*part.schema.names, "n_groups", "groups", "links"])

    return tokens.transform(mapped, run, T.StructType([*tokens.schema, T.StructField("n_groups", T.LongType()), T.StructField("groups", T.ArrayType(T.StringType())), LINKS]))


LINKS = T.StructField("links", T.ArrayType(T.LongType(), False))
COUNTED = [*(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()), LINKS]


def tokenise_and_align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 ("" without tokens) and links, the tokens staying in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, a, b in _encoded(batches, path_a, path_b):
            groups, n_groups, links, bounds = align_texts(a, b)
            counts = [pa.array(x.astype(np.int64)) for x in (np.diff(a.bounds), np.diff(b.bounds), n_groups, np.diff(bounds))]
            digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())
            yield pa.RecordBatch.from_arrays([keys, *counts, digests, _lists(bounds, links)], names=[doc_id, *(c.name for c in COUNTED)])

    return docs.select(doc_id, text).transform(mapped, run, T.StructType([docs.schema[doc_id], *COUNTED]))


def count_pairs(linked: DataFrame) -> DataFrame:
    """pair, times (links of the whole table that hold it) and best (whether no other pair of its b has more)."""
    pairs = materialise(linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("times"))).withColumn("_b", F.col("pair") % PAIR_BASE)
    most = pairs.groupBy("_b").agg(F.max("times").alias("_most"))
    return pairs.join(most, "_b").select("pair", "times", (F.col("times") == F.col("_most")).alias("best"))


def score_links(linked: DataFrame, pairs: DataFrame, key: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """key, n_best (links whose pair is best) and count_sum (their pairs' times) of the rows that have links.

    Up to broadcast_pairs pairs go to all tasks: all of them, or where there are more, those that hold one link of so many, of which
    there can't be more. Links of the others, none of which holds more than that share, meet their pairs by a shuffle.
    """
    kinds, links = pairs.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    often = F.lit(True) if kinds <= broadcast_pairs else F.col("times") * broadcast_pairs >= links
    single = linked.select(key, F.explode("links").alias("pair"))
    first = single.join(F.broadcast(pairs.where(often)), "pair", "left")
    sums = [F.count_if("best").alias("n_best"), F.coalesce(F.sum("times"), F.lit(0)).alias("count_sum")]
    if kinds <= broadcast_pairs:
        return first.groupBy(key).agg(*sums)
    rest = first.where("times is null").groupBy(key, "pair").agg(F.count("*").alias("_k")).join(pairs.where(~often), "pair")
    rest = rest.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("_k")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("_k")).alias("count_sum"))
    return first.groupBy(key).agg(*sums).unionByName(rest).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_table(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    a and b are the ids of " " + text by a byte-level BPE file and of text by a sentencepiece BPE model. Null and empty texts, and texts
    that the tokens of one of them don't spell, have zeros and an empty groups_sha256. Repeated rows and null ids each keep a row and
    count; an empty table gives none; other columns aren't looked at. Documents and their links are written to the shared folder once.
    """
    made = tokenise_and_align(docs, path_a, path_b, doc_id, text)
    linked = materialise(made.withColumn("_row", F.monotonically_increasing_id()))
    scored = score_links(linked, materialise(count_pairs(linked)), "_row").withColumnsRenamed({"n_best": "_best", "count_sum": "_sum"})
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return linked.drop("links").join(scored, "_row", "left").select(doc_id, "n_a", "n_b", "n_groups", "n_links", none("_best").alias("n_best"), none("_sum").alias("count_sum"), "groups_sha256")


def op11_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of every whole text by byte_bpe_50k.json and piece_bpe_32k.model."""
    import public_tokenizers

    return alignment_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
