"""Token ids of whole texts by a public tokenizer, with a bounded cache of pre-tokens."""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.llm.shared import CACHES, mapped

#: Words kept by a worker before its cache starts anew.
CACHE_WORDS = 200_000
#: Words that WordTokens keeps, some 200 bytes each.
KEPT_WORDS = 600_000
SLICE_ROWS = 512
#: Rows and characters that are encoded at once.
RUN_ROWS, RUN_CHARS = 4096, 1 << 22
END_ID = 1
_cache: dict[str, "WordTokens"] = {}


def forget_words() -> None:
    """A worker keeps its tokenizers, which are of fixed size; words only from one task that encodes to the next."""
    for encoder in _cache.values():
        encoder.reset()


CACHES.append(forget_words)


#: Texts of these characters alone (up to Latin Extended-A) are split here; others go to the library whole.
_LATIN = 0x180
_SPACE = "\\t-\\r \\x85\\xa0"


def _latin(kind: str, end: int) -> str:
    """The characters before `end` of a Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(end) if unicodedata.category(chr(c))[0] == kind)


def _splitter(pattern: str, end: int):
    """findall of the tokenizer's pattern for texts of characters before `end` alone; None for a pattern of another make.

    Letters are tried first: no other alternative begins with one.
    """
    letters, numbers = _latin("L", end), _latin("N", end)
    for old, new in (("[^\\s\\p{L}\\p{N}]", f"[^{_SPACE}{letters}{numbers}]"), ("|[\\p{L}]+", ""), ("[\\p{N}]", f"[{numbers}]")):
        if old not in pattern:
            return None
        pattern = pattern.replace(old, new)
    return None if "\\p" in pattern or "\\s" in pattern else re.compile(f"[{letters}]+|{pattern}").findall


#: The pattern that latin_words follows.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPACES, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """What each character of Latin-1 is to the pattern."""
    first = {"L": _LETTER, "N": _NUMBER}
    return np.array([_SPACES if re.match(f"[{_SPACE}]", c := chr(i)) else first.get(unicodedata.category(c)[0], _OTHER) for i in range(256)], np.uint8)


_KINDS = _kinds()


def latin_words(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Starts and matches of _PATTERN in Latin-1 text, a byte a character, that ends in two characters of white space.

    Words are runs of letters or of other characters but numbers, and single numbers. An apostrophe by itself takes the letters of a
    contraction that follow it, and what is left of these letters is a word.
    """
    kind = _KINDS[data]
    inside = kind != _SPACES
    first = inside.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    at = np.flatnonzero(data == ord("'"))
    at = at[first[at] & (kind[at + 1] == _LETTER)]
    one, two = data[at + 1], data[at + 2]
    size = np.where(np.isin(one, list(b"stmd")), 1, 2 * (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))))
    at, size = at[size > 0], size[size > 0]
    first[at + 1] = False
    rest = at + 1 + size
    first[rest[kind[rest] == _LETTER]] = True
    text = data[inside]
    bounds = np.append(np.flatnonzero(first[inside]), len(text))
    return np.flatnonzero(first), pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text)])


class _Index(dict):
    """Places of pre-tokens; one that is new gets the next place and waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.waiting.append(word)
        return place


def _byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class WordTokens:
    """Ids of texts by the tokenizers library, its BPE model running once for each distinct pre-token.

    Meant for tokenizers whose normalizer is NFC, white space to one space, lower case, and whose pre-tokenizer keeps the matches of
    one pattern as byte-level words, dropping white space (word_bpe_49k.json). Pre-tokens are encoded independently by that model, so
    a text's ids are those of its pre-tokens in order. Texts of Latin-1 are split many at once and their distinct words found by Arrow;
    others by a regular expression. Texts beyond _LATIN, and tokenizers of another make, are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        made = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        before = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.split = None
        self.at_once = False
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"] and before[0]["invert"] and before[0]["behavior"] == "Removed" and not before[1]["add_prefix_space"] and not before[1]["use_regex"]:
            pattern = before[0]["pattern"].get("Regex", "")
            self.split, self.at_once = _splitter(pattern, 0x250), pattern == _PATTERN
        if self.split:
            self.words = Tokenizer(self.tokenizer.model)  # of byte letters, with spaces between words
            self.words.pre_tokenizer = WhitespaceSplit()
            suffix, names = made["model"].get("end_of_word_suffix"), made["model"]["vocab"]
            self.ends_word = np.zeros(1 + max(names.values()), bool)
            self.ends_word[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True
        self.narrow = re.compile("[^\\x00-\xff]").search
        self.beyond = re.compile(f"[^\\x00-{chr(_LATIN - 1)}]").search
        self.letters = np.array([ord(c) for c in _byte_letters()], "<u2")
        self.letters[ord(" ")] = ord(" ")  # pre-tokens have no white space
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        words, self.index.waiting = self.index.waiting, []
        shown = self.letters[np.frombuffer(" ".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)
        if len(sizes) != len(words):  # a model that doesn't mark the ends of words
            made = [[t.id for t in self.words.model.tokenize(w)] for w in shown.split(" ")]
            ids, sizes = np.array(list(itertools.chain.from_iterable(made)), np.uint32), np.array(list(map(len, made)), np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, ids))

    def _latin_places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of lower-case texts of Latin-1, and how many words each text has."""
        starts, words = latin_words(np.frombuffer("\n".join([*texts, "\n"]).encode("latin-1"), np.uint8))
        coded = words.dictionary_encode()
        _, bounds, held = coded.dictionary.buffers()
        bounds, held = np.frombuffer(bounds, np.int64)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes().decode("latin-1")
        places = np.fromiter(map(self.index.__getitem__, [held[i:j] for i, j in itertools.pairwise(bounds)]), np.int64, len(coded.dictionary))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return places[coded.indices.to_numpy()], np.diff(np.searchsorted(starts, ends), prepend=0)

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = list(map(self.split, texts))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        return np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as uint32; none for null."""
        out = [np.zeros(0, np.uint32)] * len(texts)
        latin: list[tuple[int, str]] = []
        wide: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.split is None or not text.isascii() and self.beyond(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
            (latin if self.at_once and (text.isascii() or not self.narrow(text)) else wide).append((i, text))
        if len(self.index) > KEPT_WORDS:
            self.reset()
        for part, places in ((latin, self._latin_places), (wide, self._places)):
            if not part:
                continue
            at, counts = places([t for _, t in part])
            if self.index.waiting:
                self._learn()
            sizes = self.sizes.take(at)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            ids = self.flat.take(np.arange(int(ends[-1])) + np.repeat(self.starts.take(at) - ends[:-1], sizes), mode="clip")
            cuts = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
            for k, (i, _) in enumerate(part):
                out[i] = ids[cuts[k] : cuts[k + 1]]
        return out


def id_kind(path: str) -> str:
    """The narrowest kind of integer that holds the tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def word_tokens(path: str) -> WordTokens:
    """One encoder for each path in a worker."""
    if path not in _cache:
        _cache[path] = WordTokens(path)
    return _cache[path]


def runs(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of texts of about limit characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encoding(path: str, doc_id: str = "doc_id", end_id: int = END_ID, kind: str = "<u4") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (id, text) to batches of (id, ids), ids as integers of a kind."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        end = np.array([end_id], kind)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_ROWS):  # texts become Python strings a slice at a time
                part = batch.slice(at, RUN_ROWS)
                texts = part.column(1).to_pylist()
                for first, last in runs(texts, RUN_CHARS):
                    made = encoder.encode(texts[first:last])
                    bounds = np.cumsum([0, *(len(x) + 1 for x in made)]) * end.itemsize
                    flat = np.concatenate([y for x in made for y in (x.astype(kind), end)])
                    ids = pa.Array.from_buffers(pa.large_binary(), len(made), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, last - first), ids], names=[doc_id, "ids"])

    return encode


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, with the end id) of each document; null text counts as empty."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("ids", T.BinaryType())])
    return docs.select(doc_id, text).transform(mapped, encoding(path, doc_id, end_id), schema, forget_words)
