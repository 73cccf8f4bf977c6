"""Ids of whole texts by way of their words.

Both vocabularies cut a text before they merge: no token reaches over the places at which these
functions cut it. So the ids of a text are those of its parts in order. Arrow finds and numbers the
different words of a run of texts and the parts of those, each different part is encoded once (and
kept in a cache of two generations of bounded size), and numpy puts the ids of all occurrences in order.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BEFORE_SPACE = re.compile(r"(?= \S)")
#: Letters that normalising changes in case at most, and marks of which a run is one match.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", r"!-&(-/:-@\[-`{-~"
#: Letters, perhaps marks, perhaps the end of a line with letters and marks after it: each part is a match of its own.
_PARTS = rf"^(?P<a>[{_LETTERS}]+)(?P<b>[{_MARKS}]*)(?:\n(?P<c>[{_LETTERS}]+)(?P<d>[{_MARKS}]*))?$"
#: Bytes of text, and occurrences of words, that are gone through at once.
TEXT, WORDS = 16_000_000, 1 << 20


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b if b in shown else 256 + sum(x not in shown for x in range(b)) for b in range(256)}


#: Packed forms of ids.
_PACKED = [k.to_bytes(4, "little") for k in range(1 << 16)]


def _packed(tokens: list) -> bytes:
    return _PACKED[tokens[0].id] if len(tokens) == 1 else b"".join([_PACKED[t.id] for t in tokens])


@contextmanager
def no_collection():
    """Nothing here makes cycles, but looking for them among millions of words takes a third of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordCache:
    """word -> packed ids, by encode_many for the words not held. The limit bounds memory, not the result."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int):
        self.encode_many, self.limit = encode_many, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, words: list[str]) -> list[bytes]:
        """The ids of each word; words are different."""
        if len(self.young) + len(words) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = [k for k, x in enumerate(out) if x is None]
        if old and missing:
            for k in missing:
                if (found := old.get(words[k])) is not None:
                    out[k] = young[words[k]] = found
            missing = [k for k in missing if out[k] is None]
        if missing:
            for k, found in zip(missing, self.encode_many([words[k] for k in missing]), strict=True):
                out[k] = young[words[k]] = found
        return out


class Pool:
    """Packed ids of numbered things, number 0 being nothing."""

    def __init__(self):
        self.parts: list[bytes] = [b""]

    def add(self, parts: list[bytes]) -> int:
        """Number of the first."""
        self.parts += parts
        return len(self.parts) - len(parts)

    def sealed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each thing's begin, and how many they are."""
        sizes = np.fromiter(map(len, self.parts), np.int64, len(self.parts)) // 4
        return np.frombuffer(b"".join(self.parts), "<u4"), np.cumsum(sizes) - sizes, sizes


def _in_order(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of numbered things one after the other, and after how many ids each ends (0 first)."""
    parts, stops = [ids[:0]], np.zeros(len(numbers) + 1, np.int64)
    for k in range(0, len(numbers), WORDS):
        own = numbers[k : k + WORDS]
        n = sizes[own]
        stop = np.cumsum(n)
        parts.append(ids[np.arange(stop[-1]) + np.repeat(begins[own] - stop + n, n)])
        stops[k + 1 : k + 1 + len(own)] = stop + stops[k]
    return parts[1] if len(parts) == 2 else np.concatenate(parts), stops


def _composed(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same three for things that are made of one part from each column."""
    table = np.stack(columns, 1)
    ids, stops = _in_order(ids, begins, sizes, table.ravel())
    ends = stops[:: table.shape[1]]
    return ids, ends[:-1], np.diff(ends)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """What stands between spaces: number of each word's form, the forms, and where each text's words begin and end."""
    lists = pc.split_pattern(texts, " ")
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
    forms = lists.flatten().dictionary_encode()
    return np.asarray(forms.indices).astype(np.int64), forms.dictionary, bounds


def _numbered(pool: Pool, cache: WordCache, parts: pa.Array, before: str = "") -> np.ndarray:
    """Numbers in the pool of the parts, which the cache knows with before in front; nulls and empty parts are nothing."""
    coded = parts.dictionary_encode()
    names = coded.dictionary.to_pylist()
    first = pool.add(cache.get([before + w for w in names] if before else names))
    numbers = np.append(np.where([bool(w) for w in names], first + np.arange(len(names)), 0), 0).astype(np.int64)
    return numbers[np.asarray(pc.fill_null(coded.indices, len(names)))]


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of a batch that hold about TEXT bytes each, nulls as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    stops = np.cumsum(np.asarray(pc.binary_length(texts)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + TEXT, "right")))
        yield texts.slice(at, end - at)
        at = end


def _texts(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = memoryview(np.ascontiguousarray(ids)).cast("B")
    at = (4 * ends).tolist()
    return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


class WordVocabulary:
    """Ids by the tokenizers library for a vocabulary that drops white space (lower-cased words with word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.written = _byte_letters()
        self.bases, self.others = WordCache(self._normal, 1_000_000), WordCache(self._general, 50_000)

    def _general(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _normal(self, words: list[str]) -> list[bytes]:
        """Words that are one match and normal already go to the library's model."""
        tokenize = self.tokenizer.model.tokenize
        return [_packed(tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.written))) if w else b"" for w in words]

    def _forms(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = pc.extract_regex(forms, _PARTS)
        one, pool = found.is_valid(), Pool()
        base = _numbered(pool, self.bases, pc.utf8_lower(found.field("a")))
        mark = _numbered(pool, self.others, found.field("b"))
        other = _numbered(pool, self.others, pc.if_else(one, pa.scalar("", forms.type), forms))
        return _composed(*pool.sealed(), [base, mark, other])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text; null is the empty text."""
        out: list[bytes] = []
        with no_collection():
            for run in _runs(texts):
                numbers, forms, bounds = _words(pc.replace_substring(run, "\n", " "))
                ids, stops = _in_order(*self._forms(forms), numbers)
                out += _texts(ids, stops[bounds])
        return out


class ByteVocabulary:
    """Ids for a byte-level vocabulary whose pattern glues one space to the front of a word.

    A text is cut before each space that a non-space follows. whole gives the ids of letters that are
    one match (of a space and letters, if so written), plain those of any other stretch of text.
    """

    def __init__(self, whole: Callable[[list[str]], list[bytes]], plain: Callable[[list[str]], list[bytes]]):
        self.whole, self.plain = WordCache(whole, 1_000_000), WordCache(plain, 50_000)

    def _forms(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of " word" for words that don't begin with white space; an empty word is nothing."""
        found = pc.extract_regex(forms, _PARTS)
        one, pool = pc.or_(found.is_valid(), pc.equal(forms, "")), Pool()
        line = pool.add(self.plain.get(["\n"]))
        base, mark = _numbered(pool, self.whole, found.field("a"), " "), _numbered(pool, self.plain, found.field("b"))
        later, last = _numbered(pool, self.whole, found.field("c")), _numbered(pool, self.plain, found.field("d"))
        other = _numbered(pool, self.plain, pc.if_else(one, pa.scalar("", forms.type), pc.binary_join_element_wise(pa.scalar("", forms.type), forms, pa.scalar(" ", forms.type))))
        return _composed(*pool.sealed(), [base, mark, np.where(later > 0, line, 0), later, last, other])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text; null is the empty text."""
        out: list[bytes] = []
        with no_collection():
            for run in _runs(texts):
                numbers, forms, bounds = _words(run)
                heads = bounds[:-1]
                loose = np.asarray(pc.match_substring_regex(forms, r"^(\s|$)|^[^\x00-\x7F]").cast(pa.uint8())) == 1
                if loose.any():  # a space before white space, or at the end
                    named = [w == "" or w[0].isspace() for w in forms.filter(pa.array(loose)).to_pylist()]
                    loose[np.flatnonzero(loose)[~np.array(named)]] = False
                behind = np.ones(len(numbers), bool)
                behind[heads] = False
                odd = loose[numbers] & behind
                spaced = np.zeros(len(forms), bool)
                spaced[numbers[behind]] = True
                ids, begins, sizes = self._forms(pc.if_else(pa.array(spaced & ~loose), forms, pa.scalar("", forms.type)))
                first = forms.take(pa.array(numbers[heads])).dictionary_encode()
                pool = Pool()
                pool.parts = self.plain.get(first.dictionary.to_pylist())
                more, at, n = pool.sealed()
                numbers[heads] = len(sizes) + np.asarray(first.indices)
                ids, stops = _in_order(np.concatenate([ids, more]), np.concatenate([begins, at + len(ids)]), np.concatenate([sizes, n]), numbers)
                new = _texts(ids, stops[bounds])
                for k in np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1).tolist():
                    new[k] = self._loose(run[k].as_py())
                out += new
        return out

    def _loose(self, text: str) -> bytes:
        parts = _BEFORE_SPACE.split(text)
        names = [*dict.fromkeys(parts)]
        ids = dict(zip(names, self.plain.get(names), strict=True))
        return b"".join([ids[p] for p in parts])


def byte_vocabulary(path: str) -> ByteVocabulary:
    """By the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    written = _byte_letters()

    def plain(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(words: list[str]) -> list[bytes]:
        """A match goes to the library's model as the vocabulary writes bytes."""
        tokenize = tokenizer.model.tokenize
        return [_packed(tokenize((w if w.isascii() else w.encode().decode("latin-1")).translate(written))) if w else b"" for w in words]

    return ByteVocabulary(whole, plain)
