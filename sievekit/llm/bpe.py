"""Byte-level BPE encoding and decoding.

A word's parts are held as a short array of ids with a second array of the ranks of neighbours. The smallest
rank is found by a scan, its boundary is deleted, and the ranks of the two new neighbours are looked up, until
no pair has a rank. The words that some texts have new are merged side by side: their arrays are the rows of a matrix,
which gets narrower with each boundary and loses the words that are done. Words above SHORT parts use the same merges
through a heap, which gives the same ids without the square of the length. Words seen before in a worker come from a
bounded table of two generations.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievekit.llm.common import map_rows

#: The published split pattern of this tokenizer, and the same for texts with no character above U+00FF.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
SHORT, CACHE = 128, 100_000
#: Widths of the matrices in which new words are merged, and characters of the texts that are split together.
WIDTHS, TOGETHER = (8, 12, 16, 24, 40, 72, SHORT), 1 << 20
NO_RANK, _ID = (1 << 31) - 1, (1 << 32) - 1


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _latin(text: str) -> bool:
    """No character is above U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Tokenizer:
    """Encodes and decodes as the file at path says; the file is read where this object is made."""

    def __init__(self, path: str, kept: int = CACHE):
        """kept: words of a generation, beyond those of the texts at hand."""
        self.kept = kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        self.byte_id = [vocab.get(c) for c in chars]
        self.merges: dict[int, int] = {}  # a pair's two ids: its rank, then the id that it becomes
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        made = np.array(sorted((pair, m >> 32, m & _ID) for pair, m in self.merges.items()) + [((1 << 63) - 1, NO_RANK, 0)], np.int64)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(made[:, 0]), made[:, 1].astype(np.int32)
        self.merged_ids = np.full(len(spec["model"]["merges"]), -1, np.int32)
        self.merged_ids[made[:-1, 1]] = made[:-1, 2]
        self.byte_ids = np.array([*self.byte_id, -1], np.int32)  # the last stands for no byte
        self.byte_ranks = self.ranks(*np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(chars)}
        self.piece = {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in vocab.items()}
        self.piece |= {i: token.encode() for token, i in self.special.items()}
        self.table = np.empty(max(self.piece) + 1, object)
        for i in range(len(self.table)):
            self.table[i] = self.piece.get(i, b"")
        self.pieces = self.table.tolist()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split, self.latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NO_RANK for pairs that don't merge and those with a place (-1) that no part holds."""
        pair = left.astype(np.int64) << 32 | right
        at = self.pair_keys.searchsorted(pair)
        return np.where(self.pair_keys[at] == pair, self.pair_ranks[at], NO_RANK)

    def merge_side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        """The packed ids of words of 1 to width bytes, in their order."""
        size, width = np.array([len(w) for w in words]), width + 1  # the last place stays empty
        data = np.full((len(words), width), 256, np.int16)
        data[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids, ranks = self.byte_ids[data], self.byte_ranks[data[:, :-1], data[:, 1:]]
        out, live = [b""] * len(words), np.arange(len(words))
        while len(live):
            best = ranks.argmin(1)  # of equal ranks the leftmost
            rank = ranks[np.arange(len(live)), best]
            done = rank == NO_RANK
            if done.any():
                held = ids[done]
                ends = (4 * np.cumsum((held >= 0).sum(1))).tolist()
                packed = held[held >= 0].astype("<u4").tobytes()
                for word, begin, end in zip(live[done].tolist(), [0, *ends], ends, strict=False):
                    out[word] = packed[begin:end]
                more = ~done
                live, ids, ranks, best, rank = live[more], ids[more], ranks[more], best[more], rank[more]
                if not len(live):
                    break
            row, width = np.arange(len(live)), width - 1
            ids[row, best] = self.merged_ids[rank]
            ids = ids[np.arange(width + 1) != best[:, None] + 1].reshape(-1, width)
            ranks = ranks[np.arange(width) != best[:, None]].reshape(-1, width - 1)
            inner = np.flatnonzero(best > 0)
            k = best[inner]
            ranks[inner, k - 1] = self.ranks(ids[inner, k - 1], ids[inner, k])
            inner = np.flatnonzero(best < width - 1)
            k = best[inner]
            ranks[inner, k] = self.ranks(ids[inner, k], ids[inner, k + 1])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m >> 32, i, ids[i], ids[i + 1], m & _ID) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := get(new << 32 | ids[k]):
                    heapq.heappush(heap, (m >> 32, i, new, ids[k], m & _ID))
            if (h := before[i]) >= 0 and (m := get(ids[h] << 32 | new)):
                heapq.heappush(heap, (m >> 32, h, ids[h], new, m & _ID))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[str]) -> list[bytes]:
        """The packed ids of words."""
        coded, out = [w.encode("utf-8", "replace") for w in words], [b""] * len(words)
        size = np.array([len(w) for w in coded])
        for low, width in pairwise((1, *WIDTHS)):
            own = np.flatnonzero((size > low) & (size <= width)).tolist()
            for i, packed in zip(own, self.merge_side_by_side([coded[i] for i in own], width), strict=True):
                out[i] = packed
        for i in np.flatnonzero((size == 1) | (size > SHORT)).tolist():
            ids = self.merge_long([self.byte_id[b] for b in coded[i]])
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def learn(self, words: set[str]) -> None:
        """Put words that the table doesn't hold into it; those of the older generation come over."""
        new = []
        for w in words:
            packed = self.older.get(w)
            if packed is None:
                new.append(w)
            else:
                self.cache[w] = packed
        self.cache.update(zip(new, self.merge(new), strict=True))

    def words(self, text: str) -> list[str]:
        if text.isascii() or _latin(text):
            return self.latin(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            # characters that this Python does not know may be letters to the tokenizers library: it splits these texts
            from tokenizers.pre_tokenizers import ByteLevel

            return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
        return self.split(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out, begin = [], 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and held < TOGETHER:
                held += len(texts[end] or "")
                end += 1
            out += self._together(texts[begin:end])
            begin = end
        return out

    def _together(self, texts: list[str | None]) -> list[bytes]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            text = text or ""
            for part in self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else (text,):
                parts.append(part if part in self.special else self.words(part))
                owner.append(i)
        split = [p for p in parts if isinstance(p, list)]
        new = set().union(*split).difference(self.cache)
        self.learn(new)
        known = self.cache.__getitem__
        out = [b""] * len(texts)
        for i, part in zip(owner, parts, strict=True):
            out[i] += b"".join(map(known, part)) if isinstance(part, list) else self.special[part].to_bytes(4, "little")
        for w in new:
            if len(w) > 64:
                del self.cache[w]
        if len(self.cache) > self.kept:  # words in use come over from the older generation one by one
            self.older, self.cache = self.cache, {}
        return out

    def decode(self, packed: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


_OPEN: dict[str, Tokenizer] = {}


def tokenizer(path: str, kept: int = CACHE) -> Tokenizer:
    """One per Python worker; the vocabulary is installed on every machine. kept: words of a generation."""
    if path not in _OPEN:
        _OPEN[path] = Tokenizer(path)
    _OPEN[path].kept = kept
    return _OPEN[path]


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document, or its columns in keep), n_tokens and token_ids (packed little-endian unsigned 32-bit integers).

    Null and empty texts have no token. Control strings of the vocabulary in a text become their own id.
    """

    def setup():
        t = tokenizer(path)

        def run(texts):
            ids = t.encode_all(texts)
            return [[len(x) // 4 for x in ids], pa.array(ids, pa.binary())]

        return run

    return map_rows(docs, ["text"], setup, "n_tokens long, token_ids binary", keep)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``row`` (the input row) and decoded_text, from a frame with token_ids; null ids give an empty text."""

    def setup():
        t = tokenizer(path)
        return lambda packed: [[t.decode(x or b"") for x in packed]]

    return map_rows(encoded, ["token_ids"], setup, "decoded_text string")
