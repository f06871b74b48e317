"""Whole texts to token ids with a public tokenizer, in Arrow batches."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from repotide.llm.common import keeps

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Entries kept before the cache of chunks starts afresh, ids kept for each of them; bounds memory, never results.
CACHE, CACHE_IDS = 600_000, 8
#: Chunks that are encoded in one go.
TOGETHER = 4096

_SPACED = re.compile(r" \s")
_CHUNKS = re.compile(r" (?=\S)")
#: Letters whose class no Unicode version changes; ASCII punctuation but for what starts a contraction or a special token.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſЁёА-я", r'!-&(-/:;=-@\[-`{-~'
_PLAIN = re.compile(rf"\0?(?:[{_LETTERS}0-9{_MARKS}]|\n(?!\n))+")
_PIECES = re.compile(rf"[ \0]?[{_LETTERS}]+|[ \0]?[0-9]+|[ \0]?[{_MARKS}]+|\0?\n")
#: A word always ends before these, and a line's first word starts a new one.
_STOPS = ',.;:!?")\n'
_AFTER_WORD, _NEW_LINE = re.compile(rf"[{_STOPS}](?<=[{_LETTERS}0-9].)", re.DOTALL), re.compile(rf"\n(?<=[{_LETTERS}0-9{_MARKS}]\n)(?=[{_LETTERS}])")
_ENCODERS: dict[str, ChunkEncoder] = {}


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary; 0 stays, it separates."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted({*range(256)} - {*shown})
    return {b: 256 + k for k, b in enumerate(hidden) if b} | {b: b for b in shown}


_BYTE_LETTERS = _byte_letters()


class ChunkEncoder:
    """Ids of whole texts, equal to encoding them in one go.

    The byte-level tokenizer first cuts a text into words with their leading blank, and a blank before a
    visible character always starts one. So a text may be cut at those blanks, and each different chunk
    has to be encoded only once. So may it before a mark that follows a letter, and after a single line end before one.
    A chunk of plain letters, digits and marks is cut on into the words that the tokenizer would make of it, and those
    not known go to its model without being cut again.

    Keys: a chunk after a blank stands without it, anything without a blank before it is marked by a zero character.
    """

    def __init__(self, path: str = BYTE_BPE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # Bytes of text that each id stands for: a byte-level vocabulary has one character for each byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(added[i].encode()) if i in added else len(token)
        self.words = Tokenizer(self.tokenizer.model)
        self.plain = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer) == str(
            ByteLevel(add_prefix_space=False)) and all("<" in t and not {*t} & {*_STOPS} for t in added.values())
        self._forget()

    def _forget(self) -> None:
        """No chunk is known. The ids of chunk ``known[key]`` stand in ``pool`` from ``first`` on."""
        self.known: dict[str, int] = {}
        self.used = 0
        self.pool, self.first, self.count = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _keep(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Know the chunks ``keys``, whose ids follow each other in ``ids``."""
        have = len(self.known)
        if have + len(keys) > len(self.first):
            more = np.zeros(max(len(self.first) // 2, len(keys)), np.int64)
            self.first, self.count = np.concatenate([self.first, more]), np.concatenate([self.count, more])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, len(ids)), "<u4")])
        self.known.update(zip(keys, range(have, have + len(keys)), strict=True))
        self.count[have:have + len(keys)] = counts
        self.first[have:have + len(keys)] = self.used + np.cumsum(counts) - counts
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _cut(self, keys: list[str], ids: np.ndarray, sizes: list[int]) -> None:
        """Know the chunks ``keys`` of so many bytes each, encoded together as ``ids``."""
        stops = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes), "right")
        self._keep(keys, ids, np.diff(stops, prepend=0))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks ``at`` in a row, and where each chunk ends in them."""
        counts = self.count[at]
        ends = np.cumsum(counts)
        places = np.repeat(self.first[at] - (ends - counts), counts)
        places += np.arange(len(places))
        return self.pool[places], ends

    def _learn(self, keys: list[str]) -> None:
        """Encode chunks that start with a blank before a visible character, many in one go, and cut the
        ids at the chunks' ends."""
        for start in range(0, len(keys), TOGETHER):
            some = keys[start:start + TOGETHER]
            text = " " + " ".join(some)
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            self._cut(some, ids, [1 + len(c.encode("utf-8", "surrogatepass")) for c in some])

    def _learn_plain(self, chunks: list[str]) -> None:
        """The same for chunks of plain characters, by the words in them."""
        pieces = _PIECES.findall("".join([c if c[0] == "\0" else " " + c for c in chunks]))
        keys = [p[1:] if p[0] == " " else p if p[0] == "\0" else "\0" + p for p in pieces]
        new = list(set(keys) - self.known.keys())
        for start in range(0, len(new), TOGETHER):
            some = new[start:start + TOGETHER]
            data = "\0".join([k[1:] if k[0] == "\0" else " " + k for k in some]).encode()
            words = data.decode("latin-1").translate(_BYTE_LETTERS).split("\0")
            ids = self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids
            self._cut(some, np.asarray(ids, "<u4"), [len(w) for w in words])
        # Every chunk starts with a word that has a blank or the mark; those of more than one word are put together.
        begin = np.flatnonzero(np.array([p[0] in " \0" for p in pieces], bool))
        sizes = np.diff(begin, append=len(pieces))
        many = np.flatnonzero(sizes > 1)
        if len(many):
            inside = [keys[i] for i in np.flatnonzero(np.repeat(sizes > 1, sizes)).tolist()]
            ids, ends = self._gather(np.fromiter(map(self.known.__getitem__, inside), np.int64, len(inside)))
            self._keep([chunks[i] for i in many.tolist()], ids, np.diff(ends[np.cumsum(sizes[many]) - 1], prepend=0))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts in a row, and where each text ends in them; none for null or empty."""
        if len(self.known) > CACHE or self.used > CACHE * CACHE_IDS:
            self._forget()
        cut: list[str] = []
        stops = []
        for text in texts:
            text = text or ""
            here = len(cut)
            if "\0" in text:  # the mark; such a text is encoded in one go
                cut.append(text)
            else:
                if self.plain:
                    text = _AFTER_WORD.sub(" \0\\g<0>", _NEW_LINE.sub("\n \0", text))
                cut += _CHUNKS.split(text) if _SPACED.search(text) else text.split(" ")
            # The first chunk has no blank before it.
            cut[here] = "\0" + cut[here]
            stops.append(len(cut))
        coded = pa.array(cut, pa.large_string()).dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            plain, rest, lone = [], [], []
            for c in new:
                (plain if self.plain and _PLAIN.fullmatch(c) else lone if not c or c[0] == "\0" else rest).append(c)
            self._learn_plain(plain)
            self._learn(rest)
            # "": a blank at the end of a text
            got = [e.ids for e in self.tokenizer.encode_batch_fast([c[1:] if c else " " for c in lone], add_special_tokens=False)]
            self._keep(lone, np.asarray([i for ids in got for i in ids], "<u4"), np.asarray([len(ids) for ids in got], np.int64))
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        ids, ends = self._gather(at[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, ends[np.asarray(stops, np.int64) - 1]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null or empty."""
        ids, ends = self.encode_flat(texts)
        data, begin, out = ids.tobytes(), 0, []
        for stop in (4 * ends).tolist():
            out.append(data[begin:stop])
            begin = stop
        return out


keeps("tokens", _ENCODERS.clear)


def encoder(path: str = BYTE_BPE) -> ChunkEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def batches(rows: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in slices of at most about ``size`` characters, so that memory stays bounded."""
    texts, start, chars = [], 0, 0
    for i, value in enumerate(rows.column(column)):
        text = value.as_py()
        texts.append(text)
        chars += len(text or "")
        if chars >= size:
            yield start, texts
            texts, start, chars = [], i + 1, 0
    if texts:
        yield start, texts


def crc(data: bytes | memoryview) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
