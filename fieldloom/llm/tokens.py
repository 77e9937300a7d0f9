"""Token ids of whole texts by the ``tokenizers`` library, with a cache of what it gave for words.

A byte-level BPE first cuts a text by a fixed pattern and then merges within
each cut, so a text's ids are those of its cuts one after another.  In that
pattern a space belongs to what follows it: a place before a space is a border
of cuts unless white space stands on both sides of that space.  Texts are
therefore split at spaces and the pieces numbered by Arrow; each distinct piece
of a batch is cut once, and the library's model is asked once for each cut that
is not in the cache.  A cut by itself is cut no further, so that one cache serves
pieces and cuts.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from fieldloom.llm.memo import Memo

#: The published pattern of this kind of vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts encoded whole (RE2): white space on both sides of a space, or a character on whose class regular-expression libraries may differ.  So are texts with the string of an added token.
_WHOLE = (
    r"[\t-\r \x{a0}] (?:[\t-\r \x{a0}]|\z)|[\x{1c}-\x{1f}\x{85}]"
    r"|[^\x{00}-\x{24f}\x{370}-\x{52f}\x{5d0}-\x{5ea}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"
)
#: Bytes of text that one split covers at least, unless fewer are left.
_SPLIT = 1 << 23
#: Entries of a generation of the cache; they bound a worker's memory, not the result.
CACHED = 450_000

def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes; null counts as the empty text.

    Strings of special tokens in a text give their tokens, as the library does with the file as it is.
    """

    def __init__(self, path: str, cached: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        spec = json.loads(self.tokenizer.to_str())
        cut = spec.get("pre_tokenizer") or {}
        self.by_cuts = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.odd = "|".join([_WHOLE, *map(re.escape, added)])
        self.findall, self.merge = regex.compile(PATTERN).findall, self.tokenizer.model.tokenize
        self.pieces = Memo(self._piece, cached or CACHED)

    def whole(self, text: str) -> bytes:
        """The text in one call of the library."""
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        cuts = self.findall(piece)
        if len(cuts) == 1:
            return _packed([t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))])
        return b"".join(map(self.pieces.get, cuts))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every row of a string column, in order."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        row = 0
        while row < len(texts):
            before = sizes[row - 1] if row else 0
            end = min(len(texts), max(row + 1, int(np.searchsorted(sizes, before + _SPLIT, side="right"))))
            yield from self._split(texts.slice(row, end - row).fill_null("").cast(pa.large_string()))
            row = end

    def _split(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.by_cuts else np.ones(len(texts), dtype=bool)
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        edges, flat = parts.offsets.to_numpy(), parts.flatten()
        coded = flat.dictionary_encode()
        get = self.pieces.get
        ids = pa.array([get(" " + w) for w in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
        del coded
        begins = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else memoryview(b"")
        plain = 0
        for row, whole in enumerate(odd.tolist()):
            if whole:
                text = texts[row].as_py()
                yield self.whole(text) if text else b""
                continue
            first, last = edges[plain] - edges[0], edges[plain + 1] - edges[0]
            plain += 1
            if first == last:
                yield b""
                continue
            word = flat[int(first)].as_py()
            yield (get(word) if word else b"") + bytes(data[begins[first + 1] : begins[last]])


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, cached: int | None = None) -> Encoder:
    """One encoder per process, vocabulary file and size of the cache (CACHED if not given), for the ids of the library as loaded."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = Encoder(path, cached)
    return _encoders[path, cached]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
