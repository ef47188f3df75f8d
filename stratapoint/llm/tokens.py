"""Token ids of whole texts by a file of the tokenizers library, at the speed of a dictionary.

Both vocabularies split a text into pieces that do not influence each other. A text is cut only where such a border is
certain: before a single space between two other characters, around a line feed between two others, and, where the
pre-tokenizer drops white space, at every space. Each segment goes through the library's own ``encode`` once, and its ids
are kept in a bounded dictionary; only words of Latin-1 letters, which are one piece, go straight to the library's model.
Texts with a special token of the file in them go to ``encode`` whole. Columns of texts are cut and looked up by Arrow, so that
a segment costs a dictionary's time once a batch and not at each place (``encode_all``). So ``encode`` here gives exactly what
``Tokenizer.encode(text, add_special_tokens=False)`` gives for every string, special tokens' names included.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from stratapoint.llm.text import claim, classes, distinct, flat, parts

#: The end of a document in every operator here.
END_ID = 0
END = END_ID.to_bytes(4, "little")
#: A single space between two other characters always starts a piece of the byte-level pattern.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_DOUBLE = re.compile(r"\s\s")
#: ASCII white space is 1, first bytes of other white space (and of much else) 2, the byte 0 is 4.
_BYTES = bytes(1 if chr(c).isspace() and c < 128 else 2 if c in (0xC2, 0xE1, 0xE2, 0xE3) else 4 if c == 0 else 0 for c in range(256))
#: Letters of Latin-1 and the bytes of their UTF-8 (beyond ASCII only behind 0xC3) are 1, marks 2, space 3, all else 0.
_PARTS = bytes(1 if chr(c).isalpha() and c < 128 or c == 0xC3 or 0x80 <= c < 0xC0 else 3 if c == 32 else 2 if 32 < c < 127 and chr(c) not in "'0123456789" else 0 for c in range(256))
#: Texts are cut in parts of about so many bytes, and so many segments are looked up at a time.
PART_BYTES = 1 << 20
_SEGMENTS = 1 << 20
#: Letters of Latin-1, which are one piece and no normalizer changes but for case, and marks behind them, which are another.
_WORD = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
#: The letters that byte-level vocabularies write for the bytes of these letters: printable ones stand for themselves.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = dict(zip([b for b in range(256) if b not in _OWN], map(chr, range(256, 512)), strict=False))
#: The same for the characters of Latin-1, whose UTF-8 is one byte or two.
_SPELT = {c: chr(c).encode().decode("latin-1").translate(_LETTERS) for c in range(256)}


class _Pieces(dict):
    """Segment of a text -> its ids as little-endian unsigned 32-bit integers.

    Half of the limit is for segments seen lately, the other for those before them, so that common ones stay.
    """

    LIMIT = 400_000

    def __init__(self, file: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(file)
        self.model, self.drops_space = self.own.model, drops_space
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self[""] = b""
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = self._ids(piece)
        if 2 * len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        if piece.isascii() and (piece.isalpha() or piece[0] == " " and piece[1:].isalpha()):  # most pieces, by a shorter way
            name = piece.lower() if self.drops_space else piece.replace(" ", _LETTERS[32])
        elif (m := _WORD.fullmatch(piece)) is None:
            return self.whole(piece)
        elif m[3]:
            return self[m[1] + m[2]] + self[m[3]]
        else:
            name = (m[2].lower() if self.drops_space else piece).translate(_SPELT)
        found = self.model.tokenize(name)
        return found[0].id.to_bytes(4, "little") if len(found) == 1 else array("I", [t.id for t in found]).tobytes()


class Encoder:
    """file: a path of a tokenizers file; drops_space: whether its pre-tokenizer drops all white space."""

    def __init__(self, file: str, drops_space: bool):
        self.pieces, self.drops_space = _Pieces(file, drops_space), drops_space
        self.vocabulary = self.pieces.own.get_vocab_size()

    def encode(self, text: str) -> bytes:
        """The ids, 4 bytes each, without the end id."""
        if any(t in text for t in self.pieces.special):
            return self.pieces.whole(text)
        if self.drops_space:
            cut = text.replace("\n", " ").split(" ")
        elif "\0" not in text and not _DOUBLE.search(text):
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        else:
            cut = _SAFE.split(text)
        return b"".join(map(self.pieces.__getitem__, cut))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of each text of a string column, null as empty."""
        return [ids for a, z in parts(flat(texts)[1], PART_BYTES) for ids in self._encode_part(texts.slice(a, z - a))]

    def _encode_part(self, texts: pa.Array) -> list[bytes]:
        data, rows = flat(texts)
        odd = self._odd(texts, data, rows)
        if odd.any():
            data, rows = flat(texts.filter(pa.array(~odd)))
        plain = iter(self._plain(data, rows))
        return [self.encode(texts[i].as_py() or "") if x else next(plain) for i, x in enumerate(odd.tolist())]

    def _odd(self, texts: pa.Array, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which texts ``encode`` does not simply cut at every space and line feed."""
        odd = np.zeros(len(texts), bool)
        for t in self.pieces.special:
            odd |= pc.match_substring(texts, t).fill_null(False).to_numpy(zero_copy_only=False)
        if self.drops_space or not len(data):
            return odd
        kinds = classes(data, _BYTES)
        row_of = lambda at: np.unique(np.searchsorted(rows, at, side="right") - 1)
        odd[row_of(np.flatnonzero(kinds == 4))] = True
        odd[row_of(np.flatnonzero(kinds[1:] & kinds[:-1] & 1))] = True  # may take the end of one text with the start of the next: slower, not wrong
        for i in row_of(np.flatnonzero(kinds == 2)).tolist():
            odd[i] = odd[i] or _DOUBLE.search(texts[i].as_py()) is not None
        return odd

    @staticmethod
    def _part(data: np.ndarray, first: np.ndarray) -> None:
        """Cuts segments that are a word with marks behind it (those of ``_WORD``) in two, given where segments start."""
        part = classes(data, _PARTS).copy()
        high = np.flatnonzero(data == 0xC3)
        part[high[np.isin(data[high + 1], (0x97, 0xB7))]] = 0  # the signs of times and division
        change = first.copy()
        change[1:-1] |= part[1:] != part[:-1]
        runs = np.flatnonzero(change[:-1])
        own, opens = part[runs], first[runs]
        led = opens.copy()  # the run, or the space before it, opens its segment
        led[1:] |= (own[:-1] == 3) & opens[:-1]
        ends = np.append(opens[1:], True)
        marks = np.flatnonzero((own[1:] == 2) & ~opens[1:] & ends[1:] & (own[:-1] == 1) & led[:-1]) + 1
        first[runs[marks]] = True

    def _plain(self, data: np.ndarray, rows: np.ndarray) -> list[bytes]:
        first = np.zeros(len(data) + 1, bool)
        feed = data == 10
        np.logical_or(data == 32, feed, out=first[:-1])
        if not self.drops_space:
            first[1:] |= feed
        first[rows] = True
        self._part(data, first)
        starts = np.flatnonzero(first)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for a in range(0, len(starts) - 1, _SEGMENTS):
            names, which = distinct(data, starts[a : a + _SEGMENTS + 1], pa.large_string())
            cut = names.to_pylist()
            if self.drops_space:
                cut = [x[1:] if x[0] in " \n" else x for x in cut]
            found = list(map(self.pieces.__getitem__, cut))
            n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            at, n = (np.cumsum(n) - n)[which], n[which]
            end = np.cumsum(n)
            ids.append(np.frombuffer(b"".join(found), "<u4")[np.arange(end[-1]) + np.repeat(at - end + n, n)])
            sizes.append(n)
        out = np.concatenate(ids)
        bounds = np.cumsum(np.concatenate(sizes))[np.searchsorted(starts, rows)].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@cache
def _encoder(name: str) -> Encoder:
    file = name if "/" in name else public_tokenizers.path(name)
    return Encoder(str(file), drops_space="word" in name.rpartition("/")[2])


def encoder(name: str) -> Encoder:
    """One encoder a worker process; name: a path, or a file name that public_tokenizers knows."""
    claim("tokens", _encoder.cache_clear)
    return _encoder(name)
