"""Token ids of whole texts by a public tokenizer file, the pieces between blanks encoded once and remembered."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Latin letters that both files keep as one stretch, lower-cased one to one (U+0130 becomes two characters).
_LETTERS_ONLY = re.compile("([ \n]?)([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)")
#: White space beyond ASCII: it may join a run of blanks, so such texts are encoded as a whole.
_WIDE_BLANK = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What an ASCII byte is: 1 a blank, 2 a mark other than the apostrophe, 3 a letter.
_KIND = np.array([1 if b in b"\t\n\v\f\r " else 3 if chr(b).isalpha() else 2 if 33 <= b < 127 and b != 39 and not chr(b).isdigit() else 0 for b in range(128)] + [0] * 128, dtype=np.uint8)
_ENCODERS: dict = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where visible, else from 256 up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def cut_pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the joined bytes of texts that begin at starts (all of them non-empty).

    A piece is what stands between blanks, led by the last blank of the run before it; the rest of a longer run, and a
    run that ends a text, is a piece of its own. Marks behind a letter begin a piece too. No token of either file
    crosses such a cut: their patterns take a run of blanks without its last one, that last one alone or with what
    follows, and letters apart from marks (but for the apostrophe).
    """
    kind = _KIND[data]
    blank, first = kind == 1, np.zeros(len(data), dtype=bool)
    first[starts] = True
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins |= blank & first  # a run's first blank
    lasts = blank
    lasts[:-1] &= ~blank[1:] & ~first[1:]  # its last one, with more of the text behind it
    lasts[-1:] = False
    begins |= lasts | first
    marks = np.flatnonzero(kind == 2)
    marks = marks[marks > 1]
    before, lead = data[marks - 1], data[marks - 2]
    latin = (lead >= 0xC3) & (lead <= 0xC5) & (before >= 0x80)  # U+00C0 to U+017F: all letters but these three
    latin &= ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))) & ~((lead == 0xC4) & (before == 0xB0))
    begins[marks[(kind[marks - 1] == 3) | latin]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts as integers of kind, by the public BPE file at path.

    The two files split texts so that no token crosses the cuts of cut_pieces. The distinct pieces of a batch are
    looked up in the remembered ones, both as Arrow arrays, and the new ones are encoded: words by the model alone, all
    else by the library. Ids are then laid out by array operations. Files of another kind, and texts that hold an added
    token or white space beyond ASCII, are encoded by the library as a whole. Beyond `most` remembered pieces only those
    of the last batch stay.
    """

    def __init__(self, path: str, kind: str = "<u2", most: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.most = np.dtype(kind), most
        spec = json.loads(self.tokenizer.to_str())
        pre, normal = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        byte_level = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normal
        steps = [p["type"] for p in pre.get("pretokenizers", [])]
        lower = steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.by_piece = (byte_level or lower) and self.tokenizer.get_vocab_size() <= np.iinfo(self.kind).max
        self.whole_only = "|".join([_WIDE_BLANK, *("(?i)" + re.escape(t["content"]) for t in spec["added_tokens"])])
        self.lower = lower
        self.tokenize = self.tokenizer.model.tokenize
        self.raw = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())] if self.by_piece else []
        self.pieces = pa.array([], pa.binary())
        self.table, self.begin, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> bytes:
        """Ids of any text by the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def piece(self, key: bytes) -> bytes:
        """Ids of one piece."""
        text = key.decode("utf-8", "replace")
        plain = _LETTERS_ONLY.fullmatch(text)
        if not plain:
            return self.whole(text)
        lead, word = plain.groups()
        head = b""
        if self.lower:
            word = word.lower()
        elif lead == " ":
            word = text
        elif lead:
            head = self.whole(lead)
        raw = self.raw
        return head + b"".join([raw[t.id] for t in self.tokenize(word.encode().decode("latin-1").translate(_LETTERS))])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); null texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.by_piece:
            apart = pc.match_substring_regex(texts, self.whole_only).to_numpy(zero_copy_only=False)
        else:
            apart = np.ones(len(texts), dtype=bool)
        ids, counts = self._by_pieces(texts.filter(pa.array(~apart)) if apart.any() else texts)
        if not apart.any():
            return ids, counts
        parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else ())
        out = [np.frombuffer(self.whole(t.as_py()), self.kind) if alone else next(parts) for t, alone in zip(texts, apart, strict=True)]
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        if bounds[-1] == bounds[0]:
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cuts = cut_pieces(data, bounds[:-1][np.diff(bounds) > 0])
        offsets = np.append(cuts, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        place = self._places(found.dictionary)
        codes = found.indices.to_numpy()
        sizes = self.size[place][codes]
        ends = np.cumsum(sizes)
        at = np.repeat((self.begin[place][codes] - (ends - sizes)).astype(np.int32), sizes)  # a batch and its memory hold under 2**31 ids
        at += np.arange(len(at), dtype=np.int32)
        total = np.concatenate([[0], ends])[np.searchsorted(cuts, bounds)]
        ids = self.table[at]
        if len(self.pieces) > self.most:
            self._keep(found.dictionary, place)
        return ids, np.diff(total)

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each piece is remembered; new ones are encoded first."""
        place = pc.index_in(distinct, value_set=self.pieces)
        new = distinct.filter(place.is_null())
        if len(new):
            known = [self.piece(p) for p in new.to_pylist()]
            size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
            self.begin = np.concatenate([self.begin, len(self.table) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.table = np.concatenate([self.table, np.frombuffer(b"".join(known), self.kind)])
            first = len(self.pieces)
            self.pieces = pa.concat_arrays([self.pieces, new])
            out = place.fill_null(-1).to_numpy().astype(np.int64)
            out[out < 0] = np.arange(first, len(self.pieces))
            return out
        return place.to_numpy()

    def _keep(self, distinct: pa.Array, place: np.ndarray) -> None:
        begin, size = self.begin[place], self.size[place]
        self.begin = np.cumsum(size) - size
        self.table = self.table[np.repeat(begin - self.begin, size) + np.arange(size.sum())]
        self.pieces, self.size = distinct, size


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def encoder(path: str, kind: str = "<u2") -> Encoder:
    """The worker's encoder for a tokenizer file; later tasks in the same process find its memory warm."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
