"""Encoding texts with a tokenizer file, one distinct piece at a time.

A text is cut where the tokenizer must cut as well, so encoding the pieces
gives the ids of the whole; frequent pieces are encoded once per cache fill.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import held_by

#: A single space between two characters that are no white space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Where one of these occurs, only the expression above finds the cuts.
_CONTROL = b"\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_DOUBLE = (b"  ", b" \n", b"\n ", b"\n\n")
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_AFTER = rb"(?:(?<=[0-9A-Za-z]%b)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]%b))"
#: A lone full stop or comma after a letter or digit, and any run of marks there (none may begin a contraction).
_STOP = re.compile(rb"\.(?=[ \n])" + _AFTER % (rb"\.", rb"\."))
_COMMA = re.compile(rb",(?=[ \n])" + _AFTER % (rb",", rb","))
_MARK = rb"[!-&(-/:-@\[-`{-~]"
_RUN = re.compile(_MARK + _AFTER % (_MARK, _MARK) + _MARK + rb"*(?=[ \n])")
_OTHER_MARKS = b"!\"#$%&()*+-/:;<=>?@[\\]^_`{|}~"


#: Pieces that begin or end with white space, but for one space in front.
_NOT_TOGETHER = re.compile(rb"[\t-\r\x1c-\x1f]|\0 *\0|\0  | \0|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a tokenizer file: in ``folder``, else that of the installed package."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _marks_cut(text: bytes) -> bytes:
    if len(text.translate(None, _OTHER_MARKS)) != len(text):
        return _RUN.sub(rb"\0\g<0>", text)
    return _COMMA.sub(b"\0,", _STOP.sub(b"\0.", text))


def spaced_cuts(text: bytes) -> bytes:
    """The text with a zero byte at each cut: before lone spaces, which byte-level patterns
    attach to the word after it, around lone line ends, and before marks."""
    if (
        text[:1] in b" \n"
        or text[-1:] in b" \n"
        or len(text.translate(None, _CONTROL)) != len(text)
        or any(x in text for x in _DOUBLE)
        or (not text.isascii() and any(x in text for x in _WIDE))
    ):
        return _LONE_SPACE.sub("\0 ", text.decode("utf-8", "replace")).encode()
    return _marks_cut(text).replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")


_SPACE_AND_CASE = bytes(0 if b in b" \t\n\r\x0b\x0c" else b for b in bytes(range(256)).lower())


def dropped_space_cuts(text: bytes) -> bytes:
    """Cuts at ASCII white space and before marks, for tokenizers that drop space and case."""
    return _marks_cut(text).translate(_SPACE_AND_CASE)


#: Letters of ranges without gaps or later additions; the small ones are also what lower-casing and NFC leave as it is.
_SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff\u03b1-\u03c9\u0430-\u045f"
_LETTERS = _SMALL + "A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a1\u03a3-\u03a9\u0400-\u042f\u4e00-\u9fa5\uac00-\ud7a3"


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _merges_only(spec: dict, mark: str):
    """The tokenizer's merges without its pattern, for words that the pattern leaves whole; ``mark`` parts them."""
    from tokenizers import Tokenizer

    split = {"type": "Split", "pattern": {"String": mark}, "behavior": "Isolated", "invert": False}
    bare = {"normalizer": None, "pre_tokenizer": split, "post_processor": None, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(spec | bare))


def _listed(distinct: pa.LargeBinaryArray) -> list[bytes]:
    """Values without zero bytes as Python objects."""
    edges = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, 8 * distinct.offset)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    out = np.zeros(len(data) + len(distinct) - 1, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(distinct)), np.diff(edges))] = data
    return out.tobytes().split(b"\0")


class PieceEncoder:
    """Ids of whole texts as packed little-endian numbers.

    The strings of special tokens in a text are what the library makes of them;
    with ``special_as_text`` they are ordinary text.
    """

    #: Pieces of the younger and of the older half of the cache, at most.
    CACHE = 450_000

    def __init__(self, path: str, spaces_dropped: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        added = [] if special_as_text else [t["content"].encode().lower() for t in spec["added_tokens"]]
        self.special, self.special_head = tuple(added), os.path.commonprefix(added)
        self.cuts = dropped_space_cuts if spaces_dropped else spaced_cuts
        # New pieces are encoded together, parted by a mark that is one token by itself.
        self.mark, self.glue = ("@", " @ ") if spaces_dropped else ("\n", "\n")
        (self.mark_id,) = self._ids([self.mark])[0]
        self.merges = _merges_only(spec, byte_alphabet()[ord(self.mark)])
        self.plain = re.compile(f"(?<=\0)[{_SMALL}]+(?=\0)" if spaces_dropped else f"(?<=\0) ?[{_LETTERS}]+(?=\0)").findall
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[bytes], ids: np.ndarray) -> None:
        """Holds the ids of pieces that were encoded together."""
        width = self.dtype.itemsize
        ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
        data, at = ids.tobytes(), 0
        for p, end in zip(pieces, ends, strict=True):
            self.young[p] = data[at * width : end * width]
            at = end + 1

    def _learn(self, new: set[bytes]) -> None:
        if not new:
            return
        mark, glue, odd = self.mark.encode(), self.glue.encode(), _NOT_TOGETHER.search
        # Words of letters alone need no pattern: their bytes go to the merges.
        words = [w.encode() for w in self.plain("\0%s\0" % b"\0\0".join(new).decode("utf-8", "replace"))]
        words = [w for w in words if w in new]
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            text = mark.join(part).decode("latin-1").translate(byte_alphabet())
            self._keep(part, np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype))
        rest = new.difference(words)
        every = b"\0%b\0" % b"\0".join(rest)
        alone = [p for p in rest if mark in p or odd(b"\0%b\0" % p)] if mark in every or odd(every) else []
        together = list(rest.difference(alone))
        for p, ids in zip(alone, self._ids([p.decode("utf-8", "replace") for p in alone]), strict=True):
            self.young[p] = np.array(ids, self.dtype).tobytes()
        for lo in range(0, len(together), 2000):
            part = together[lo : lo + 2000]
            self._keep(part, np.array(self._ids([glue.join(part).decode("utf-8", "replace")])[0], self.dtype))

    def _taken_whole(self, text: bytes) -> bool:
        """Texts with special tokens or zero bytes are not cut."""
        if b"\0" in text:
            return True
        if not self.special or self.special_head not in text.lower():
            return False
        return any(x in text.lower() for x in self.special)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Pieces of all texts are numbered by Arrow; only distinct ones are looked up."""
        if len(self.young) > self.CACHE:  # what is in use comes back from the older half
            self.young, self.old = {b"": b""}, self.young
        whole = {i for i, t in enumerate(texts) if self._taken_whole(t)}
        cut = [b"" if i in whole else self.cuts(t) for i, t in enumerate(texts)]
        ends = np.cumsum([t.count(b"\0") + 1 for t in cut])
        if not len(ends):
            return []
        joined = b"\0".join(cut)
        stops = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 0), len(joined))
        offsets = np.append(0, stops - np.arange(len(stops))).astype(np.int64)
        data = pa.py_buffer(joined.translate(None, b"\0"))
        coded = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), data]).dictionary_encode()
        pieces, older = _listed(coded.dictionary), self.old.get
        new = set()
        for p in [p for p, x in zip(pieces, map(self.young.get, pieces), strict=True) if x is None]:
            if (ids := older(p)) is None:
                new.add(p)
            else:
                self.young[p] = ids
        self._learn(new)
        found = list(map(self.young.__getitem__, pieces))
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        number = coded.indices.to_numpy()
        counts = sizes[number]
        reach = np.cumsum(counts)
        ids = flat[np.repeat(starts[number] - reach + counts, counts) + np.arange(reach[-1])]
        out = np.split(ids, reach[ends[:-1] - 1])
        for i in whole:
            out[i] = np.array(self._ids([texts[i].decode("utf-8", "replace")])[0], self.dtype)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, spaces_dropped: bool, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for each worker process and file."""
    return PieceEncoder(path, spaces_dropped, special_as_text)


held_by("tokens", encoder.cache_clear)
