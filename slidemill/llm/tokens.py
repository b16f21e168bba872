"""Token ids of whole texts, equal to those of the tokenizers and sentencepiece libraries.

Texts are cut at places that no token crosses, and each distinct part is merged once (``rounds``).
For byte-level files all of that runs over the bytes of some megabytes of texts at a time, so that
no word becomes a Python object; for pieces each word is kept in a bounded cache of the Python
worker. Words beyond printable ASCII and Latin-1 letters, and texts that hold special tokens, rare
control characters or spaces beyond ASCII, go through the library itself.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa

from slidemill.llm.rounds import Merges, merge_words

#: Distinct words that a worker keeps; beyond that it starts anew.
CACHED = 500_000

#: Bytes of text that are cut and counted at once, save for a single longer text.
SLICE = 4 << 20
#: Kinds of bytes; beyond ASCII only Latin-1 letters are letters, all else is odd.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself where it is visible
    Latin-1, otherwise the next character from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def _kinds() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)
    out[0x21:0x7F] = OTHER
    for kind, found in ((SPACE, b" \t\n\v\f\r"), (DIGIT, b"0123456789"), (LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")):
        out[list(found)] = kind
    return out


KINDS = _kinds()
#: Lower case of a letter's bytes: of ASCII, and of what follows 0xC3 in UTF-8.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256)], np.uint8)
#: Bytes that may begin a space beyond ASCII.
LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8."""
    out = KINDS[data]
    at = np.flatnonzero(data == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    out[at] = out[at + 1] = LETTER
    return out


def whole_at(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 has what needs the whole text: what may begin a special token, \\x1c-\\x1f, spaces beyond ASCII."""
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    control = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
    at = np.flatnonzero(LEADS[data])
    a, b, c = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    wide = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | general | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return np.concatenate([special, control, at[wide]])


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an array without nulls."""
    wide = text.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; ids fit 16 bits."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.lower = bool(self.end)
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + self.end] for c in names], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs], np.arange(len(pairs)))

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, their parts' starts and the end, number of parts before each text): what the library's pattern cuts.

        A word with an odd byte is one part, for the library. A lower-casing file drops white space and takes digits one
        by one; others put one space before a word, and leave a last other space of its own.
        """
        n, kind = len(data), kinds_of(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True  # at the end, too
        space = kind == SPACE
        if (odd := np.flatnonzero(kind == ODD)).size:
            edge = first.copy()
            edge[1:-1] |= space[1:] != space[:-1]
            edges = np.flatnonzero(edge)
            words = np.unique(np.searchsorted(edges, odd, "right")) - 1
            mark = np.zeros(n + 1, np.int8)
            mark[edges[words]] += 1
            mark[edges[words + 1]] -= 1
            kind[np.cumsum(mark[:-1], dtype=np.int8) > 0] = ODD
        begin = first.copy()
        begin[1:-1] |= kind[1:] != kind[:-1]
        if self.lower:
            data = np.where(kind == LETTER, LOWER[data], data)
            begin[:-1] |= kind == DIGIT
        else:
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
            begin[last] = True
            begin[last[data[last] == 0x20] + 1] = False
        quote = np.flatnonzero((data[:-1] == 0x27) & (kind[:-1] == OTHER) & (kind[1:] == LETTER) & begin[:-2] & ~first[1:-1])
        if len(quote):
            a, b = data[quote + 1], np.where(begin[quote + 2], 0, data[np.minimum(quote + 2, n - 1)])
            one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
            two = ((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C))
            begin[quote[one | two] + 1] = False
            begin[quote[one] + 2] = begin[quote[two] + 3] = True
        if not self.lower:
            starts = np.flatnonzero(begin[:-1])
            return data, np.append(starts, n), np.searchsorted(starts, offsets)
        keep = ~space
        before = np.searchsorted(np.flatnonzero(begin[:-1] & keep), offsets)
        data = data[keep]
        return data, np.append(np.flatnonzero(begin[:-1][keep]), len(data)), before

    def _ids(self, parts: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each part, as little-endian 16-bit numbers."""
        offsets, data = bytes_of(parts)
        kind, size = kinds_of(data), np.diff(offsets)
        odd = np.zeros(len(size), bool)
        odd[np.searchsorted(offsets, np.flatnonzero(kind == ODD), "right") - 1] = True
        odd |= kind[offsets[1:] - 1] == SPACE
        sym = self.inner[data]
        sym[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        if not odd.any():
            ids, count = merge_words(sym, size, self.merges)
            return binaries(np.concatenate([[0], np.cumsum(count)]) * 2, ids.astype("<u2").view(np.uint8))
        count = np.zeros(len(size), np.int64)
        ids, count[~odd] = merge_words(sym[np.repeat(~odd, size)], size[~odd], self.merges)
        strange = [e.ids for e in self.library.encode_batch([p.decode() for p in parts.filter(pa.array(odd)).to_pylist()], add_special_tokens=False)]
        count[odd] = [len(x) for x in strange]
        flat, own = np.empty(count.sum(), "<u2"), np.repeat(odd, count)
        flat[~own], flat[own] = ids, [i for x in strange for i in x]
        return binaries(np.concatenate([[0], np.cumsum(count)]) * 2, flat.view(np.uint8))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, "<u2"), np.zeros(len(offsets) - 1, np.int64)
        data, starts, before = self._cut(data, offsets)
        if len(starts) < 2:
            return np.zeros(0, "<u2"), np.zeros(len(offsets) - 1, np.int64)
        parts = binaries(starts, data).dictionary_encode()
        ends, ids = bytes_of(self._ids(parts.dictionary).take(parts.indices))
        return ids.view("<u2"), np.diff(ends[before]) // 2

    def encode_column(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), as the library's encode with add_special_tokens=False gives them; null is empty."""
        text = text.fill_null("")
        offsets, data = bytes_of(text)
        ids, counts, a = [], [], 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            whole = np.unique(np.searchsorted(at, whole_at(own), "right") - 1) if len(own) else []
            if len(whole):
                rest = np.ones(b - a, bool)
                rest[whole] = False
                plain, count = self._encode(own[np.repeat(rest, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at)[rest])]))
                strange = [e.ids for e in self.library.encode_batch(text.slice(a, b - a).take(pa.array(whole)).to_pylist(), add_special_tokens=False)]
                n = np.zeros(b - a, np.int64)
                n[rest], n[whole] = count, [len(x) for x in strange]
                found, of = np.empty(n.sum(), "<u2"), np.repeat(rest, n)
                found[of], found[~of] = plain, [i for x in strange for i in x]
            else:
                found, n = self._encode(own, at)
            ids.append(found)
            counts.append(n)
            a = b
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, "<u2"), np.zeros(0, np.int64))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def encode_ended(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the end id after each; where each text begins, and the end)."""
        ids, counts = self.encode_column(text)
        at = np.concatenate([[0], np.cumsum(counts + 1)])
        out, end = np.empty(at[-1], "<u2"), np.zeros(at[-1], bool)
        end[at[1:] - 1] = True
        out[end], out[~end] = end_id, ids
        return out, at


class Pieces:
    """A BPE model of the sentencepiece library with byte fallback; ids fit 16 bits."""

    WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n")

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {names[i]: i for i in normal}
        if any("▁" in p.lstrip("▁") or "\n" in p for p in ids) or any(sp.is_unused(i) for i in range(n)) or sp.encode("  a ²")[0] == sp.encode("a")[0]:
            raise ValueError("the model has pieces that cross words, unused pieces, or a normaliser")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        score = {i: sp.get_score(i) for i in normal}
        # Symbols: piece ids; characters that aren't pieces are numbered from n on and never merge.
        left, right, product = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    left.append(ids[p[:k]])
                    right.append(ids[p[k:]])
                    product.append(i)
        order = {s: r for r, s in enumerate(sorted({score[i] for i in product}, reverse=True))}
        self.merges = Merges(left, right, product, np.array([order[score[i]] for i in product]))
        self.symbol = {p: i for p, i in ids.items() if len(p) == 1}
        codes = sorted((ord(c), i) for c, i in self.symbol.items())
        self.codes, self.code_ids = np.array([c for c, _ in codes]), np.array([i for _, i in codes])
        self.n = n
        text = [names[i].replace("▁", " ").encode() if i in score else b"" for i in range(n)]
        for b, i in enumerate(self.bytes):
            text[i] = bytes([b])
        self.size = np.array([len(x) for x in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.leads = np.array([x[:1] == b" " for x in text])
        self.words: dict[str, bytes] = {}
        self.decimal: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        code = np.frombuffer("".join(words).replace(" ", "▁").encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.searchsorted(self.codes, code)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == code
        sym = np.where(known, self.code_ids[np.minimum(at, len(self.codes) - 1)], self.n + code)
        ids, count = merge_words(sym, size, self.merges)
        cut = np.concatenate([[0], np.cumsum(count)])
        odd = ids >= self.n
        if odd.any():  # byte fallback
            per = [[int(i)] if i < self.n else [self.bytes[b] for b in chr(i - self.n).encode()] for i in ids[odd]]
            width = np.ones(len(ids), np.int64)
            width[odd] = [len(x) for x in per]
            out = np.repeat(ids, width)
            out[np.repeat(odd, width)] = [b for x in per for b in x]
            cut = np.concatenate([[0], np.cumsum(width)])[cut]
            ids = out
        flat, names = ids.astype("<u2").tobytes(), list(map(str, ids.tolist()))
        bounds = cut.tolist()
        self.words.update(zip(words, [flat[2 * a : 2 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], strict=True))
        self.decimal.update(zip(words, [",".join(names[a:b]).encode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], strict=True))

    def _cut(self, texts: list[str]) -> list[list[str]]:
        cut = [self.WORDS.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        new = set().union(*cut)
        if len(self.words) + len(fresh := new.difference(self.words)) > CACHED:
            self.words.clear()
            self.decimal.clear()
            fresh = new
        if fresh:
            self._learn(list(fresh))
        return cut

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u2") for words in self._cut(texts)]

    def encode_both(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """The ids of each text, and the same as decimals joined by commas."""
        cut = self._cut(texts)
        get, name = self.words.__getitem__, self.decimal.__getitem__
        return [(np.frombuffer(b"".join(map(get, words)), "<u2"), b",".join(map(name, words))) for words in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text, as the library's decode gives it for ids that an encoding can have."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        out = self.flat[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + size, size)].tobytes()
        return out[1:] if self.leads[ids[0]] else out


@cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
