"""Byte-level BPE over whole texts, with the ``tokenizers`` library's own model behind a vectorised pre-tokenizer.

The library's pre-tokenizer is a regular expression that costs more than the merges themselves. Here the same cuts are
found with numpy over the code points of many texts at once; each distinct piece is then merged once by the library's
BPE model and its ids are kept in a cache of bounded size. ``tests/llm`` holds the result against ``Tokenizer.encode``.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: White_Space of the Unicode character database (what the pattern's \s matches).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The contractions of the byte-level pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Fixed value: the stand-in of a blank in a sentencepiece vocabulary.
BLANK_MARK = "\u2581"


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stays, the rest moves up from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Flags of the code points where a piece of the byte-level pattern starts.

    points: code points of the texts, one after another; doc_starts: index of the first code point of each non-empty text.
    """
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space before a word of the same text stands alone, and a plain blank joins that word
    last = np.zeros(n, bool)
    if n > 1:
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    at = np.flatnonzero(last)
    begin[at] = True
    blank = at[points[at] == 0x20]
    begin[blank + 1] = False
    # contractions: an apostrophe that starts a piece, right before letters
    tick = np.flatnonzero((points == 0x27) & begin)
    tick = tick[tick + 1 < n]
    tick = tick[(kind[tick + 1] == LETTER) & ~first[tick + 1]]
    if len(tick):
        done = np.zeros(len(tick), bool)
        for tail in CONTRACTIONS:
            hit = ~done
            for k, c in enumerate(tail, 1):
                inside = np.minimum(tick + k, n - 1)
                hit &= (tick + k < n) & (points[inside] == ord(c))
                if k > 1:
                    hit &= ~first[inside]
            done |= hit
            i = tick[hit]
            begin[i + 1] = False
            j = i + 1 + len(tail)
            j = j[j < n]
            begin[j[kind[j] == LETTER]] = True
    return begin


#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
ROLL = 0x9E3779B97F4A7C15 | 1
UNROLL = pow(ROLL, -1, 1 << 64)
#: Code points of known pieces that an encoder keeps.
CACHE_POINTS = 1 << 24


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A piece is found by a 64-bit hash of its code points, which are then compared. Known pieces lie in arrays sorted by
    that hash, so that a batch needs one ``unique`` and one ``searchsorted`` and only new pieces become Python strings.
    A text that holds the string of an added token (such as the end of a text) goes to the library as it is.
    """

    #: The bytes of each id, where a caller wants to know whether pieces give theirs back, and if one of them did not.
    entries: list[bytes] | None = None
    lossy = False
    #: Powers of ROLL and of its inverse, one table for all encoders of a worker.
    up = down = np.ones(1, np.uint64)

    def __init__(self, path: str, cache_size: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.cache_size = cache_size
        self.mix = np.random.default_rng(20).integers(1, 1 << 63, 1 << 16, np.uint64) | np.uint64(1)
        self.reset()

    def reset(self) -> None:
        Encoder.up = Encoder.down = np.ones(1, np.uint64)
        self.keys = np.zeros(0, np.uint64)
        # of each known piece: where its ids and its code points begin and how many there are
        self.begins, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.places, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.points = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def starts(self, points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        return piece_starts(points, doc_starts)

    def hashes(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Hash of the code points between each two neighbouring bounds."""
        n = len(points)
        if len(self.up) <= n:
            wide = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                Encoder.up = np.cumprod(np.append(np.ones(1, np.uint64), np.full(wide, ROLL, np.uint64)), dtype=np.uint64)
                Encoder.down = np.cumprod(np.append(np.ones(1, np.uint64), np.full(wide, UNROLL, np.uint64)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            value = self.mix[points & 0xFFFF] + points.astype(np.uint64)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * self.up[:n], dtype=np.uint64)))
            h = (total[bounds[1:]] - total[bounds[:-1]]) * self.down[bounds[:-1]]
            h ^= h >> np.uint64(29)
            return h * np.uint64(0xBF58476D1CE4E5B9) + np.diff(bounds).astype(np.uint64)

    def merged(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece, by the library's model."""
        tokenize = self.model.tokenize
        if any("\0" in p or "\n" in p for p in pieces):
            mapped = [p.encode().decode("latin-1").translate(self.alphabet) for p in pieces]
        else:
            glue = self.alphabet[0]
            mapped = "\0".join(pieces).encode().decode("latin-1").translate(self.alphabet).split(glue)
        return [[t.id for t in tokenize(p)] for p in mapped]

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = self.merged(pieces)
        if self.entries is not None and not self.lossy:
            self.lossy = any(b"".join([self.entries[i] for i in x]) != p.encode() for x, p in zip(ids, pieces, strict=True))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begins = np.insert(self.begins, at, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.insert(self.lengths, at, lengths.astype(np.int32))
        self.places = np.insert(self.places, at, len(self.points) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes.astype(np.int32))
        self.flat = np.concatenate((self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))))
        self.points = np.concatenate((self.points, np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)))

    def token_bytes(self) -> list[bytes]:
        """What each id stands for."""
        known, back = self.tokenizer.get_vocab(), {c: b for b, c in self.alphabet.items()}
        out = [b""] * (max(known.values()) + 1)
        for entry, k in known.items():
            out[k] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        odd = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if not odd:
            return self.plain(texts)
        ids, counts = self.plain(["" if k in set(odd) else t for k, t in enumerate(texts)])
        whole = [self.tokenizer.encode(texts[k], add_special_tokens=False).ids for k in odd]
        places = np.concatenate(([0], np.cumsum(counts)))[odd]
        counts[odd] = [len(x) for x in whole]
        return np.insert(ids, np.repeat(places, counts[odd]), [i for x in whole for i in x]), counts

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without added tokens."""
        if len(self.keys) > self.cache_size or len(self.points) > CACHE_POINTS:
            self.reset()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        starts = np.flatnonzero(self.starts(points, (ends - sizes)[sizes > 0]))
        bounds = np.append(starts, len(points))
        h = self.hashes(points, bounds)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            i = first[new]
            self.learn(distinct[new], [whole[a:b] for a, b in zip(bounds[i].tolist(), bounds[i + 1].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        begins, n = self.begins[at][which], self.lengths[at][which].astype(np.int64)
        # a piece whose code points are others than those of the known one of its hash is merged for itself
        size, known = np.diff(bounds), at[which]
        same = self.sizes[known] == size
        there = np.minimum(np.repeat(self.places[known] - starts, size) + np.arange(len(points)), len(self.points) - 1)
        same &= np.logical_and.reduceat(self.points[there] == points, starts)
        flat = self.flat
        if not same.all():
            self.lossy = True  # those pieces are not looked at
            other = np.flatnonzero(~same)
            ids = self.merged([whole[a:b] for a, b in zip(bounds[other].tolist(), bounds[other + 1].tolist(), strict=True)])
            n[other] = [len(x) for x in ids]
            begins[other] = len(flat) + np.cumsum(n[other]) - n[other]
            flat = np.concatenate((flat, np.array([i for x in ids for i in x], np.int32)))
        stop = np.cumsum(n)
        out = flat[np.repeat(begins - (stop - n), n) + np.arange(stop[-1])]
        before = np.concatenate(([0], stop))[np.searchsorted(starts, ends)]
        return out, np.diff(before, prepend=0)


class PieceEncoder(Encoder):
    """Ids of whole texts by a sentencepiece BPE model; a text's first blank is the one that the model itself would add.

    A merge never spans two characters that stand side by side in no piece of the vocabulary, so a text is cut between
    such, and the library's model merges each distinct part once. ``tests/llm`` holds the result against the library.
    """

    def __init__(self, path: str, cache_size: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [p.replace(BLANK_MARK, " ") for k in range(self.library.get_piece_size()) if len(p := self.library.id_to_piece(k)) > 1 and not (self.library.is_byte(k) or self.library.is_control(k) or self.library.is_unknown(k))]
        points = sorted({ord(c) for p in pieces for c in p})
        self.known = np.array(points, np.uint32)
        number = {chr(c): k for k, c in enumerate(points, 1)}
        self.beside = np.zeros((len(points) + 1, len(points) + 1), bool)
        for p in pieces:
            for x, y in zip(p, p[1:], strict=False):
                self.beside[number[x], number[y]] = True
        if "\n" in number:
            raise ValueError("a line end must not be part of a longer piece")
        self.line_end = self.library.encode("\n")[-1]
        self.added: list[str] = []
        self.cache_size = cache_size
        self.mix = np.random.default_rng(20).integers(1, 1 << 63, 1 << 16, np.uint64) | np.uint64(1)
        self.reset()

    def starts(self, points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        points = np.where(points == ord(BLANK_MARK), np.uint32(0x20), points)
        at = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
        number = np.where(self.known[at] == points, at + 1, 0)
        begin = np.ones(len(points), bool)
        begin[1:] = ~self.beside[number[:-1], number[1:]]
        begin[doc_starts] = True
        return begin

    def merged(self, pieces: list[str]) -> list[list[int]]:
        ids = self.library.encode("\n" + "\n".join(p for p in pieces if p != "\n"))[2:]  # behind the library's own blank and the first line end
        ends = [*(k for k, i in enumerate(ids) if i == self.line_end), len(ids)]
        parts = iter([ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)])
        return [[self.line_end] if p == "\n" else next(parts) for p in pieces]

    def token_bytes(self) -> list[bytes]:
        """What each id stands for."""
        return [bytes([int(p[1:-1], 16)]) if self.library.is_byte(k) else p.replace(BLANK_MARK, " ").encode() for k in range(self.library.get_piece_size()) for p in (self.library.id_to_piece(k),)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
