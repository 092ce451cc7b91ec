"""Token ids of whole texts, by the BPE model of the tokenizers library, with a bounded memo of pieces."""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from steploom.llm.shared import Memo, turn_to

#: Pieces that a worker remembers: so many of the last ones at least, twice as many (some 100 MB) at most. Longer pieces are not remembered.
MEMO = 1 << 18
MEMO_CHARS = 60

#: Bytes of text, about, whose pieces are found together, each different one once.
PART_BYTES = 1 << 20

#: Fixed: how byte-level BPE cuts text into pieces before it merges bytes within each.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The character that byte-level BPE shows each byte as: printable bytes themselves, others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Characters that the standard module's classes below don't list.
BEYOND_CLASSES = r"[\U00010000-\U0010ffff]"


@functools.cache
def quick_pieces() -> re.Pattern:
    """``PIECES`` for texts of characters up to U+FFFF, for the standard module, which is much quicker on listed characters.

    Only a contraction and other signs, and the two ways of white space, can match at one place; these keep their order. The
    frequent alternatives come first, and each begins with listed characters, so that it is passed over at all others.
    """
    characters = "".join(map(chr, range(0x10000)))

    def listed(kind: str) -> str:
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(rf"{kind}+", characters))

    letter, number, space, other = map(listed, (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"))
    return re.compile(
        rf" [{letter}]+|[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{other}]+|[{number}]+| [{other}]+| [{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer file as read by the tokenizers library, some 25 MB: once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_tokens(library) -> list[str]:
    """The added tokens of a tokenizer file, as they stand in texts."""
    added = library.get_added_tokens_decoder().values()
    # A token that the library normalises first may be written in another way than here.
    if any(token.normalized for token in added) and library.normalizer is not None:
        raise ValueError("the tokenizer file has a normaliser")
    return [token.content for token in added]


def _whole(library, text: str) -> bytes:
    return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def plain_encoder(path: str) -> Callable[[str], bytes]:
    """A function from an ordinary text to its ids, as little-endian 32-bit numbers, without special tokens, for a
    byte-level tokenizer file without normaliser.

    The same as ``Tokenizer.encode(text, add_special_tokens=False).ids`` with special tokens read as ordinary text; most
    of that call's time goes into places in the text, which nobody asks for here.
    """
    model, letters = _library(path).model, byte_letters()

    def find(piece: str) -> bytes:
        shown = piece.encode("utf-8", "replace").decode("latin-1").translate(letters)
        return array("I", [token.id for token in model.tokenize(shown)]).tobytes()

    memo = Memo(find, MEMO, MEMO_CHARS, "tokens")
    quick, any_text = quick_pieces().findall, regex.compile(PIECES).findall
    beyond = re.compile(BEYOND_CLASSES).search

    def encode(text: str) -> bytes:
        split = quick if text.isascii() or not beyond(text) else any_text
        return b"".join(map(memo.__getitem__, split(text)))

    return encode


#: Kinds of characters in ``PIECES``.
OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each code point, as the classes of ``PIECES`` have it."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    characters = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, listed in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.findall(listed, characters):
            out[[ord(c) for c in run]] = kind
    return out


def piece_bounds(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of ``PIECES`` begin in texts that stand one after another, and the end: places of bytes in ``data``, all in UTF-8.

    ``starts`` are the places where the texts begin. A piece begins where the kind changes, with three exceptions: white space
    before another character leaves its last character to itself, a U+0020 there goes to what follows, and a
    contraction takes its apostrophe and letters only.
    """
    n = len(data)
    kind, high = kinds()[data], data >= 0x80
    wide = bool(high.any())
    if wide:
        points = np.frombuffer(data[high].tobytes().decode().encode("utf-32-le"), "<u4")
        kind[high] = np.repeat(kinds()[points], 2 + (points >= 0x800) + (points >= 0x10000))
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = first[n] = True
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) + 1
    last = after - 1
    for _ in range(3 * wide):  # to the first byte of that character
        last -= (data[last] & 0xC0) == 0x80
    begins[last] = True
    begins[after[data[last] == ord(" ")]] = False
    mark = np.flatnonzero(data == ord("'"))
    mark = mark[begins[mark] & ~first[mark + 1]]
    one, two = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, letters in ((mark[short], 1), (mark[long & ~first[mark + 2]], 2)):
        begins[found + 1] = False
        begins[found + 1 + letters] = True
    return np.flatnonzero(begins)


@functools.lru_cache(maxsize=2)
def _batch_encoder(path: str) -> Callable[[pa.Array], Iterator[list[bytes]]]:
    library = _library(path)
    added, tokenize = added_tokens(library), library.model.tokenize
    shown = np.array([ord(letter) for _, letter in sorted(byte_letters().items())], dtype="<u2")

    def find_all(pieces: list[bytes]) -> list[bytes]:
        letters = shown[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
        ids, ends = array("I"), [0]
        for a, b in itertools.pairwise(itertools.accumulate(map(len, pieces), initial=0)):
            ids.extend([token.id for token in tokenize(letters[a:b])])
            ends.append(4 * len(ids))
        found = ids.tobytes()
        return [found[a:b] for a, b in itertools.pairwise(ends)]

    memo = Memo(lambda piece: find_all([piece])[0], MEMO, MEMO_CHARS, "tokens")

    def together(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The ids of the texts that ``bounds`` cuts ``data`` into."""
        if not len(data):
            return [b""] * (len(bounds) - 1)
        cuts = piece_bounds(data, bounds[:-1])
        buffers = [None, pa.py_buffer(cuts.astype("<i8")), pa.py_buffer(data)]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(memo.many(different, find_all), pa.large_binary()).take(pieces.indices)
        _, ends, found = ids.buffers()
        places = np.frombuffer(ends, "<i8")[np.searchsorted(cuts, bounds)].tolist()
        found = memoryview(found)
        return [bytes(found[a:b]) for a, b in itertools.pairwise(places)]

    def encode(texts: pa.Array) -> Iterator[list[bytes]]:
        texts = texts.fill_null("").cast(pa.large_string())
        texts.validate(full=True)
        apart = np.zeros(len(texts), dtype=bool)
        for content in added:
            apart |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        held = pc.if_else(pa.array(apart), pa.scalar("", pa.large_string()), texts) if apart.any() else texts
        _, ends, data = held.buffers()
        bounds = np.frombuffer(ends, "<i8")[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, dtype="<i8")
        data = np.frombuffer(data or b"", np.uint8)
        row = 0
        while row < len(held):
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PART_BYTES, "right")) - 1)
            out = together(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
            for k in np.flatnonzero(apart[row:end]).tolist():
                out[k] = _whole(library, texts[row + k].as_py())
            yield out
            row = end

    return encode


def batch_encoder(path: str) -> Callable[[pa.Array], Iterator[list[bytes]]]:
    """The same as ``encoder`` for an array of texts (null: empty), some ``PART_BYTES`` of them at a time, in order.

    The pieces of many texts are cut in arrays, and each different one is looked up once: much quicker than text by text.
    """
    turn_to("tokens")
    return _batch_encoder(path)


def encoder(path: str) -> Callable[[str], bytes]:
    """The same as ``Tokenizer.encode(text, add_special_tokens=False).ids``, added tokens of the file included.

    Texts without an added token take the quick way of ``plain_encoder``; the others go to the library itself.
    """
    turn_to("tokens")
    return _encoder(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], bytes]:
    ordinary = plain_encoder(path)
    library = _library(path)
    added = added_tokens(library)
    if not added:
        return ordinary
    holds_added = re.compile("|".join(map(re.escape, added))).search

    def encode(text: str) -> bytes:
        return _whole(library, text) if holds_added(text) else ordinary(text)

    return encode
