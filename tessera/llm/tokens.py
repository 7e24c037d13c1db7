"""Token ids by the tokenizers library, with a bounded cache of words.

A text is cut where the tokenizer's own rules cut it in any case, so that a word's ids don't depend on its surroundings; each new word is encoded once.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from .flat import process_cache

#: Words that a process keeps at most; beyond it the cache starts anew.
MOST_WORDS = 450_000


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str, ordinary: bool):
    """The library's tokenizer; with `ordinary`, the strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = ordinary
    return t


def _with_special(path: str, plain: Callable[[str], bytes]) -> Callable[[str | None], bytes]:
    """`plain`, but a text that holds a special token's string goes to the library whole, which gives the string the token's id. Null is an empty text."""
    whole = _load(path, False)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in special):
            return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        return plain(text)

    return encode


#: ASCII signs other than an apostrophe. Both vocabularies cut a word of Latin letters and such signs between the two, and nowhere else.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that stand for bytes beyond ASCII in byte-level vocabularies: 0x80-0xA0 and 0xAD are moved up, others stand for themselves.
_SHOWN = {b: chr(b) for b in range(0xA1, 0x100) if b != 0xAD} | {b: chr(0x100 + 33 + i) for i, b in enumerate([0x7F, *range(0x80, 0xA1), 0xAD])}


class Words(dict):
    """The ids (bytes of little-endian u32) of a word, found when first asked for.

    A simple word goes straight to the vocabulary's model, in the pieces that the tokenizer would cut it into; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, blank: bool, lower: bool, most: int = MOST_WORDS):
        super().__init__()
        self.most = most
        self.tokenizer, self.blank, self.lower = _load(path, True), " " if blank else "", lower
        self.shown_blank = "\u0120" if blank else ""
        self.model, self.signs = self.tokenizer.model, {}

    def ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def sign(self, x: str) -> bytes:
        got = self.signs.get(x)
        if got is None:
            if len(self.signs) >= self.most:
                self.signs.clear()
            got = self.signs[x] = self.ids(x)
        return got

    def simple(self, word: str) -> bytes | None:
        """The ids of a word of Latin letters, then signs; none for any other."""
        letters = word.rstrip(_SIGNS)
        if not letters:
            return self.sign(self.shown_blank + word) if word else None
        if not letters.isalpha():
            return None
        if letters.isascii():
            shown = letters
        else:
            try:
                letters.encode("latin-1")
            except UnicodeEncodeError:
                return None
            shown = letters.encode().decode("latin-1").translate(_SHOWN)
        if len(letters) < len(word):
            return self[letters] + self.sign(word[len(letters) :])
        if self.lower:
            low = letters.lower()
            if low != letters:
                return self[low]
        return self.ids(self.shown_blank + shown)

    def __missing__(self, word: str) -> bytes:
        got = self.simple(word)
        if got is None:
            got = array("I", self.tokenizer.encode(self.blank + word, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.most:
            self.clear()
        self[word] = got
        return got

    def join(self, words: list[str]) -> bytes:
        """The ids of the words, one after the other."""
        return b"".join(map(self.__getitem__, words))


def words(path: str, blank: bool, lower: bool, most: int = MOST_WORDS) -> Words:
    """The process's own Words for these: a Python worker keeps them from task to task. Special tokens' strings are ordinary text."""
    key, kept = (path, blank, lower, most), process_cache()
    if key not in kept:
        kept[key] = Words(*key)
    return kept[key]


def pattern() -> str:
    """How the byte-level vocabularies cut a text."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranked(path: str, cut: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function of words without blanks that gives how many subwords each has, with a blank before it, and all their ids. path: a file of ranks; cut: how it cuts a text.

    Words go to the library together. A blank between two other characters always begins a token, so tokens that begin with one tell the words apart.
    """
    import tiktoken

    kept = process_cache()
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = np.zeros(max(ranks.values()) + 1, bool)
        first[[k for x, k in ranks.items() if x.startswith(b" ")]] = True
        kept[path] = tiktoken.Encoding("words", pat_str=cut, mergeable_ranks=ranks, special_tokens={}), first
    encoding, first = kept[path]

    def alone(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [encoding.encode_ordinary(" " + x) for x in words]
        return np.fromiter(map(len, found), np.int64, len(found)), np.array([i for x in found for i in x], np.int64)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [len(x.split()) != 1 for x in words]  # white space beyond ASCII inside, which joins with the blanks around
        if any(odd):
            lens, flat = alone(words)
            return lens, flat
        ids = np.array(encoding.encode_ordinary(" " + " ".join(words)) if words else [], np.int64)
        begin = np.flatnonzero(first[ids])
        if len(begin) != len(words):
            return alone(words)
        return np.diff(np.append(begin, len(ids))), ids

    return encode


#: White space beside white space or at an end, where the byte-level rules look at more than the next character.
_ODD = re.compile(r"\s\s|^\s|\s\Z")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def byte_bpe(path: str, most: int = MOST_WORDS) -> Callable[[str | None], bytes]:
    """An encoder for the byte-level vocabulary, to little-endian u32, with the library's ids. A single blank between two other characters always begins a token."""
    spaced, plain = words(path, True, False, most), words(path, False, False, most // 4)
    feed = plain["\n"]

    def ids(parts: list[str]) -> bytes:
        """A line's ids, whose first word has no blank before it."""
        return plain[parts[0]] + b"".join(map(spaced.__getitem__, parts[1:]))

    def encode(text: str) -> bytes:
        if _ODD.search(text):
            return ids(_SINGLE.split(text))
        # a single line feed between other characters is a token of its own
        return feed.join([ids(x.split(" ")) for x in text.split("\n")])

    return _with_special(path, encode)


def word_bpe(path: str) -> Callable[[str | None], bytes]:
    """An encoder for the vocabulary with word ends, which drops white space, to little-endian u32, with the library's ids."""
    known, blanks = words(path, False, True), re.compile(r"[^ \n\t\r]+")

    def encode(text: str) -> bytes:
        # Python takes four controls for white space that the vocabulary doesn't
        return known.join(blanks.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split())

    return _with_special(path, encode)
