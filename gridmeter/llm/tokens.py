"""Token ids of whole texts by a public tokenizer, inside Arrow tasks.

A tokenizer whose file says that it cuts lower-case texts into words, single digits
and runs of marks (``cuts_into_words``) gives a text the ids of these pieces one
after another. Pieces recur, so a worker keeps the ids of those it has seen; new
ones of a block of texts go through the tokenizer together. Texts beyond Latin-1 are
cut at blanks, which such tokens never span. Any other tokenizer gets whole texts.
Result: the ids that the tokenizer gives for the whole text.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator, Sequence
from itertools import filterfalse

import numpy as np

PIECES_KEPT = 400_000  # about 80 MB a worker, in two generations
BLOCK_CHARS = 1_000_000
LONG = 64  # longer pieces are not kept
MARKS = string.punctuation
MARK, BETWEEN = "\x01", " \x01 "
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[^\\S\x1c-\x1f]+")
# fixed values of such a tokenizer's file: how it cuts a text, and what it does before
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BEFORE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
# the same cut for lower-case Latin-1
LETTERS, NUMBERS, BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
# (what pieces begin with tells them apart, so the most frequent kind is tried first)
PIECES = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{BLANKS}{LETTERS}{NUMBERS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def le(ids: Sequence[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def cuts_into_words(path: str) -> bool:
    """Whether the tokenizer's file proves that a text's ids are those of its pieces:
    the known cut and normalizer, word ends marked, added tokens without blanks that
    take none beside them, nothing added or cut off."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model, added = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("added_tokens") or []
    steps = cut.get("pretokenizers") or [{}, {}]
    split = steps[0].get("type") == "Split" and (steps[0].get("pattern") or {}).get("Regex") == CUT and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex", True) and not steps[1].get("add_prefix_space", True)
    apart = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    whole = spec.get("truncation") is None and spec.get("padding") is None and (spec.get("normalizer") or {}).get("normalizers") == BEFORE
    return bool(split and level and apart and whole and model.get("end_of_word_suffix") and model.get("dropout") is None)


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cut_at_blanks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """A long text in parts of about ``size`` characters that end at a blank, if it
    has blanks, so that its pieces aren't all in memory."""
    begin = 0
    while len(text) - begin > size:
        end = text.rfind(" ", begin + 1, begin + size)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:]


class PieceIds(dict):
    """From a piece without blanks to its ids, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known_cut = cuts_into_words(path)
        self.older: dict[str, bytes] = {}
        # a mark that is one token of its own; set between pieces, it shows where they end
        mark = self._encode(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        # tokens that end a word, where the vocabulary tells them
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.normalizer, self.plain = self.tokenizer.normalizer, normalizers.Sequence([])

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _cut(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of lower-case Latin-1 letters: each is one word of the tokenizer
        too, and normal already."""
        if not self.ends.any():
            return self._several(words)
        self.tokenizer.normalizer = self.plain
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        self.tokenizer.normalizer = self.normalizer
        ends = np.flatnonzero(self.ends[ids]) + 1
        return self._cut(ids, np.append(0, ends[:-1]), ends) if len(ends) == len(words) else self._several(words)

    def _several(self, pieces: list[str]) -> list[bytes]:
        if self.mark is None:
            return [le(self._encode(p)) for p in pieces]
        ids = np.array(self._encode(BETWEEN.join(pieces)), "<u4")
        at = np.flatnonzero(ids == self.mark)
        return self._cut(ids, np.append(0, at + 1), np.append(at, len(ids)))

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces in a few calls and keep their ids. A token always ends
        between a word and the marks after it, so these are encoded apart; and
        words of Latin-1 letters in lower case, which changes no id."""
        parts, words, others = [], set(), set()
        for p in pieces:
            if p.isascii() and p.isalpha() and p.islower():
                words.add(p)
                continue
            word = p.rstrip(MARKS)
            if not word or not ("0" <= word[-1] < "\u0130" and word[-1].isalnum()) or "<|" in p or MARK in p:
                word = p
            marks = p[len(word) :]
            if (word.isascii() or max(word) < "\u0100") and "<|" not in word:
                word = word.lower()
                (words if word.isalpha() else others).add(word)
            else:
                others.add(word)
            others.add(marks)
            parts.append((p, word, marks))
        if words := [x for x in words if x not in self]:
            self.update(zip(words, self._words(words), strict=True))
        others = [x for x in others if x and x not in self]
        odd = [x for x in others if MARK in x or "<|" in x]
        if several := [x for x in others if not (MARK in x or "<|" in x)]:
            self.update(zip(several, self._several(several), strict=True))
        for x in odd:
            self[x] = le(self._encode(x))
        for p, word, marks in parts:
            if p != word:
                self[p] = self[word] + self[marks] if marks else self[word]

    def texts(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of whole texts; null counts as empty."""
        if not self.known_cut:
            return [le(self._encode(t or "")) for t in texts]
        self.age()
        out = [self._parts(cut_at_blanks(t, BLOCK_CHARS)) if t and len(t) > 2 * BLOCK_CHARS else None for t in texts]
        short = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(short, self._block([texts[i] or "" for i in short]), strict=True):
            out[i] = x
        return out

    def _parts(self, parts: Iterator[str]) -> bytes:
        """Ids of a long text, part by part."""
        out = []
        for x in parts:
            out += self._block([x])
            self.age()
        return b"".join(out)

    def age(self) -> None:
        """Forget the pieces that were not used since the last time half of those kept
        were new."""
        if len(self) > PIECES_KEPT // 2:
            self.older = dict(self)
            self.clear()

    def _missing(self, pieces: set[str]) -> set[str]:
        """Those without known ids; pieces of the older generation are young again."""
        missing = set(filterfalse(self.__contains__, pieces))
        back = [p for p in missing if p in self.older]
        self.update((p, self.older[p]) for p in back)
        return missing.difference(back)

    def _block(self, texts: list[str]) -> list[bytes]:
        cut, new, others = [], set(), set()
        for t in texts:
            if "<|" not in t and latin(t):
                pieces = PIECES.findall(t.lower())
                new.update(pieces)
            else:
                # the separators 1c to 1f split words in Python, but not for the tokenizer
                pieces = t.split() if not SEPARATORS.search(t) else [p for p in BLANK.split(t) if p]
                others.update(pieces)
            cut.append(pieces)
        new = self._missing(new)
        words = [x for x in new if x.isalpha() and len(x) <= LONG]
        self.update(zip(words, self._words(words), strict=True) if words else ())
        new.difference_update(words)
        marks = [x for x in new if MARK not in x and len(x) <= LONG]
        self.update(zip(marks, self._several(marks), strict=True) if marks else ())
        new.difference_update(marks)
        # pieces that are long, or hold the mark between pieces: encoded alone and not kept
        others = self._missing(others)
        once = {p: le(self._encode(p)) for p in [*new, *others] if len(p) > LONG or p in new}
        self.learn(others - once.keys())
        return [b"".join([once[p] if p in once else self[p] for p in pieces] if once else map(self.__getitem__, pieces)) for pieces in cut]


_KNOWN: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """This worker's pieces for a tokenizer; kept between tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = PieceIds(path)
    return _KNOWN[path]


def blocks(texts, rows: int = 256, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Pieces of an Arrow column of texts as Python strings: where each begins,
    and its texts, at most ``rows`` of about ``chars`` characters together."""
    for begin in range(0, len(texts), rows):
        part, size, held = begin, 0, []
        for t in texts.slice(begin, rows).to_pylist():
            held.append(t)
            size += len(t or "")
            if size >= chars:
                yield part, held
                part, size, held = part + len(held), 0, []
        if held:
            yield part, held
