"""A word-end BPE vocabulary file (``.json``) and its rules before merging, for Python workers.

The file is read by each worker from a path that all machines have; it is never copied.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata

import regex
from tokenizers import Tokenizer

from vakanz.llm.common import held

#: White space as the file's pattern means it (fixed values of the Unicode property).
SPACE = r"\t-\r \x85\xa0  -     　"
#: The pattern of the file, which ``read`` checks, and the same with SPACE spelled out.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = regex.compile(FILE_PATTERN.replace(r"\s", SPACE))
END = "</w>"
#: Words longer than this are not remembered; a memory holds at most twice this many.
REMEMBER_CHARS, REMEMBER_WORDS = 48, 60_000
#: Up to this many symbols a scan for the next merge is faster than a heap.
SCAN_SYMBOLS = 40


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARACTERS = byte_characters()


def symbols(word: str) -> list[str]:
    """The symbols of a word before any merge; the last one carries the word end."""
    out = [BYTE_CHARACTERS[b] for b in word.encode("utf-8", "surrogatepass")]
    out[-1] += END
    return out


#: Below this, no code point is unassigned in any version of Unicode in use.
SETTLED = re.compile("[^\x00-\u0377]")
BEYOND = re.compile("[^\x00-\uffff]")
BYTES = {c: b for b, c in BYTE_CHARACTERS.items()}


def _points(kind: str, end: int) -> str:
    """The code points below ``end`` of a Unicode category, as this Python knows it, for a pattern."""
    runs, start = [], None
    for point in range(end + 1):
        fits = point < end and unicodedata.category(chr(point)).startswith(kind)
        if fits and start is None:
            start = point
        elif not fits and start is not None:
            runs.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(runs)


@functools.lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Code points that this Python's Unicode does not know: others may read them as letters."""
    return re.compile(f"[{_points('Cn', sys.maxunicode + 1)}]")


@functools.lru_cache(maxsize=1)
def quick_words():
    """WORD for text of assigned code points up to U+FFFF, with a faster library.

    Letters and digits begin no other kind of word, so their order does not matter.
    """
    letters, numbers = _points("L", 0x10000), _points("N", 0x10000)
    return re.compile(rf"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall


class Vocabulary:
    """Ids, merges and special strings of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            data = json.load(source)
        model, steps = data["model"], data["normalizer"]["normalizers"]
        split = data["pre_tokenizer"]["pretokenizers"][0]
        kinds = [step["type"] for step in steps]
        plain = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in data["added_tokens"])
        if kinds != ["NFC", "Replace", "Lowercase"] or split["pattern"]["Regex"] != FILE_PATTERN or model["end_of_word_suffix"] != END or not plain:
            raise ValueError(f"{path} is not a word-end BPE file of the supported form")
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")")
        self.starts = tuple({s[0] for s in by_length})
        self.path = path
        self.tools: dict = {}

    def parts(self, text: str) -> list[str]:
        """Plain text at even places, special strings at odd ones."""
        if any(c in text for c in self.starts):
            return self.special_split.split(text)
        return [text]

    def tool(self, make):
        """What ``make`` builds from this vocabulary, once."""
        if make not in self.tools:
            self.tools[make] = make(self)
        return self.tools[make]

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """The words that merges work on, normalised."""
        if not text.isascii():
            find = quick_words()
            if SETTLED.search(text):
                if unassigned().search(text):
                    # Only the library knows what its version of Unicode makes of these.
                    parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                    return [bytes(BYTES[c] for c in word).decode("utf-8") for word, _ in parts]
                text = unicodedata.normalize("NFC", text)
                if BEYOND.search(text):
                    find = WORD.findall
            # Lower case is taken letter by letter, so a final sigma is an ordinary one.
            return find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return quick_words()(text.lower())

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of one word, by merging the pair of the lowest rank, leftmost first."""
        return self._scanned(parts) if len(parts) <= SCAN_SYMBOLS else self._heaped(parts)

    def _scanned(self, parts: list[str]) -> list[str]:
        get, none = self.ranks.get, len(self.ranks)
        order = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while order:
            best = min(order)
            if best == none:
                break
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(order):
                order[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def _heaped(self, parts: list[str]) -> list[str]:
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        live: list[str | None] = list(parts)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := get((live[left], live[right]))) is not None:
                    heapq.heappush(heap, (r, left, live[left], live[right]))
        return [x for x in live if x is not None]

    def single(self) -> set[str]:
        """Proof by merging: the vocabulary strings that encode alone as one token."""
        found = set()
        for token in self.ids:
            ended = token.endswith(END)
            parts = list(token.removesuffix(END) if ended else token)
            if ended and parts:
                parts[-1] += END
            if parts and self.merge(parts) == [token]:
                found.add(token)
        return found


def read(path: str) -> Vocabulary:
    """The vocabulary, once a process while it is in use."""
    return held(("vocabulary", path), lambda: Vocabulary(path))


class Memory(dict):
    """``word -> value`` with a bound; ``make`` gives the value of a word not yet known.

    A full memory becomes the old one, from which words in use come back; the rest goes.
    """

    def __init__(self, make, known=()):
        super().__init__(known)
        self.make, self.known, self.old = make, dict(known), {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER_WORDS + len(self.known):
                self.old = dict(self)
                self.clear()
                self.update(self.known)
            self[word] = value
        return value
