"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton lists the tokens that start at each symbol of a word. The encoder takes
the longest, checks that it and the token before it would both result from the merges (the pair
table), else takes a shorter one or steps back; a symbol found unreachable is never tried again,
so time is linear in the word. Only tokens that encode alone as themselves are matched.

A null text is an empty one without ids; null ids decode to an empty text; empty tables give
empty results; repeated rows have equal results; other columns stay, and names that are taken are
refused for new ones. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vakanz.llm.common import mapped_texts, ready, refuse_taken
from vakanz.llm.vocab import BYTE_CHARACTERS, END, Memory, Vocabulary, read

#: Where the symbols that carry the word end begin; the others are below.
ENDED = 0x1000
#: Remembered pairs of the compatibility table, and tokens decoded at once.
PAIRS, DECODE_TOKENS = 200_000, 1 << 16
_TABLE = {b: ord(c) for b, c in BYTE_CHARACTERS.items()}


def _key(token: str) -> str:
    """A token with one character a symbol."""
    if not token.endswith(END):
        return token
    token = token.removesuffix(END)
    return token[:-1] + chr(ord(token[-1]) + ENDED)


class Encoder:
    """Exact ids of words."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.vocabulary = vocabulary
        self.rank = dict.fromkeys(ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for (a, b), rank in vocabulary.ranks.items():
            token = ids[a + b]
            self.merged[ids[a], ids[b]] = rank
            if self.rank[token] < 0:
                self.rank[token], self.parts[token] = rank, (ids[a], ids[b])
        self.matcher = ahocorasick.Automaton()
        for token in vocabulary.single():
            key = _key(token)
            self.matcher.add_word(key, (len(key), ids[token]))
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = Memory(self.encode_word)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives exactly these two.

        Undoes the merges from the last to the first; at each state the two symbols at the border
        must not have been due for a merge before the one that is undone next. Equal merges run
        from the left, so one on the right side waits for the border.
        """
        key = left << 20 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        limit = 2 * len(self.rank) + 2
        while True:
            due = self.merged.get((left, right))
            if due is not None and 2 * due < limit:
                answer = False
                break
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                answer = True
                break
            if a > b:
                limit, left = 2 * a, self.parts[left][1]
            else:
                limit, right = 2 * b + 1, self.parts[right][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def encode_word(self, word: str) -> tuple[int, ...]:
        text = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TABLE)
        text = text[:-1] + chr(ord(text[-1]) + ENDED)
        size = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, match in self.matcher.iter(text):
            starts[end + 1 - match[0]].append(match)  # longer ones come later
        taken: list[tuple[int, int, int]] = []  # token, where it starts, how many longer ones failed
        dead = bytearray(size + 1)
        at, tried = 0, 0
        while at < size:
            options = starts[at]
            for tried in range(tried, len(options)):
                length, token = options[-1 - tried]
                if not dead[at + length] and (not taken or self.compatible(taken[-1][0], token)):
                    taken.append((token, at, tried))
                    at, tried = at + length, 0
                    break
            else:
                dead[at] = 1
                _, at, tried = taken.pop()
                tried += 1
        return tuple(t for t, _, _ in taken)

    def encode(self, text: str, out: array) -> array:
        """``out`` with the ids of a text added."""
        parts, get = self.vocabulary.parts(text), self.words.__getitem__
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.vocabulary.special[part])
            else:
                out.extend(chain.from_iterable(map(get, self.vocabulary.words(part))))
        return out


class Decoder:
    """Token strings, with a blank between them, by the offsets of one long string."""

    def __init__(self, vocabulary: Vocabulary):
        names = {i: t for t, i in [*vocabulary.ids.items(), *vocabulary.special.items()]}
        strings = [(names.get(i, "") + " ").encode("utf-8") for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for low in range(0, len(ids), DECODE_TOKENS):
            block = ids[low : low + DECODE_TOKENS]
            sizes = self.sizes[block]
            shift = self.starts[block] - (np.cumsum(sizes) - sizes)
            out.append(self.blob[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out)[:-1].decode("utf-8")


def encoder(path: str) -> Encoder:
    return read(path).tool(Encoder)


def decoder(path: str) -> Decoder:
    return read(path).tool(Decoder)


def _ids_array(texts: list[str], path: str) -> pa.Array:
    encode, flat, ends = encoder(path).encode, array("i"), [0]
    for text in texts:
        encode(text, flat)
        ends.append(len(flat))
    values = pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _decoded_array(ids: pa.Array, path: str) -> pa.Array:
    decode = decoder(path).decode
    own = [r.values for r in ids]
    return pa.array(["" if x is None else decode(x.to_numpy(zero_copy_only=False)) for x in own], pa.string())


def encoded(docs: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text in its place."""
    return mapped_texts(docs, text_col, f"`{into}` array<int>", lambda texts: [_ids_array(texts, path)])


def with_decoded(docs: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for."""
    ready(docs.sparkSession)
    refuse_taken(docs, into)

    @F.arrow_udf(StringType())
    def decode(rows: pa.Array) -> pa.Array:
        return _decoded_array(rows, path)

    return docs.withColumn(into, decode(ids_col))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of each text, and what they decode to, in its place."""

    def make(texts: list[str]) -> list[pa.Array]:
        own = _ids_array(texts, path)
        return [own, _decoded_array(own, path)]

    return mapped_texts(docs, text_col, f"`{ids}` array<int>, `{decoded}` string", make)


def encoded_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return round_trip(rows, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
