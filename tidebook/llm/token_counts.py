"""Word-piece token counts by a linear longest-match automaton.

A word is a maximal run of non-space characters with a word mark in front; it is cut greedily into the
longest pieces of the vocabulary. The vocabulary is a trie over bytes. Where the trie has no way on
from a node, the longest-match pieces of the text so far are popped and matching goes on from the
node's failure link, whose text is what these pieces leave over. The number of pieces popped is
computed beforehand for each node and byte, so a text is counted in one table lookup a byte and no
piece is ever built.

Every single byte is a piece too, so any text can be cut: characters that the vocabulary lacks count
one token a byte.

Space characters are those of Unicode. Defined cases: null, empty and blank texts have 0 tokens; null identifiers and repeated rows
are counted like others; very long texts are cut between words into ranges that run side by side; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import buffers, slices, walk
from .common import bounded, table

MARK, BLOCK, SHIFT = "▁", 512, 7
VOCABULARY = "piece_bpe_32k.model"
SPACES = r"(?U)[\s\x1c-\x1f]+"


def vocabulary(name: str = VOCABULARY) -> list[bytes]:
    """The pieces of a public sentencepiece file that can occur in a marked word, as bytes."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [p.replace(MARK, " ").encode() for p in pieces if MARK not in p[1:] and " " not in p]


class Automaton:
    """The complete automaton: inner trie nodes as states, ``moves`` for ``walk``, and ``rest``, the pieces popped where a text ends."""

    def __init__(self, pieces: list[bytes]) -> None:
        child: list[dict[int, int]] = [{}]
        token, depth = [False], [0]
        for piece in [*pieces, *(bytes([c]) for c in range(256))]:
            v = 0
            for c in piece:
                if c not in child[v]:
                    child[v][c] = len(child)
                    child.append({})
                    token.append(False)
                    depth.append(depth[v] + 1)
                v = child[v][c]
            token[v] = True
        n = len(child)
        link, pops = [0] * n, [0] * n
        order = [0]
        for v in order:  # breadth first: failure links of shallower nodes are known
            for c, w in child[v].items():
                order.append(w)
                if token[w]:
                    link[w], pops[w] = 0, 1
                else:  # pop what the parent pops until the byte has a way on
                    x, k = link[v], pops[v]
                    while c not in child[x]:
                        x, k = link[x], k + pops[x]
                    link[w], pops[w] = child[x][c], k
        rest = [0] * n
        for v in order[1:]:
            rest[v] = pops[v] + rest[link[v]]
        inner = [v for v in order if child[v]]
        state = {v: i for i, v in enumerate(inner)}

        def settled(x: int, k: int) -> tuple[int, int]:
            while x and not child[x]:  # a leaf can't go on: pop at once
                x, k = link[x], k + pops[x]
            return x, k

        row = np.zeros((len(inner), 256), np.int64)  # (node << SHIFT) | popped
        for i, v in enumerate(inner):
            if v:
                x, k = settled(link[v], pops[v])
                row[i] = row[state[x]] + k
            for c, w in child[v].items():
                x, k = settled(w, 0)
                row[i, c] = (state[x] << SHIFT) | k
        if int((row & ((1 << SHIFT) - 1)).max()) >= (1 << SHIFT) - 1:
            raise ValueError("too many pieces are popped at once")
        same: dict[bytes, int] = {}
        self.classes = np.array([same.setdefault(row[:, c].tobytes(), len(same)) for c in range(256)], np.int64)
        first = [int(np.flatnonzero(self.classes == k)[0]) for k in range(len(same))]
        self.width = len(first)
        cut = row[:, first]
        self.moves = ((((cut >> SHIFT) * self.width) << SHIFT) | (cut & ((1 << SHIFT) - 1))).ravel()
        if self.moves.max() < 2**31:
            self.moves = self.moves.astype(np.int32)
        self.rest = np.array([rest[v] for v in inner])

    def counts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text; words are separated by single spaces and each starts with one."""
        starts, of = cuts(data, at)
        ends = np.append(starts[1:], at[-1])
        popped, state = walk(self.moves, self.width, SHIFT, self.classes, data, starts, ends - starts)
        return np.bincount(of, popped + self.rest[state], len(at) - 1).astype(np.int64)


def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ranges that begin with a word, about ``BLOCK`` bytes apart, and the text of each."""
    spaces = np.flatnonzero(data == 32)
    text = np.searchsorted(at, spaces, "right") - 1
    part = (spaces - at[text]) // BLOCK
    first = np.ones(len(spaces), bool)
    first[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    return spaces[first], text[first]


@lru_cache(maxsize=1)
def automaton(name: str) -> Automaton:
    """The automaton of a vocabulary file, once a worker."""
    return Automaton(vocabulary(name))


def token_counts(df: DataFrame, name: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, n_words, n_tokens)``."""
    marked = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit(""))), SPACES, " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 4_000_000):
                data, at = buffers(batch.column("__text"))
                words = np.bincount(np.searchsorted(at, np.flatnonzero(data == 32), "right") - 1, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(words), pa.array(automaton(name).counts(data, at))], names=[key, "n_words", "n_tokens"])

    # a text without words is the one space that was put before it
    return df.select(key, F.rtrim(marked).alias("__text")).transform(bounded).mapInArrow(run, f"{key} long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
