"""Token counts by a longest-match automaton that is linear in the text.

The vocabulary is a trie over bytes. Each node has a failure link and the number of pieces
that greedy longest match has certainly popped when it follows the link, so a word's count
comes from one walk over its bytes, and no piece is ever built. A word is a run without
blanks, spelled with the word-start byte before it, as the vocabulary spells it.

Defined results: a null text counts as empty, with no tokens. A word that the vocabulary
cannot spell counts as one token and as unknown. Rows are counted one by one, so repeated
rows repeat. Words seen before are remembered, up to ``REMEMBERED`` of at most 64 bytes in a
worker; that changes no result.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte that stands before each word.
WORD_START = b" "
REMEMBERED = 500_000
SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file (base64 and rank on each line), read on the driver."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """step: node * 256 + byte -> node; fail: link or -1; pops: pieces popped on the link."""

    def __init__(self, pieces: list[bytes]):
        self.step: dict[int, int] = {}
        ends, parents = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for byte in piece:
                after = self.step.get(node << 8 | byte)
                if after is None:
                    after = self.step[node << 8 | byte] = len(ends)
                    ends.append(False)
                    parents.append((node, byte))
                node = after
            if node:
                ends[node] = True
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        depth = [0] * len(ends)
        for node in range(1, len(ends)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            above, byte = parents[node]
            at, popped = self.fail[above], self.pops[above]
            while at >= 0 and (at << 8 | byte) not in self.step:
                popped += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.step[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match over the word; -1 if it gets stuck."""
        step, fail, pops = self.step, self.fail, self.pops
        node = found = 0
        for byte in word:
            while (after := step.get(node << 8 | byte)) is None:
                found += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = after
        while node:
            found += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return found


class _Seen(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(WORD_START + word)
        if len(word) <= 64 and len(self) < REMEMBERED:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, words, tokens and unknown words of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches):
        seen = _Seen(Automaton(shared.value))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                each = list(map(seen.__getitem__, words))
                unknown = each.count(-1)
                rows.append((len(words), sum(each) + 2 * unknown, unknown))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(count, SCHEMA)
