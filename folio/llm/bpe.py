"""Problem 6: ids of a public byte-level BPE vocabulary for a whole corpus, by dynamic programming over prefixes.

Every prefix of a word has exactly one BPE encoding, and that encoding is the encoding of a shorter prefix plus one
token. So it is enough to store, for each prefix, its last token. The candidates at a position are the vocabulary's
tokens that end there, which an automaton with suffix links lists in one run over the word; of these, exactly one can
stand behind the last token of the prefix before it. Following the stored tokens back from the end gives the ids.
Whether two tokens may stand side by side is tested by undoing their last merges in turn. The work is linear in the
text; nothing is merged step by step.

Results: one row per input row; a null and an empty text give an empty list, never null; strings that look like special
tokens are ordinary text. Repeated documents give repeated rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Published pattern that splits text into words before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a worker; the memory is emptied when it is full, so it is bounded and no word is treated otherwise.
REMEMBERED = 400_000
#: Words of more characters aren't remembered.
LONG_WORD = 64


class PrefixEncoder:
    """Exact ids of single words for one vocabulary of token -> rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = {i: len(b) for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[i] = (i, i)
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None and left < i and right < i and self._stable(left, right):
                    self.parts[i] = (left, right)
                    self.merged[left, right] = i
                    break
        self.fit.clear()

    def _stable(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right apart: no merge across the border comes before those inside."""
        bound = 1 << 60
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            by_left = left > right
            for turn in (by_left, not by_left):
                if turn:
                    inner = self.parts[left][1]
                    if inner != left:
                        bound, left = left, inner
                        break
                else:
                    inner = self.parts[right][0]
                    if inner != right:
                        bound, right = right + 1, inner
                        break
            else:
                return True

    def stable(self, left: int, right: int) -> bool:
        known = self.fit.get((left, right))
        if known is None:
            if len(self.fit) > 2_000_000:
                self.fit.clear()
            known = self.fit[left, right] = self._stable(left, right)
        return known

    def word(self, raw: bytes) -> list[int]:
        text = raw.decode("latin-1")
        last: list[int] = [-1] * (len(raw) + 1)
        for end, token in self.automaton.iter(text):
            stop = end + 1
            if last[stop] >= 0:
                continue
            start = stop - self.size[token]
            if start == 0 or (last[start] >= 0 and self.stable(last[start], token)):
                last[stop] = token
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        return ids[::-1]


class TextEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.words = PrefixEncoder(ranks)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, extend = self.known, out.extend
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.words.word(w.encode("utf-8", "replace"))
                if len(w) <= LONG_WORD:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            extend(ids)
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=2)
def encoder_of(data: bytes) -> TextEncoder:
    """One encoder for a worker, whatever number of partitions it gets."""
    return TextEncoder(ranks_of(data))


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    return Path(folder, name).read_bytes()


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids of every row. The vocabulary is a file of fixed size (under 1 MB), so it is broadcast."""
    rank_file = documents.sparkSession.sparkContext.broadcast(vocabulary(folder))

    def run(batches):
        encode = encoder_of(rank_file.value).encode
        for b in batches:
            ids = [encode(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """The columns keep and n_tokens of every row."""
    rank_file = documents.sparkSession.sparkContext.broadcast(vocabulary(folder))

    def run(batches):
        count = encoder_of(rank_file.value).count
        for b in batches:
            n = pa.array([count(t) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.record_batch([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep]
    return documents.select(*keep, text).mapInArrow(run, ", ".join([*kinds, "n_tokens long"]))


def p6_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id and ids of each document under byte_bpe_50k."""
    from folio.session import table

    return encode_corpus(table(spark, sf_dir, "documents"))
