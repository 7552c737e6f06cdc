"""Byte-level BPE encoding and decoding by merge replay at corpus level.

Texts are split into words (matches of the split pattern); the distinct words of the corpus are
partitioned by word (see ``corpus_words``).  A partition holds an inverted index from token pair, named by
the rank that the pair merges to, to the positions in words where it stands, and replays the merges in
rank order: a rank's postings are taken together, each is merged, and only its two neighbours are posted
anew.  Each word of the corpus is replayed once, however often it occurs; texts are read off by word.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import resident, table
from quillspark.llm.corpus_words import per_text

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: The pattern's classes spelled out for texts of Latin letters; other texts take the pattern as it is.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_S = "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NOT_LATIN = re.compile("[^\x00-ɏ]")


class Splitter:
    """Words of texts under a split pattern."""

    def __init__(self, pattern: str = PATTERN):
        self.pattern, self.latin = regex.compile(pattern), _LATIN if pattern == PATTERN else None

    def __call__(self, text: str) -> list[str]:
        if self.latin is not None and (text.isascii() or not _NOT_LATIN.search(text)):
            return self.latin.findall(text)
        return [m[0] for m in self.pattern.finditer(text)]


class MergeReplay:
    """The merges of a vocabulary: two neighbouring tokens whose bytes together are a token merge to it."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each word.

        Words lie in one row of positions.  ``postings`` is the inverted index: the rank that a pair
        merges to -> positions where the pair begins.  Ranks are taken lowest first; a merge may post a
        pair of a lower rank, which then comes next.  Of a word's pairs of one rank the leftmost is
        merged first: a rank's positions are taken in order, and later ones of the same word go back if
        the merge has posted something lower in it.
        """
        ranks, tokens, of_byte = self.ranks, self.tokens, self.of_byte
        symbol: list[int] = []
        word: list[int] = []  # the word of each position
        begins: list[int] = []
        for number, raw in enumerate(words):
            begins.append(len(symbol))
            symbol += [of_byte[b] for b in raw]
            word += [number] * len(raw)
        n = len(symbol)
        after = list(range(1, n + 1))  # n: no further symbol in the word
        ahead = list(range(-1, n - 1))  # -1: none before
        for begin in begins:
            if begin < n:
                ahead[begin] = -1
            if begin:
                after[begin - 1] = n
        posted = [-1] * n  # the rank under which a position is posted; -1: none
        postings: dict[int, list[int]] = {}
        pair_of: dict[tuple[int, int], int] = {}

        def rank_of(a: int, b: int) -> int:
            found = pair_of.get((a, b))
            if found is None:
                found = pair_of[a, b] = ranks.get(tokens[a] + tokens[b], -1)
            return found

        for i in range(n):
            if after[i] < n and (rank := rank_of(symbol[i], symbol[i + 1])) >= 0:
                posted[i] = rank
                postings.setdefault(rank, []).append(i)
        heap = list(postings)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            positions = postings.pop(rank, None)
            if not positions:
                continue
            lower = -1  # the word in which a lower rank was posted just now
            back: list[int] = []
            for i in sorted(positions):
                if posted[i] != rank:
                    continue
                if word[i] == lower:
                    back.append(i)
                    continue
                j = after[i]
                symbol[i] = rank
                symbol[j] = posted[j] = -1
                k = after[i] = after[j]
                posted[i] = -1
                touched = ()
                if k < n:
                    ahead[k] = i
                    touched = (i,)
                if (h := ahead[i]) >= 0:
                    touched = (h, *touched)
                for x in touched:
                    new = rank_of(symbol[x], symbol[after[x]])
                    if new == posted[x]:
                        continue
                    posted[x] = new
                    if new >= 0:
                        if (found := postings.get(new)) is None:
                            postings[new] = [x]
                            heappush(heap, new)
                        else:
                            found.append(x)
                        if new < rank:
                            lower = word[i]
            if back:
                if (found := postings.get(rank)) is None:
                    postings[rank] = back
                    heappush(heap, rank)
                else:
                    found += back
        symbols = np.array(symbol, np.int64)
        alive = symbols >= 0
        counts = np.bincount(np.array(word, np.int64)[alive], minlength=len(words)) if n else np.zeros(len(words), np.int64)
        raw, at, out = symbols[alive].astype("<u4").tobytes(), 0, []
        for size in (4 * counts).tolist():
            out.append(raw[at : at + size])
            at += size
        return out


def _learner(path: str) -> Callable[[], Callable[[list[str]], list[bytes]]]:
    def learner():
        replay = resident(("merges", path), lambda: MergeReplay(path))
        return lambda words: replay.replay([x.encode("utf-8") for x in words])

    return learner


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit) of each row.

    A null text counts as empty and has no ids.  Very long texts and words are encoded whole.  Of equal
    pairs in a word the leftmost merges first.  Repeated rows and null ids give rows of their own.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    return per_text(docs, Splitter(pattern), _learner(path), "n_tokens long, ids binary", lambda ids: [(len(ids), ids.tobytes())])


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``doc_id``, ``data``: the bytes of the ids that ``encode`` gives; null ids give none, an empty table no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = resident(("merges", path), lambda: MergeReplay(path)).tokens
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "data": [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch["ids"]]})

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInPandas(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, for each row as in :func:`encode`."""

    def digests(ids: np.ndarray) -> list[tuple]:
        tokens = resident(("tokens", path), lambda: _Tokens(path))
        listed = ids.tolist()
        decimal = " ".join(map(tokens.decimal.__getitem__, listed)).encode()
        decoded = b"".join(map(tokens.tokens.__getitem__, listed))
        return [(len(listed), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(decoded).hexdigest())]

    return per_text(docs, Splitter(pattern), _learner(path), "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


class _Tokens:
    def __init__(self, path: str):
        self.tokens = MergeReplay(path).tokens
        self.decimal = [str(i) for i in range(len(self.tokens))]


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
