"""Texts as sequences of the corpus's distinct words, so that each word is tokenised once.

Tasks split their texts into words and code each text as places in the word list of its block, a bounded
run of texts.  A list is cut by the words' hashes into parts, and a part's words are one packed value; texts and
parts are written once, in buckets by block.  Parts of one hash range come together, so that a word of the corpus
gets its ids once, and the packed ids go back to their blocks, whose texts lie there and are read off.
What is shuffled are words and ids, each once and packed; texts are not.  A block is bounded and has a word
once, and there are as many ranges as blocks at least, so no group grows with the corpus.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, release, shuffle_partitions, text_or_empty
from quillspark.shared import scratch_path

#: Characters of a block of texts; a longer text is a block of its own.
BLOCK_CHARS = 8_000_000
#: Ranges of hashes for each shuffle partition, so that partitions are even.
RANGES_A_PARTITION = 4
#: New words of a range that are learnt at once.
WORDS_AT_ONCE = 50_000


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed by planes of bytes, since the upper bytes vary less."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed_words(words: list[str]) -> dict:
    return {"sizes": packed(np.fromiter(map(len, words), np.uint32, len(words))), "words": zlib.compress("".join(words).encode("utf-8"), 6)}


def unpacked_words(sizes: bytes, words: bytes) -> list[str]:
    text, ends = zlib.decompress(words).decode("utf-8"), np.cumsum(unpacked(sizes), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class Block:
    """Texts as places in a list of their words, which is in the order in which they occur."""

    def __init__(self):
        self.place: defaultdict[str, int] = defaultdict(count().__next__)  # a new word gets the next place
        self.texts: list[tuple] = []
        self.size = 0

    def add(self, key, text: str, words: list[str]) -> None:
        self.texts.append((key, np.fromiter(map(self.place.__getitem__, words), np.uint32, len(words))))
        self.size += len(text)


def read_off(ids: list[bytes], codes: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The ids (uint32) of each coded text, from the little-endian 32-bit ids of the block's words in order of their place."""
    return read_flat(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4"), codes)


def read_flat(sizes: np.ndarray, flat: np.ndarray, codes: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """As :func:`read_off`, from the words' ids one after the other and each word's number of them."""
    sizes = sizes.astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    for each in codes:
        n = sizes[each]
        yield flat[np.repeat(begins[each] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _blocks(batches: Iterator[pd.DataFrame], split: Callable[[str], list[str]], ranges: int) -> Iterator[pd.DataFrame]:
    """Texts as places in the word list of their block, and that list's words by range of hashes, in order of places."""
    release()
    block = Block()

    def flush() -> pd.DataFrame:
        words = sorted(block.place)
        of_range = np.fromiter((zlib.crc32(x.encode("utf-8")) % ranges for x in words), np.int64, len(words))
        order = np.argsort(of_range, kind="stable")
        words, of_range = [words[i] for i in order.tolist()], of_range[order]
        now = np.empty(len(words), np.uint32)
        now[np.fromiter(map(block.place.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        rows = [{"doc_id": doc_id, "codes": packed(now[codes])} for doc_id, codes in block.texts]
        cuts = [0, *(np.flatnonzero(np.diff(of_range)) + 1).tolist(), len(words)] if words else []
        rows += [{"part": int(of_range[a]), **packed_words(words[a:b])} for a, b in zip(cuts, cuts[1:])]
        made = pd.DataFrame(rows, columns=["doc_id", "codes", "part", "sizes", "words"], dtype=object).astype({"doc_id": "Int64", "part": "Int64"})
        made.insert(0, "block", uuid.uuid4().int >> 65)
        return made.where(made.notna(), None)

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            if block.texts and block.size + len(text) > BLOCK_CHARS:
                yield flush()
                block = Block()
            block.add(None if pd.isna(doc_id) else int(doc_id), text, split(text))
    if block.texts:
        yield flush()


def _learnt(batches: Iterator[pd.DataFrame], learner: Callable[[], Callable[[list[str]], list[bytes]]]) -> Iterator[pd.DataFrame]:
    """Packed words in order of their ranges -> their packed ids; the words of a range are remembered as long as it goes on."""
    learn, ids, at = learner(), {}, -1
    for batch in batches:
        out = []
        for part, sizes, words in zip(batch["part"].tolist(), batch["sizes"].tolist(), batch["words"].tolist()):
            if part != at:
                ids, at = {}, part
            listed = unpacked_words(sizes, words)
            new = [x for x in listed if x not in ids]
            for i in range(0, len(new), WORDS_AT_ONCE):
                ids.update(zip(new[i : i + WORDS_AT_ONCE], learn(new[i : i + WORDS_AT_ONCE])))
            found = [ids[x] for x in listed]
            out.append((packed(np.fromiter(map(len, found), np.uint32, len(found)) // 4), packed(np.frombuffer(b"".join(found), "<u4"))))
        yield pd.DataFrame({"block": batch["block"], "part": batch["part"], "n_ids": [x for x, _ in out], "ids": [x for _, x in out]})


def _block_texts(words: pd.DataFrame, texts: pd.DataFrame, summary: Callable[[np.ndarray], list[tuple]], names: list[str]) -> pd.DataFrame:
    """The rows that *summary* gives for the ids of each of a block's texts, from the ids of the block's words."""
    words = words.sort_values("part", kind="stable")
    sizes, flat = (np.concatenate([np.zeros(0, "<u4"), *map(unpacked, words[name].tolist())]) for name in ("n_ids", "ids"))
    out = [(doc_id, *row) for doc_id, ids in zip(texts["doc_id"].tolist(), read_flat(sizes, flat, map(unpacked, texts["codes"].tolist()))) for row in summary(ids)]
    return pd.DataFrame(out, columns=["doc_id", *names]).astype({"doc_id": "Int64"})


def _in_buckets(rows: DataFrame, n: int) -> DataFrame:
    """*rows* written to the shared folder in *n* buckets by ``block``, so that what comes by block finds them there."""
    path = scratch_path(rows.sparkSession, "corpus-blocks")
    name = f"corpus_blocks_{path[-32:]}"
    rows.write.bucketBy(n, "block").option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def per_text(docs: DataFrame, split: Callable[[str], list[str]], learner: Callable[[], Callable[[list[str]], list[bytes]]], schema: str, summary: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """``doc_id`` and the columns of *schema*: the rows of *summary* for the ids (uint32) of each text of *docs*.

    *split* gives a text's words; *learner* makes, in a task, the function from words to their ids as
    little-endian 32-bit numbers; a text's ids are those of its words in order.  A null text counts as
    empty.  Repeated rows and null ids give rows of their own; other columns are ignored.
    """
    rows = bounded_batches(docs).select("doc_id", text_or_empty().alias("text"))
    n = shuffle_partitions(docs.sparkSession)
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    ranges = max(RANGES_A_PARTITION * n, math.ceil(chars / BLOCK_CHARS))
    # written once, so that texts and words are of the same blocks
    blocks = _in_buckets(rows.mapInPandas(lambda b: _blocks(b, split, ranges), "block long, doc_id long, codes binary, part long, sizes binary, words binary"), n)
    lists = blocks.filter("words IS NOT NULL").select("block", "part", "sizes", "words").repartitionByRange(n, "part").sortWithinPartitions("part")
    listed = bounded_batches(lists).mapInPandas(lambda b: _learnt(b, learner), "block long, part long, n_ids binary, ids binary")
    texts = blocks.filter("codes IS NOT NULL").select(F.col("block").alias("of_block"), "doc_id", "codes")
    names = [x.split()[0] for x in schema.split(", ")]

    def read_texts(words: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _block_texts(words, held, summary, names)

    return listed.groupBy("block").cogroup(texts.groupBy("of_block")).applyInPandas(read_texts, f"doc_id long, {schema}")
