"""Packing by shortest-pack-first over the length histogram.

1. Each task turns its texts into token ids, block by block: texts are coded as places in the block's list
   of words, only words that no block before had are tokenised, and the ids are read off by place.  They
   are cut into pieces of at most ``MAX_TOKENS``.
2. The counts of piece lengths (at most ``MAX_TOKENS`` rows, whatever the corpus) give packing
   patterns: lengths are placed longest first, all pieces of one length at once, into the packs that
   are shortest so far, and the counts of the patterns are updated.  New packs are opened as the
   volume still to be placed asks for.
3. Every piece gets a rank among those of its length: its place within (length, salt) plus the counts
   of the salts before it, so that a length that a third of all pieces share is ranked in many tasks.
4. Each slot of a pattern takes a range of ranks; pieces find their slot by binary search in this
   list, whose size follows the number of patterns and not the corpus.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, materialise, resident, shuffle_partitions, table, text_or_empty
from quillspark.llm.corpus_words import Block, read_off

MAX_TOKENS = 4096
END_ID = 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Characters of texts that are tokenised together, and words whose ids a task remembers (those of the last block stay longest).
BLOCK_CHARS = 2_000_000
CACHED_WORDS = 400_000

_UNUSUAL = re.compile("[^\x00-įı-ɏ]|<\\|")
_PUNCTUATION_RUN = re.compile("[^\t-\r \x85\xa0a-z0-9ß-öø-ɏ][,.] ")
_PLAIN_WORD = re.compile("[a-zß-öø-ɏ]+")


def chunks(text: str) -> list[str]:
    """Parts of a text whose ids in order are the text's: the tokenizer drops white space and never joins text across it.

    Lower-casing first and setting ``,`` and ``.`` apart make parts repeat more often; both are done only
    where they can't change an id.
    """
    if "<|" in text or not text.isascii() and _UNUSUAL.search(text):
        return text.replace("\n", " ").split(" ")
    text = text.lower().replace("\n", " ")
    if not _PUNCTUATION_RUN.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


class WordEncoder:
    """Ids of words; plain ones are tokenised many at a time and cut where a token ends a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if self.suffix:
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(self.suffix)]] = True

    def ids(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        known: dict[str, bytes] = {"": b""}
        plain, other = [], []
        for word in words:
            (plain if self.suffix and len(word) < 100 and _PLAIN_WORD.fullmatch(word) else other).append(word)
        lines = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for part, found in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                known[word] = raw[at:end]
                at = end
        for word, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            known[word] = np.array(found.ids, "<u4").tobytes()
        return [known[x] for x in words]


    def remembered(self, words: Iterable[str]) -> list[bytes]:
        """Ids of a block's distinct words."""
        words = list(words)
        new = [x for x in words if x not in self.known]
        self.known.update(zip(new, self.ids(new)))
        found = [self.known[x] for x in words]
        if len(self.known) > CACHED_WORDS:
            self.known = dict(zip(words, found)) if len(words) <= CACHED_WORDS else {}
        return found


def _pieces(batches: Iterator[pd.DataFrame], path: str, max_tokens: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    tail = np.array([END_ID], "<u4")
    block = Block()

    def flush() -> pd.DataFrame:
        out = []
        encoder = resident(("words", path), lambda: WordEncoder(path))
        ids_of = read_off(encoder.remembered(block.place), (codes for _, codes in block.texts))
        for (doc_id, _), ids in zip(block.texts, ids_of):
            raw = np.concatenate([ids, tail]).tobytes()
            for at in range(0, len(raw), 4 * max_tokens):
                piece = raw[at : at + 4 * max_tokens]
                out.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, piece if with_ids else None))
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})
        return frame if with_ids else frame.drop(columns="ids")

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            if block.texts and block.size + len(text) > BLOCK_CHARS:
                yield flush()
                block = Block()
            block.add(None if pd.isna(doc_id) else int(doc_id), text, chunks(text))
    if block.texts:
        yield flush()


def pieces(docs: DataFrame, path: str = TOKENIZER, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Token pieces of every text; the last piece of a document ends with the end id.

    Nulls, repeats and other columns are as in :func:`packed`; very long texts are cut into as many pieces as they need.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    rows = bounded_batches(docs).select("doc_id", text_or_empty().alias("text"))
    return rows.mapInPandas(lambda batches: _pieces(batches, path, max_tokens, with_ids), schema)


def shortest_pack_first(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Counts of lengths -> patterns: (how many packs, [(length, times in the pack), ...])."""
    open_: dict[int, dict[tuple, int]] = {}  # space left -> pattern -> packs
    volume, space = sum(k * n for k, n in histogram.items()), 0

    def put(left: int, pattern: tuple, packs: int) -> None:
        if packs:
            same = open_.setdefault(left, {})
            same[pattern] = same.get(pattern, 0) + packs

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            left = max((x for x in open_ if x >= length), default=None)
            if left is None:
                # open as many packs as the volume to be placed fills, and no fewer than this length needs
                packs = max(-(-n // (size // length)), min(n, -(-(volume - space) // size)))
                each, more = divmod(n, packs)
                put(size - (each + 1) * length, ((length, each + 1),), more)
                put(size - each * length, ((length, each),), packs - more)
                space += packs * size - n * length
                volume -= n * length
                break
            pattern, packs = next(iter(open_[left].items()))
            del open_[left][pattern]
            if not open_[left]:
                del open_[left]
            used = min(packs, n)
            put(left, pattern, packs - used)
            longer = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(left - length, longer, used)
            n -= used
            space -= used * length
            volume -= used * length
    return [(packs, list(pattern)) for same in open_.values() for pattern, packs in same.items()]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, first offset, times), in order of length and rank."""
    out, rank, sequence = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            out.append((length, rank.get(length, 0), sequence, offset, times))
            rank[length] = rank.get(length, 0) + packs * times
            offset += length * times
        sequence += packs
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack_pieces(cut: DataFrame, max_tokens: int = MAX_TOKENS, salts: int | None = None) -> DataFrame:
    """Written pieces with ``doc_id``, ``start``, ``length`` -> the same with ``sequence_id`` and ``offset``."""
    salts = salts or shuffle_partitions(cut.sparkSession)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # max_tokens rows at most
    table_ = slots(shortest_pack_first(counts, max_tokens))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("place", place).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        # ranks stay below 2**50 for each length
        at = np.searchsorted((table_[:, 0] << 50) + table_[:, 1], (length << 50) + rank, side="right") - 1
        row = table_[at]
        copy, times = np.divmod(rank - row[:, 1], row[:, 4])
        return pd.DataFrame({"sequence_id": row[:, 2] + copy, "offset": row[:, 3] + times * length})

    return ranked.withColumn("slot", slot("length", "rank")).select(*cut.columns, "slot.sequence_id", "slot.offset")


def packed(docs: DataFrame, path: str = TOKENIZER, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece of each row of *docs* with its sequence and offset.

    A null or empty text is the end id alone; a very long text is cut into many pieces.  Pieces of one length
    are ranked by a salt, id and start, ties by their checksum.  Repeated rows are packed as often as they occur; rows
    with a null id are packed with a null id.  Other columns are ignored.  An empty table gives none.
    """
    return pack_pieces(materialise(pieces(docs, path, max_tokens), "packing-pieces"), max_tokens)


def sequences(docs: DataFrame, path: str = TOKENIZER, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``sequence_id``, ``ids`` (little-endian 32-bit), ``n_tokens``: the sequences themselves, before padding."""
    rows = pack_pieces(materialise(pieces(docs, path, max_tokens, with_ids=True), "packing-pieces"), max_tokens)
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # max_tokens ids at most
    joined = F.aggregate(inside, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
