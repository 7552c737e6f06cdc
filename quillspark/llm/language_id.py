"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text recognises every
substring of that sample.  A text is parsed from left to right into the longest phrases that the
sample contains; the language whose sample needs the fewest phrases, each weighted by the bits that
point into the sample, wins.  Letters are coded as their UTF-8 bytes, so that none are merged.  The
automata are one sparse transition table, built from the samples and broadcast: its size follows the
number of languages.  The texts of a batch walk through it side by side, long ones in blocks that are
joined again exactly: a block's parse from the root soon meets the parse that comes in from the block
before, and what differs up to there is taken over from the latter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, release, slices, table, text_or_empty

#: The bound of the labelled sample: rows per language, characters read of a row, characters per
#: language.  Only fitting is bounded; every labelled language is learnt and every text judged whole.
ROWS_PER_LANGUAGE = 64
ROW_CHARS = 20_000
SAMPLE_CHARS = 32_000
#: Texts are parsed side by side in blocks of so many symbols; the count is that of the whole text's parse.
BLOCK = 1024
BATCH_CHARS = 1_000_000
#: A language's limit of phrases per letter: so many times the given quantile over pieces of its labelled
#: text that the automaton hasn't seen, and for short texts so many phrases more.
PIECE, QUANTILE, MARGIN, EXTRA_PHRASES = 100, 0.99, 1.6, 3
#: Share of that limit above which a text is foreign to every learnt language.
FOREIGN_RATE = 1.0
SEPARATOR = 1
_PLACE = 0xFFFFFFFF


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; the root is state 0."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


def displaced(nxt: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of transitions laid over each other in one table: the place of each state, and the table.

    State ``s`` goes by ``c`` to the state at ``table[place[s] + c] & 0xFFFFFFFF``, if the upper half there is
    ``place[s]``.  States with transitions have places of their own; those without share one.
    """
    sizes = np.fromiter(map(len, nxt), np.int64, len(nxt))
    room = 2 * int(sizes.sum()) + 256
    owner, target = [-1] * (room + 512), [0] * (room + 512)
    place, used, seed = [0] * len(nxt), set(), 1
    for s in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
        row, tries = nxt[s], 0
        while True:
            seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
            at, tries = seed % room + 1, tries + 1
            if at not in used and all(owner[at + c] < 0 for c in row):
                break
            if tries > 2000:  # a place of its own at the end
                at = len(owner) - 255
                owner += [-1] * 512
                target += [0] * 512
                break
        used.add(at)
        place[s] = at
        for c, to in row.items():
            owner[at + c], target[at + c] = at, to
    free = 256
    for s in np.flatnonzero(sizes == 1).tolist():
        ((c, to),) = nxt[s].items()
        while True:
            while free < len(owner) and owner[free] >= 0:
                free += 1
            if free + 512 > len(owner):
                owner += [-1] * 1024
                target += [0] * 1024
            if free - c not in used:
                break
            free += 1
        used.add(free - c)
        place[s], owner[free], target[free] = free - c, free - c, to
        free += 1
    last = len(owner)  # behind it nothing is owned
    place, owner = np.array(place, np.int64), np.array(owner + [-1] * 512, np.int64)
    place[sizes == 0] = last
    target = np.array(target + [0] * 512, np.int64)
    return place, np.where(owner >= 0, owner << 32 | place[target], -1)


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point the lower case (``SEPARATOR`` if it is no part of a word), and whether it is a letter."""
    lower, letter = np.full(0x110000, SEPARATOR, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            lower[i] = ord(c.lower()[0])
        elif unicodedata.category(c)[0] == "M":
            lower[i] = i
    return lower, letter


class CrossParser:
    def __init__(self, samples: dict[str, str], limits: dict[str, float] | None = None):
        self.languages = sorted(samples)
        self.limits = None if limits is None else np.array([limits[x] for x in self.languages])
        self.lower, self.letter = _alphabet()
        tables, begins, self.roots, self.bits, behind = [], [], [], [], 0
        for language in self.languages:
            codes, _ = self._symbols([samples[language]])
            codes = codes[np.cumsum((codes & 0xC0) != 0x80) <= SAMPLE_CHARS]
            nxt = suffix_automaton(codes.tolist())
            place, table = displaced(nxt)
            begin = np.full(256, -1, np.int64)
            begin[list(nxt[0])] = [place[x] + behind for x in nxt[0].values()]
            begins.append(begin)
            tables.append(np.where(table >= 0, table + (behind << 32 | behind), -1))
            self.roots.append(place[0] + behind)
            self.bits.append(np.log2(len(codes) + 2))
            behind += len(table)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.begin = np.array(begins, np.int64).reshape(-1, 256)
        self.roots = np.array(self.roots, np.int64)[:, None]
        self.bits = np.array(self.bits)

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, runs of separators as one, and the number of codes of each text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        lower = self.lower[points]
        gap = lower == SEPARATOR
        keep = np.ones(len(lower), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        keep[starts[starts < len(lower)]] = True
        size = np.where(keep, 1 + (lower >= 0x80).astype(np.uint8) + (lower >= 0x800) + (lower >= 0x10000), 0).astype(np.uint8)
        total = np.zeros(len(size) + 1, np.int32 if len(size) < 1 << 28 else np.int64)
        np.cumsum(size, out=total[1:])
        codes = np.empty(total[-1], np.uint8)
        for n in np.unique(size[keep]).tolist():
            here = np.flatnonzero(size == n)
            at, letters = total[here], lower[here]
            for k in range(n):
                byte = letters >> (6 * (n - 1 - k))
                codes[at + k] = byte if n == 1 else (byte | (0xF00 >> n) & 0xFF) if k == 0 else (byte & 0x3F | 0x80)
        return codes, total[ends] - total[starts]

    def letters(self, texts: list[str]) -> np.ndarray:
        """Whether each text has a letter."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        total = np.r_[0, np.cumsum(self.letter[points])]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        return np.diff(np.r_[0, total[ends]]) > 0

    def _step(self, row: np.ndarray, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a symbol each, and the phrases that end by it (before it, and at it if none begins with it)."""
        found = self.table[state + code]
        nxt = found & _PLACE
        off = np.flatnonzero(found >> 32 != state)
        ended = np.zeros(len(state), np.int32)
        root, first = self.roots[row[off], 0], self.begin[row[off], code[off]]
        ended[off] = (state[off] != root).astype(np.int32) + (first < 0)
        nxt[off] = np.where(first < 0, root, first)
        return nxt, ended

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (languages x texts), and its number of letters and separators."""
        codes, n = self._symbols(texts)
        blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(n) - n)[owner] + inside * BLOCK
        size = np.minimum(BLOCK, n[owner] - inside * BLOCK)
        order = np.argsort(-size, kind="stable")
        state = np.repeat(self.roots, len(size), axis=1)
        count = np.zeros(state.shape, np.int32)
        at, sizes = begin[order], size[order]
        active = np.searchsorted(-sizes, -np.arange(BLOCK), side="left")  # blocks longer than t
        for t in range(int(sizes[0]) if len(sizes) else 0):
            m = active[t]
            code, now = codes[at[:m] + t], state[:, :m]
            found = self.table[now + code]
            nxt = found & _PLACE
            row, off = np.nonzero(found >> 32 != now)  # a phrase ends before the symbol, and one at it if no phrase begins with it
            first, root = self.begin[row, code[off]], self.roots[row, 0]
            count[row, off] += (now[row, off] != root).astype(np.int32) + (first < 0)
            nxt[row, off] = np.where(first < 0, root, first)
            state[:, :m] = nxt
        back = np.argsort(order, kind="stable")
        state, count = state[:, back], count[:, back]
        self._join(codes, begin, size, inside, state, count)
        last = np.r_[inside[1:] == 0, True] if len(inside) else np.zeros(0, bool)
        count += last & (state != self.roots)
        out = np.zeros((len(self.languages), len(texts)))
        for row, c in zip(out, count):
            row += np.bincount(owner, c, len(texts))
        inner = np.r_[0, np.cumsum((codes & 0xC0) == 0x80)]  # further bytes of a letter
        ends = np.cumsum(n)
        return out, n - (inner[ends] - inner[ends - n])

    def _join(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, inside: np.ndarray, end: np.ndarray, count: np.ndarray) -> None:
        """Correct *count* and *end* of blocks, parsed from the root, for the states that come in from the blocks before."""
        alone = count.copy()
        ended_alone = end.copy()
        row, block = np.nonzero((end != self.roots)[:, :-1] & (inside[1:] > 0)) if len(inside) else (np.zeros(0, np.int64),) * 2
        block = block + 1
        while len(block):
            # two parses of each block, until they meet
            lane = np.arange(len(block))
            own = self.roots[row, 0].copy()
            came = end[row, block - 1].copy()
            more = np.zeros(len(block), np.int64)
            met = np.zeros(len(block), bool)
            t = 0
            while len(lane := lane[(own[lane] != came[lane]) & (t < size[block[lane]])]):
                code = codes[begin[block[lane]] + t]
                own[lane], a = self._step(row[lane], own[lane], code)
                came[lane], b = self._step(row[lane], came[lane], code)
                more[lane] += b.astype(np.int64) - a
                t += 1
            met = own == came
            count[row, block] = alone[row, block] + more
            new = np.where(met, ended_alone[row, block], came)
            changed = new != end[row, block]
            end[row, block] = new
            row, block = row[changed], block[changed]
            follows = block + 1 < len(inside)
            row, block = row[follows], block[follows] + 1
            follows = inside[block] > 0
            row, block = row[follows], block[follows]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (``und`` if a text has no letter), margin over the next language, phrases per letter or their share of the limit."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        count, n = self.phrases(texts)
        weighted = count * self.bits[:, None]
        best = weighted.argmin(axis=0)  # of equal ones the first in alphabetical order
        low = np.sort(weighted, axis=0)
        known = self.letters(texts)
        margin = 1 - low[0] / np.maximum(low[1], 1e-9) if len(low) > 1 else np.ones(len(texts))
        rate = count[best, np.arange(len(texts))] / np.maximum(n, 1)
        if self.limits is not None:
            rate = rate / (self.limits[best] + EXTRA_PHRASES / np.maximum(n, 1))
        return [self.languages[i] if k else "und" for i, k in zip(best, known)], np.where(known, np.clip(margin, 0, 1), 0.0), np.where(known, rate, 1.0)


def foreign_limits(samples: dict[str, str]) -> dict[str, float]:
    """Phrases per letter that texts of each language stay below; no limit if its sample has less than two pieces.

    The automaton of the first part of a sample (half of it at most) parses the pieces of the rest.
    """
    seen = {x: min(SAMPLE_CHARS, len(text) // 2) for x, text in samples.items()}
    limits = {}
    for language, text in samples.items():
        rest = text[seen[language] :]
        pieces = [rest[i : i + PIECE] for i in range(0, len(rest) - PIECE + 1, PIECE)]
        limits[language] = float("inf")
        if pieces:
            count, n = CrossParser({language: text[: seen[language]]}).phrases(pieces)
            limits[language] = MARGIN * float(np.quantile(count[0] / np.maximum(n, 1), QUANTILE))
    return limits


def labelled_samples(docs: DataFrame) -> dict[str, str]:
    """A bounded sample of text for each language from the rows that may be learnt from.

    Rows come in order of a hash of the id, so a sample doesn't depend on how the table is stored.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    learn = docs.filter((remainder != 0) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = learn.withColumn("nth", nth).filter(F.col("nth") <= ROWS_PER_LANGUAGE).select("doc_id", "lang").collect()
    if not picked:
        return {}
    ids, most = [r["doc_id"] for r in picked], sorted({r["lang"] for r in picked})
    rows = docs.filter(F.col("doc_id").isin(ids) & F.col("lang").isin(most) & (F.length("text") > 0))
    rows = rows.groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, ROW_CHARS)).alias("text"), F.min(F.xxhash64("doc_id")).alias("h"))
    earlier = Window.partitionBy("lang").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(earlier), F.lit(0))).filter(F.col("before") < 2 * SAMPLE_CHARS)
    samples = {lang: "" for lang in most}
    for row in chosen.orderBy("h", "doc_id").collect():
        samples[row["lang"]] += row["text"] + "\n"
    return {lang: text for lang, text in samples.items() if text}


def _parser(docs: DataFrame, samples: dict[str, str]):
    """A broadcast parser: some megabytes for each language."""
    return docs.sparkSession.sparkContext.broadcast(CrossParser(samples, foreign_limits(samples)))


def identify(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """Rows of *docs* (``doc_id``, ``text``, ``lang``) -> ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rate``.

    ``lang_pred`` is ``und`` for a text that is null or has no letter, and for all texts where nothing
    could be learnt.  ``score`` is the margin over the next language, 0 for ``und``; ``rate`` the
    phrases per letter as a share of the language's limit, which a foreign text is above.  Of languages that
    need equally few bits the first in alphabetical order wins.  Very long texts are parsed whole.  Rows with
    a null id are judged but neither learnt from nor held out.
    Repeated rows give equal results; other columns are ignored; an empty table gives none.
    """
    samples = labelled_samples(docs) if samples is None else samples
    shared = _parser(docs, samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        parser = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for start, end in slices([len(x) for x in texts], BATCH_CHARS):
                lang, score, rate = parser.judge(texts[start:end])
                part = batch[["doc_id", "held_out"]].iloc[start:end].reset_index(drop=True)
                yield part.assign(lang_pred=lang, score=score, rate=rate)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = bounded_batches(docs).select("doc_id", held_out.alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, rate double")


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of *docs* in a learnt language: not ``und``, and not above ``FOREIGN_RATE``; all columns kept.

    Null, empty and letterless texts go, as does everything where nothing could be learnt; repeated rows all
    stay or all go; very long texts are judged whole; an empty table gives none.
    """
    shared = _parser(docs, labelled_samples(docs))

    @F.pandas_udf("boolean")
    def is_known(text: pd.Series) -> pd.Series:
        release()
        parser, texts, out = shared.value, text.tolist(), []
        for start, end in slices([len(x) for x in texts], BATCH_CHARS):
            lang, _, rate = parser.judge(texts[start:end])
            out += [x != "und" and r <= FOREIGN_RATE for x, r in zip(lang, rate)]
        return pd.Series(out, dtype=bool)

    return bounded_batches(docs).filter(is_known(text_or_empty()))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
