"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text. A text is cut, from left to right, into the longest phrases that
occur in that sample: the walk goes on while the automaton has a transition and starts again at the root where it has
none. A phrase found in a sample of s characters costs log2(s) bits, the place where it stands (the Ziv-Merhav estimate),
but never more than its letters by themselves do, and a letter that the sample does not have costs what it costs by
itself. Letters have one price for all languages, by their mean share in the samples, so samples of unequal sizes
compare: where no sample knows a text, all languages need the same bits and none stands out. The language with the
fewest bits a character, the entropy, wins, and the score is its share of the weights 2^(-SHARPNESS * entropy).

The transitions of all automata are one sparse table with a column for every letter of the sample, whatever its script.
It is made once, on the driver, and looked up as array operations, so many stretches of many texts walk side by side. A
stretch has at most STRETCH characters (a text starts one phrase more for each); a text is read whole, in blocks.

The sample is bounded and documented: of each language the documents that come first by a hash of their id, until
SAMPLE_CHARS characters are reached, of at most SAMPLE_DOCS documents; of a document that is longer than that alone, as
many characters. The shares shrink so that all languages together have ALL_CHARS at most, and of more than SAMPLE_LANGS
languages those with the most documents are learnt. Prediction reads only the text, and all of it.

Cases: a null text or one without a letter is "und" with score 0; without labelled rows every text is; rows without a
language teach nothing; repeated rows are judged alike; equal entropies go to the language that sorts first; letters
that no sample has are phrases of their own; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import arrow_rows, slices_of, thin
from kinspark.llm.sparse_rows import SparseRows

#: Bounds of the training sample: characters and documents of one language, characters of all, languages (the most frequent).
SAMPLE_CHARS, SAMPLE_DOCS, ALL_CHARS, SAMPLE_LANGS = 40_000, 200, 2_000_000, 256
STRETCH, BLOCK_CHARS = 1024, 1 << 20
SHARPNESS = 4.0
UNDETERMINED = "und"
#: Score from which a language stands out (equal entropies in four languages give 0.25), and the most that its entropy may
#: be of that of the letters by themselves; bits of a letter that no sample has.
LEAST_SCORE, MOST_SHARE, RARE_BITS = 0.4, 0.97, 20.0


def training_sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, text) of bounded size: see SAMPLE_CHARS and the other bounds."""
    rows = df.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    rows = rows.filter("lang is not null and k is not null and t is not null and t <> ''")
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGS).collect()]
    if not langs:
        return []
    share = min(SAMPLE_CHARS, ALL_CHARS // len(langs))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k", "n")
    picked = rows.filter(F.col("lang").isin(langs)).select("k", "lang", F.char_length("t").alias("n")).withColumn("rank", F.row_number().over(first))
    use, total = set(), dict.fromkeys(langs, 0)
    for r in sorted(picked.filter(F.col("rank") <= SAMPLE_DOCS).collect(), key=lambda r: (r.lang, r.rank)):
        if total[r.lang] < share:
            total[r.lang] += r.n
            use.add((r.lang, r.k))
    texts = rows.filter(F.col("k").isin([k for _, k in use])).select("lang", "k", F.substring("t", 1, share).alias("t")).groupBy("lang", "k").agg(F.min("t").alias("t"))
    return [(r.lang, r.t) for r in sorted(texts.collect(), key=lambda r: (r.lang, r.k)) if (r.lang, r.k) in use]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; the root is state 0."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class CrossParser:
    """The automata of a sample, one sparse table for all languages; every letter of the sample has a column."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.langs = sorted({lang for lang, _ in sample})
        joined = {lang: _codes(" ".join(t for x, t in sample if x == lang).lower()) for lang in self.langs}
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        met = np.unique(np.concatenate([*joined.values(), np.zeros(0, np.uint32)]))
        met = met[letter[met]]
        self.classes = letter.astype(np.uint32 if len(met) > 65_000 else np.uint16)  # 0: no letter, 1: a letter without a column
        self.classes[met] = np.arange(2, len(met) + 2)
        self.width = len(met) + 2
        rows, cols, values, roots, base, self.bits = [], [], [], [], 0, []
        used = np.zeros(self.width)  # shares of the columns, languages alike
        self.again = np.zeros((len(self.langs), self.width), np.int32)  # from the root, where a phrase has ended
        for i, lang in enumerate(self.langs):
            text = self.classify(joined[lang]).tolist()
            nexts = suffix_automaton(text)
            for s, out in enumerate(nexts):
                rows += [s + base] * len(out)
                cols += out.keys()
                values += [t + base for t in out.values()]
            self.again[i] = base
            self.again[i, list(nexts[0].keys())] = [t + base for t in nexts[0].values()]
            roots.append(base)
            base += len(nexts)
            self.bits.append(math.log2(max(2, len(text))))
            used += np.bincount(text, minlength=self.width) / max(1, len(text))
        self.table = SparseRows(np.array(rows, np.int64), np.array(cols, np.int64), np.array(values, np.int64), base, self.width)
        self.roots = np.array(roots, np.int32)
        with np.errstate(divide="ignore"):
            self.letter_bits = np.minimum(RARE_BITS, -np.log2(used / max(1, len(self.langs))))

    def classify(self, codes: np.ndarray) -> np.ndarray:
        """Column of each character, runs of other characters than letters as one."""
        c = self.classes[codes]
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        return c[keep]

    def entropies(self, texts: list[str | None]) -> list[list[float] | None]:
        """Bits a character in each language and, last, of the letters by themselves; None for a text without a letter. Memory is that of BLOCK_CHARS, not of a text."""
        bits, chars = np.zeros((len(texts), len(self.langs) + 1)), np.zeros(len(texts))
        parts: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, t in enumerate(texts):
            for s in range(0, len(t or ""), BLOCK_CHARS):
                c = self.classify(_codes(t[s : s + BLOCK_CHARS].lower()))
                if c.any():
                    parts.append((i, c))
                    size += len(c)
                if size >= BLOCK_CHARS:
                    self._walk(parts, bits, chars)
                    parts, size = [], 0
        self._walk(parts, bits, chars)
        return [(b / n).tolist() if n and self.langs else None for b, n in zip(bits, chars, strict=True)]

    def _walk(self, parts: list[tuple[int, np.ndarray]], bits: np.ndarray, chars: np.ndarray) -> None:
        """Add the phrases of parts, in bits, and their characters to those of the texts they belong to."""
        if not parts or not self.langs:
            return
        data = np.concatenate([c for _, c in parts])
        start, length, owner, at = [], [], [], 0
        for i, c in parts:
            start += range(at, at + len(c), STRETCH)
            length += [min(STRETCH, len(c) - s) for s in range(0, len(c), STRETCH)]
            owner += [i] * -(-len(c) // STRETCH)
            at += len(c)
        order = np.argsort(-np.array(length), kind="stable")
        starts, lengths, owners = (np.array(x)[order] for x in (start, length, owner))
        state = np.repeat(self.roots[:, None], len(starts), 1)
        cost = np.zeros((len(self.langs), len(starts)))
        spelt = np.zeros_like(cost)  # what the letters of the phrase in hand cost
        alone = np.zeros(len(starts))
        pointer = np.array(self.bits)[:, None]
        live = np.searchsorted(-lengths, -np.arange(STRETCH), "left")
        for step in range(int(lengths[0])):
            k = int(live[step])
            c = data[starts[:k] + step]
            there, to = self.table.get(state[:, :k], c)
            first, letter = self.again[:, c], self.letter_bits[c]
            unknown = ~there & (first == self.roots[:, None])
            cost[:, :k] += np.where(there, 0.0, np.minimum(pointer, spelt[:, :k]))
            cost[:, :k] += unknown * letter
            spelt[:, :k] = np.where(there, spelt[:, :k] + letter, np.where(unknown, 0.0, letter))
            alone[:k] += letter
            state[:, :k] = np.where(there, to, first)
        cost += np.minimum(pointer, spelt)
        np.add.at(chars, owners, lengths)
        np.add.at(bits, owners, np.vstack([cost, alone]).T)

    def judge(self, texts: list[str | None]) -> Iterator[tuple[str, float, float | None, float | None]]:
        """(language, score, entropy, bits a character of the letters by themselves) of each text."""
        start = size = 0
        for stop, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= BLOCK_CHARS or stop == len(texts):
                for found in self.entropies(texts[start:stop]):
                    if found is None:
                        yield UNDETERMINED, 0.0, None, None
                        continue
                    *h, alone = found
                    best = min(range(len(h)), key=h.__getitem__)
                    yield self.langs[best], 1 / sum(2 ** (SHARPNESS * (h[best] - x)) for x in h), h[best], alone
                start, size = stop, 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def identify_language(df: DataFrame, sample: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, entropy) of each row; entropy (bits a character) is null for "und". No shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64())])
    shared = df.sparkSession.sparkContext.broadcast(CrossParser(tuple(sample)))

    def run(batches):
        parser = shared.value

        def rows():
            for batch in batches:
                for keys, texts in slices_of(batch, "k", "t"):
                    for key, found in zip(keys, parser.judge(texts), strict=True):
                        yield key, *found[:3]

        yield from arrow_rows(rows(), schema)

    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(thin(run), f"`{id_col}` long, lang_pred string, score double, entropy double")


def accept(lang: str, score: float, entropy: float | None, alone: float | None) -> bool:
    """A text with letters in which one language stands out and explains more than the letters by themselves do."""
    return lang != UNDETERMINED and score >= LEAST_SCORE and entropy <= MOST_SHARE * alone


def keep_identified(df: DataFrame, sample: list[tuple[str, str]], text_col: str = "text", accepts=accept) -> DataFrame:
    """The rows of df, with all their columns, whose text a language is found for. No shuffle. Without a sample none is judged and all stay."""
    if not sample:
        return df
    shared = df.sparkSession.sparkContext.broadcast(CrossParser(tuple(sample)))

    def run(batches):
        parser = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                yield part.filter(pa.array([accepts(*found) for found in parser.judge(part.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(thin(run), df.schema)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
