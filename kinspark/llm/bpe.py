"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold, for each symbol and its right neighbour, the rank of the merge that joins them; an
inner node holds the smaller of its children. The root is therefore the leftmost pair of the lowest rank. A merge
changes three leaves, each an update of logarithmic cost, so a pre-token of n symbols takes O(n log n) time: a run of
100,000 letters without a space is no special case.

Cases: a null text is an empty one; an empty text has no ids and decodes to an empty text; repeated rows and ties are
encoded alike, each row for itself; other columns of the table are not read.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import arrow_rows, rows_of, slices_of, thin
from kinspark.llm.sparse_rows import SparseRows

# Fixed value: the pattern by which the vocabulary's pre-tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pre-tokens that a worker keeps the ids of, and characters of them; a full table is emptied, which costs time and no result.
CACHE_PIECES, CACHE_CHARS = 200_000, 4 << 20
#: Pre-tokens of up to so many bytes are merged side by side, one segment tree each in the rows of one array.
WIDE = 64
#: Characters of text that are encoded together.
CHUNK_CHARS = 1 << 19
_NONE = 1 << 62
_POS = 32
#: The same for the arrays: positions below WIDE and ranks below 2^24.
_FAR, _COLUMN = (1 << 31) - 1, 6
#: White space of the vocabulary's rules (Unicode White_Space), which differs from str.split() in U+001C-U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: White space beyond ASCII that cuts texts like a blank.
_BLANKS = {c: " " for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def _settled(c: int) -> bool:
    """Whether case, class and normal form of a character are the same by any version of Unicode that a library may have."""
    if c <= 0x52F or c in _BLANKS or 0x1F300 <= c <= 0x1FAFF:  # the last are signs or unassigned, which are cut alike
        return not 0x1C <= c <= 0x1F
    ch, old = chr(c), unicodedata.ucd_3_2_0
    kind = unicodedata.category(ch)
    same = kind == old.category(ch) and kind[0] in "LNPS" and unicodedata.combining(ch) == 0
    return same and unicodedata.normalize("NFC", ch) == ch and len(ch.lower()) == 1 and not 0x1100 <= c <= 0x11FF


def _ranges(keep) -> str:
    """The characters below U+20000 that are kept, as ranges of a regular expression."""
    flags = np.fromiter(map(keep, range(0x20000)), bool, 0x20000)
    flags[0xD800:0xE000] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


#: Other characters: texts that have them are normalised and cut by the library's own rules.
_UNSETTLED = re.compile(f"[^{_ranges(_settled)}]")


class SegmentTree:
    """Minimum over a row of keys with point updates."""

    __slots__ = ("size", "tree")

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        tree = [_NONE] * size + keys + [_NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.size, self.tree = size, tree

    def least(self) -> int:
        return self.tree[1]

    def put(self, i: int, key: int) -> None:
        tree = self.tree
        i += self.size
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b


class Runs:
    """Runs of ids by number, one after another in an array that grows."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.count = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first of the new runs."""
        first, n, m = self.count, len(sizes), len(flat)
        if self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used // 2 + m, np.uint32)])
        if first + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x[:first], np.zeros(first // 2 + n, np.int64)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + m] = flat
        self.sizes[first : first + n] = sizes
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = first + n, self.used + m
        return first

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs one after another, their sizes)."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(total)], sizes


class BpeCodec:
    """Encoder and decoder for a vocabulary file of the tokenizers library (byte-level symbols, word-end suffix)."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        pairs = np.array(list(self.merges), np.int64)
        self.none = max(vocab.values()) + 1  # no symbol
        self.ranks = SparseRows(pairs >> 20, pairs & 0xFFFFF, np.array([m[0] for m in self.merges.values()], np.int64), self.none + 1, self.none + 1)
        self.merged_by_rank = np.zeros(len(model["merges"]) + 1, np.int32)
        for rank, new in self.merges.values():
            self.merged_by_rank[rank] = new
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        spaced = [b""] * (max(self.tokens) + 1)
        for i, t in self.tokens.items():
            spaced[i] = t + b" "
        self.spaced = pa.array(spaced, pa.binary())
        parts = spec["pre_tokenizer"]["pretokenizers"]
        if next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split") != PATTERN:
            raise ValueError("the pre-tokenizer cuts by another pattern")
        chars = _byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.suffix] for c in chars]
        self.inner_of, self.last_of = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self.by_char = {c: b for b, c in enumerate(chars)}
        self.pieces: dict[str, int] = {}  # number of a pre-token in runs
        self.runs, self.held = Runs(), 0

    @functools.cached_property
    def library(self):
        """The library's own rules, for rare characters."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until no pair can be merged."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        keys = []
        for i in range(n - 1):
            m = merges.get(symbols[i] << 20 | symbols[i + 1])
            keys.append(_NONE if m is None else m[0] << _POS | i)
        tree = SegmentTree(keys)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        put = tree.put
        while (key := tree.tree[1]) != _NONE:
            i = key & 0xFFFFFFFF
            j = right[i]
            symbols[i] = s = merges[symbols[i] << 20 | symbols[j]][1]
            symbols[j] = -1
            k = right[i] = right[j]
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                left[k] = i
                m = merges.get(s << 20 | symbols[k])
                put(i, _NONE if m is None else m[0] << _POS | i)
            else:
                put(i, _NONE)
            p = left[i]
            if p >= 0:
                m = merges.get(symbols[p] << 20 | s)
                put(p, _NONE if m is None else m[0] << _POS | p)
        return [s for s in symbols if s >= 0]

    def _keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf keys, rank before position, of the pairs (a, b)."""
        there, rank = self.ranks.get(a, b)
        return np.where(there, rank << _COLUMN | at, _FAR).astype(np.int32)

    def merge_rows(self, raws: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many pre-tokens of up to `size` bytes each: row r of the arrays is the segment tree of raws[r].

        Gives the ids of all, one after another, and their numbers.
        """
        n, lengths = len(raws), np.array([len(r) for r in raws])
        width, none = size + 1, self.none  # the last column stands for "no neighbour"
        sym = np.full((n, width), none, np.int32)
        data = np.frombuffer(b"".join(raws), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym[row, col] = self.inner_of[data]
        ends = np.cumsum(lengths) - 1
        sym[np.arange(n), lengths - 1] = self.last_of[data[ends]]
        right = np.tile(np.minimum(np.arange(1, width + 1, dtype=np.int32), size), (n, 1))
        right[np.arange(n), lengths - 1] = size
        left = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        left[:, 0] = size
        tree = np.full((n, 2 * size), _FAR, np.int32)
        tree[:, size : 2 * size - 1] = self._keys(sym[:, : size - 1], sym[:, 1:size], np.arange(size - 1))
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        sym_f, right_f, left_f, tree_f = sym.ravel(), right.ravel(), left.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree_f[rows * (2 * size) + 1]
            live = root != _FAR
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            base, root_at = rows * width, rows * (2 * size)
            i = root & ((1 << _COLUMN) - 1)
            j = right_f[base + i]
            new = self.merged_by_rank[root >> _COLUMN]
            k = right_f[base + j]
            p = left_f[base + i]
            sym_f[base + i] = new
            sym_f[base + j] = none
            right_f[base + i] = k
            left_f[base + k] = i
            tree_f[root_at + np.where(j < size, size + j, 0)] = _FAR
            tree_f[root_at + size + i] = self._keys(new, sym_f[base + k], i)
            tree_f[root_at + np.where(p < size, size + p, 0)] = self._keys(sym_f[base + p], new, p)
            node = np.stack([size + i, np.where(j < size, size + j, size), np.where(p < size, size + p, size)])
            for _ in range(size.bit_length() - 1):
                node >>= 1
                two = root_at + 2 * node
                tree_f[root_at + node] = np.minimum(tree_f[two], tree_f[two + 1])
        keep = sym[:, :size] != none
        return sym[:, :size][keep].astype(np.uint32), keep.sum(1)

    def learn(self, texts: list[str]) -> None:
        """Put the ids of different pre-tokens into the table of pieces."""
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in texts:
            raw = p.encode()
            n = len(raw)
            self.held += n
            size = 8 if n <= 8 else 16 if n <= 16 else 32 if n <= 32 else WIDE if n <= WIDE else 0
            if size not in by_size:
                by_size[size] = [], []
            names, raws = by_size[size]
            names.append(p)
            raws.append(raw)
        for size, (names, raws) in by_size.items():
            for s in range(0, len(names), 8192):
                part = names[s : s + 8192]
                if size:
                    flat, sizes = self.merge_rows(raws[s : s + 8192], size)
                else:
                    each = [self._piece(raw) for raw in raws[s : s + 8192]]
                    flat, sizes = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])
                first = self.runs.add(flat, sizes)
                self.pieces.update(zip(part, range(first, first + len(part)), strict=True))

    def _piece(self, raw: bytes) -> list[int]:
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return self.merge(symbols)

    def _odd(self, text: str) -> list[int]:
        """As the library normalises and cuts a text with rare characters; merged by the segment tree like any other."""
        ids: list[int] = []
        for w in _SPACE.split(self.library.normalizer.normalize_str(text)):
            for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(w) if w else ():
                ids += self._piece(bytes(self.by_char[c] for c in mapped))
        return ids

    def decode(self, ids) -> bytes:
        """The text, in UTF-8, of ids; this vocabulary has no decoder of its own, so tokens are joined by spaces."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in ids if i in tokens])

    def _plain(self, text: str) -> str | None:
        """The text as it is cut at white space; None if it has rare characters."""
        latin = _is_latin(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f") if latin else _UNSETTLED.search(text) is not None:
            return None
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return text.replace("\x85", " ").replace("\xa0", " ") if latin else text.translate(_BLANKS)

    def _parts(self, text: str | None) -> list[str | int | list[int]]:
        """What a text is made of: plain texts, special tokens, and ids of what has rare characters."""
        if not text:
            return []
        cut = self.special_re.split(text) if self.special_re is not None and "<|" in text else [text]
        out: list[str | int | list[int]] = []
        for part in filter(None, cut):
            if len(cut) > 1 and part in self.special:
                out.append(self.special[part])
            else:
                plain = self._plain(part)
                if plain is None:
                    out.append(self._odd(part))
                else:
                    out += [plain] if len(plain) < 2 * CHUNK_CHARS else _blocks(plain)
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its ids, unsigned 32-bit integers."""
        start = chars = 0
        for stop, text in enumerate(texts, 1):
            chars += len(text or "")
            if chars >= CHUNK_CHARS or stop == len(texts):
                cut = [self._parts(t) for t in texts[start:stop]]
                plain = self._encode_plain([p for parts in cut for p in parts if type(p) is str])
                for parts in cut:
                    own = [next(plain) if type(p) is str else np.array([p] if type(p) is int else p, np.uint32) for p in parts]
                    yield own[0] if len(own) == 1 else np.concatenate([*own, np.zeros(0, np.uint32)])
                start, chars = stop, 0

    def _encode_plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of plain texts, in blocks of CHUNK_CHARS or so."""
        start = chars = 0
        for stop, text in enumerate(texts, 1):
            chars += len(text)
            if chars >= CHUNK_CHARS or stop == len(texts):
                yield from self._encode_block(texts[start:stop])
                start, chars = stop, 0

    def _encode_block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each different pre-token of the texts is looked up once."""
        if len(self.pieces) > CACHE_PIECES or self.held > CACHE_CHARS:
            self.pieces, self.runs, self.held = {}, Runs(), 0
        coded, stops = _pre_tokens(texts)
        met = coded.dictionary.to_pylist()
        pieces = self.pieces
        self.learn([p for p in met if p not in pieces])
        numbers = np.fromiter(map(pieces.__getitem__, met), np.int64, len(met))[coded.indices.to_numpy()]
        flat, sizes = self.runs.get(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[stops]
        start = 0
        for end in ends.tolist():
            yield flat[start:end]
            start = end

    def texts_of(self, ids: np.ndarray) -> bytes:
        """decode() of many ids of the vocabulary, as an array operation."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(ids)], pa.int64()), self.spaced.take(pa.array(ids))), b"")[0].as_py()[:-1] if len(ids) else b""


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _blocks(text: str) -> Iterator[str]:
    """A plain text in blocks that end before white space."""
    start = 0
    while start < len(text):
        m = _SPACE.search(text, start + CHUNK_CHARS)
        stop = m.start() if m else len(text)
        yield text[start:stop]
        start = stop


def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 any other, of the characters that a plain text may have."""
    kind = {"L": 1, "N": 2}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x20000)], np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


_KIND = _kinds()


def _pre_tokens(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(pre-tokens of all texts one after another, where those of each text end), as PATTERN cuts them.

    A pre-token is a run of letters, one number, a run of other signs, or an apostrophe at the head of one with the
    letters of a contraction.
    """
    joined = "\n".join([*texts, ""])
    raw = joined.encode()
    code = np.frombuffer(raw, np.uint8) if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _KIND[code]
    begins = np.empty(len(kind), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == 2
    quote = np.flatnonzero(code == 39)
    quote = quote[begins[quote] & (kind[quote + 1] == 1)]  # the text ends with a line break
    if len(quote):
        one, two = code[quote + 1], code[np.minimum(quote + 2, len(code) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & np.isin(one.astype(np.int64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = True
        begins[quote[long] + 3] = True
    if code.dtype == np.uint8:
        width = kind != 0
    else:
        width = ((kind != 0) * (1 + (code >= 0x80).view(np.uint8) + (code >= 0x800) + (code >= 0x10000))).astype(np.uint8)
    at = np.flatnonzero(begins & (kind != 0))
    bytes_before = np.concatenate([[0], np.cumsum(width)])
    offsets = np.append(bytes_before[at], bytes_before[-1])
    solid = raw.translate(None, b"\t\n\v\f\r ")
    parts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(solid))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return pc.dictionary_encode(parts), np.searchsorted(at, ends)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary, decoded string): ids are little-endian unsigned 32-bit integers. No shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)

        def rows():
            for batch in batches:
                for keys, texts in slices_of(batch, "k", "t"):
                    for key, ids in zip(keys, bpe.encode_many(texts), strict=True):
                        yield key, ids.astype("<u4").tobytes(), bpe.texts_of(ids).decode("utf-8", "replace")

        yield from arrow_rows(rows(), schema, lambda r: len(r[1]) + len(r[2]))

    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(thin(run), f"`{id_col}` long, ids binary, decoded string")


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>)."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = codec(path)

        def rows():
            for batch in batches:
                for keys, texts in slices_of(batch, "k", "t"):
                    for key, ids in zip(keys, bpe.encode_many(texts), strict=True):
                        yield key, ids.tolist()

        yield from arrow_rows(rows(), schema, lambda r: 8 * len(r[1]))

    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(thin(run), f"`{id_col}` long, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text string) of an array<int> column; null ids are an empty text, ids outside the vocabulary are left out."""
    schema = pa.schema([(id_col, pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = codec(path)

        def rows():
            for batch in batches:
                for key, ids in rows_of(batch, "k", "t"):
                    yield key, bpe.decode(ids or []).decode("utf-8", "replace")

        yield from arrow_rows(rows(), schema, lambda r: len(r[1]))

    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(ids_col).alias("t"))
    return picked.mapInArrow(thin(run), f"`{id_col}` long, text string")
