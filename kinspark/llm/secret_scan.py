"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what no pattern names.

Novelty: a candidate is a run of SHORTEST characters or more, with letters and digits, that no pattern has found and
that stands in a sensitive context: a word such as "auth" or "credential" shortly before it or, unless it is part of a
URL, anywhere before it on its line; or a line break and no letter or digit between it and a secret found before
(wrapped values). A shorter last line of a wrapped value goes with it, and the body of a private key between its
BEGIN and END marks is reported line by line whatever its novelty. A zstandard compressor is primed with a dictionary of
identifiers followed by the text around the candidate, without the copies of the candidate or of SHORTEST characters of
it; the candidate's marginal bytes are what it adds to the compressed context. The dictionary is learnt from all
texts of the corpus: the words that identifiers are made of (letters in one case, or a capital first) that stand in
LEARN_TEXTS different texts or more, the most common ones, beside a list of names that settings use everywhere. A
secret that is copied from text to text teaches its longest stretches of letters only.
Names and words are mostly references to the dictionary; a string that stays near its own length is reported, at all
its places in the text.

Cases: a null or empty text has no spans; texts of any length are scanned whole; repeated rows are judged alike; spans
count code points, the end exclusive; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import arrow_rows, rows_of, thin

# The patterns of the three base kinds and the shortest match that counts.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "novel")

#: Shortest candidate, characters before it that may make it sensitive, and around it that prime the compressor.
SHORTEST, NEAR, AROUND = 20, 48, 400
#: Share of what a random string of the candidate's letters and length would add, per byte, from which it is novel; and
#: characters up to which the compressor leaves such a string as it is.
NOVELTY, LEAST_NOVELTY, PLAIN = 0.8, 0.5, 40
SENSITIVE = re.compile(r"(?ai:auth|bearer|credential|private|passphrase|pwd|secret|token|key|signature|session|cookie|access|cert|webhook|salt)")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: The marks of a private key, what may stand in its head, and its line breaks, escaped ones too.
BEGIN, END = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----"), re.compile(r"-----(?:END|BEGIN) ")
_HEAD = re.compile(r"[^A-Za-z0-9+/=]*[A-Za-z][A-Za-z-]*: ")
_LINE = re.compile(r"(?:(?!\\[nr])[^\r\n])+")
_BODY = re.compile(r"[A-Za-z0-9+/=]+")
#: What parts a wrapped line from the next, and a shorter last line.
_BREAK, _SOLID, _SPACE = re.compile(r"[\r\n\\]"), re.compile(r"(?<!\\)[A-Za-z0-9]"), re.compile(r"\s")
_TAIL = re.compile(rf"""["'+,\\ \t]*(?:\r\n|\n|\r|\\r\\n|\\n)[ \t"'#*>|]*([A-Za-z0-9+/_-]{{1,{SHORTEST - 1}}}={{0,2}})["'\\,;) \t]*(?=[\r\n]|\\[nr]|-----END|\Z)""")
#: What a name in code or a configuration is made of.
IDENTIFIERS = (
    b"access_token refresh_token client_id client_secret private_key public_key api_key authorization Bearer Basic password username credentials "
    b"connection_string database_url endpoint https://www.example.com/index.html http://localhost:8080/ Content-Type application/json charset=utf-8 "
    b"config configuration settings environment production development staging default example sample placeholder changeme your_key_here "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 XXXXXXXX xxxxxxxx function return import public static "
    b"class string integer boolean object array value number result response request session cookie signature certificate version document"
)

#: Texts an identifier stands in at least; bytes of the dictionary.
LEARN_TEXTS, LEARN_BYTES = 3, 8192
_IDENTIFIER = "[A-Z]?[a-z]{3,}|[A-Z]{4,}"

_HEX_RUN, _WORD_RUN = (bytes(120 if chr(b) in s else 32 for b in range(256)) for s in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_HAS_HEX, _HAS_WORD = b"x" * HEX_LEAST, b"x" * SHORTEST


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches; kind is an index of KINDS."""
    raw = text.encode("utf-8", "replace") if raw is None else raw
    out = []
    low = raw.lower()
    if any(w in low for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _HAS_HEX in raw.translate(_HEX_RUN):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out)


def learnt_identifiers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The dictionary of a corpus: identifiers of all its whole texts, whatever id_col holds.

    Texts are taken apart and counted in the tasks, the copies of a text once: its hash and identifiers are shuffled, not
    the text. The driver gets the identifiers that may fit the dictionary.
    """
    rows = df.select(F.col(text_col).cast("string").alias("t")).filter("t is not null")
    words = F.array_join(F.array_distinct(F.regexp_extract_all("t", F.lit(_IDENTIFIER), F.lit(0))), " ")  # half the bytes of an array
    texts = rows.select(F.xxhash64("t").alias("text"), words.alias("words")).groupBy("text").agg(F.first("words").alias("words"))
    counts = texts.filter("words <> ''").select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEARN_TEXTS)
    return dictionary([(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(LEARN_BYTES // 4).collect()])  # an identifier has three letters or more


def dictionary(counts: list[tuple[str, int]]) -> bytes:
    """Identifiers and in how many texts they stand: the most common last, where the compressor finds them soonest."""
    words, size = [], 0
    for w, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        size += len(w) + 1
        if n < LEARN_TEXTS or size > LEARN_BYTES:
            break
        words.append(w)
    return " ".join(words[::-1]).encode()


def marginal_share(before: bytes, candidate: bytes, words: bytes = b"") -> float:
    """Bytes the candidate adds to the compressed context, per byte of its own."""
    primed = zstandard.ZstdCompressionDict(words + b"\n" + IDENTIFIERS + b"\n" + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    tail = before[-NEAR:]
    return (len(squeeze.compress(tail + candidate)) - len(squeeze.compress(tail))) / len(candidate)


def key_bodies(text: str) -> list[tuple[int, int]]:
    """The lines between the marks of private keys. Where the text between is mostly something else (prose about keys), none."""
    out = []
    for m in BEGIN.finditer(text):
        end = END.search(text, m.end())
        if not end:
            continue
        own, size = [], 0
        for line in _LINE.finditer(text, m.end(), end.start()):
            if _HEAD.match(text, line.start(), line.end()):
                continue
            size += len(line[0].strip())
            at = line.start() + 2 * (text[line.start() : line.start() + 2] in ("\\n", "\\r"))
            own += [x.span() for x in _BODY.finditer(text, at, line.end())]
        if any(e - s >= SHORTEST for s, e in own) and 2 * sum(e - s for s, e in own if e - s >= SHORTEST // 2) >= size:
            out += own
    return out


def _tail(text: str, at: int, run: str, wrapped: bool) -> tuple[int, int] | None:
    """The shorter last line of a value whose line before ends at `at`; wrapped: that line followed another of its width."""
    m = _TAIL.match(text, at)
    if not m:
        return None
    last = m[1]
    if wrapped:
        good = not re.fullmatch("[A-Za-z]?[a-z]+", last)
    else:
        good = last.endswith("=") or all(re.search(x, last) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    return m.span(1) if good and len(last) < len(run) else None


def least_share(candidate: str) -> float:
    """The marginal share from which a candidate is novel: longer random strings are coded by the entropy of their letters."""
    entropy = math.log2(max(2, len(set(candidate)))) / 8
    return max(LEAST_NOVELTY, NOVELTY * (entropy + (1 - entropy) * min(1.0, PLAIN / len(candidate))))


def novel_spans(text: str, known: list[tuple[int, int, int]], raw: bytes | None = None, words: bytes = b"") -> list[tuple[int, int, int]]:
    raw = text.encode("utf-8", "replace") if raw is None else raw
    if _HAS_WORD not in raw.translate(_WORD_RUN):
        return []
    out = [(s, 3, e) for s, e in key_bodies(text)] if b"PRIVATE KEY" in raw else []
    blocks, starts = [(s, e) for s, _, e in out], [m.end() for m in BEGIN.finditer(text)][::-1] if b"PRIVATE KEY" in raw else []
    line, seen, word = 0, 0, False  # where the candidate's line begins, how far it was searched, whether it has a sensitive word
    last, width = -1, 0  # end and length of the line that a wrapped value may go on from
    at_known = at_block = 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        run = m[0]
        start = max(text.rfind("\n", seen, s), text.rfind("\r", seen, s)) + 1
        if start:
            line, seen, word = start, start, False
        word = word or bool(SENSITIVE.search(text, max(line, seen - NEAR), s))
        seen = s
        while starts and starts[-1] <= s:
            last, width = starts.pop(), 0
        while at_block < len(blocks) and blocks[at_block][1] <= s:
            at_block += 1
        if at_block < len(blocks) and blocks[at_block][0] < e:
            continue
        while at_known < len(known) and known[at_known][2] <= s:
            at_known += 1
        near = bool(SENSITIVE.search(text, max(0, s - NEAR), s))
        follows = last >= 0 and bool(_BREAK.search(text, last, s)) and not _SOLID.search(text, last, s)
        found = _overlapping(known, at_known, s, e)
        if found:
            if not (near or word or follows or any(k < 2 for _, k, _ in found)):
                continue
        else:
            mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
            if not (mixed or follows and e - s == width):
                continue
            if not (near or follows or word and not _in_url(text, line, s)):
                continue
            before, after = _without(run, text, max(0, s - AROUND), s, 0, s), _without(run, text, e, min(len(text), e + AROUND), e, len(text))
            around = before + after + "\n" + before[-NEAR:]
            if marginal_share(around.encode("utf-8", "replace"), run.encode(), words) >= least_share(run):
                out.append((s, 3, e))
            elif follows:
                last, width = e, e - s
                continue
            else:
                continue
        tail = _tail(text, e, run, follows and e - s == width)
        if tail and not _overlapping(known, at_known, *tail):
            out.append((tail[0], 3, tail[1]))
        last, width = e, e - s
    return _everywhere(text, out, known)


def _overlapping(known: list[tuple[int, int, int]], at: int, start: int, end: int) -> list[tuple[int, int, int]]:
    """The spans from the at-th on, in order of their starts, that share a character with start to end."""
    out = []
    while at < len(known) and known[at][0] < end:
        if start < known[at][2]:
            out.append(known[at])
        at += 1
    return out


def _without(run: str, text: str, start: int, end: int, least: int, most: int) -> str:
    """text[start:end] with blanks for each stretch of SHORTEST characters that run has too, also where start or end
    cuts it; least and most are as far as one may look for that."""
    more = SHORTEST - 1
    low, high = max(least, start - more), min(most, end + more)
    out = list(text[low:high])
    for m in CANDIDATE.finditer(text, low, high):
        other = m[0]
        for i in range(len(other) - more):
            if other[i : i + SHORTEST] in run:
                at = m.start() - low + i
                out[at : at + SHORTEST] = " " * SHORTEST
    return "".join(out[start - low : start - low + end - start])


def _everywhere(text: str, found: list[tuple[int, int, int]], known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """found, with the further places of the same strings, alone or in a longer run, that no span has yet."""
    same: dict[str, set[str]] = {}
    for s, _, e in found:
        if e - s >= SHORTEST:
            same.setdefault(text[s : s + SHORTEST], set()).add(text[s:e])
    if not same:
        return sorted(found)
    taken, high, out, at = sorted(found + known), -1, list(found), 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            high = max(high, taken[at][2])
            at += 1
        i = max(m.start(), high)
        while i + SHORTEST <= m.end():
            n = max((len(x) for x in same.get(text[i : i + SHORTEST], ()) if text.startswith(x, i, m.end())), default=0)
            if n:
                out.append((i, 3, i + n))
            i += n or 1
    return sorted(out)


def _in_url(text: str, line: int, at: int) -> bool:
    start = text.rfind("://", max(line, at - 2048), at)
    return start >= 0 and not _SPACE.search(text, start, at)


def find_secrets(text: str | None, words: bytes = b"") -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each in order."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "replace")
    base = base_spans(text, raw)
    return base, sorted(base + novel_spans(text, base, raw, words))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: bytes | None = None) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) in order of start and kind. No shuffle of texts.

    words: a dictionary of identifiers; by default that of df.
    """
    words = learnt_identifiers(df, id_col, text_col) if words is None else words
    schema = pa.schema([(id_col, pa.int64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for key, text in rows_of(batch, "k", "t"):
                    yield key, [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_secrets(text, words)[1]]

        yield from arrow_rows(rows(), schema)

    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(thin(run), f"`{id_col}` long, spans array<struct<kind:string,start:int,end:int>>")


def redact_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: bytes | None = None) -> DataFrame:
    """df with every span of the text column replaced by a mark; all columns stay. A null text stays null."""
    words = learnt_identifiers(df, id_col, text_col) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [redacted(t, find_secrets(t, words)[1]) if t else t for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return df.mapInArrow(thin(run), df.schema)
