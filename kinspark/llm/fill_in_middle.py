"""Fill-in-the-middle transformation by a streaming matcher in constant memory.

A text is a row of units (a run of ASCII letters, or one other character). Two seeded ranks cut it into prefix, middle
and suffix. The matcher goes over the text twice and stores no unit: the first pass counts the units, the second moves
a lazy iterator of matches to the smaller rank and on to the larger, and only the places where it stands are kept. The
text itself stays in the JVM: what comes back from Python are three numbers, and the output is put together by string
functions. No shuffle.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` the text as it is. The
numbers that choose cuts and form come from the SHA-256 of the seed and the document's id.

Cases: a null text counts as empty, an empty one has no unit and is plain; a text that contains one of the three marks
is plain, so every output can be taken apart again; a null id hashes as an empty one; repeated rows get equal outputs;
texts of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of a text, and the marks before its parts.
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_CUTS = pa.struct([("n", pa.int64()), ("prefix", pa.int64()), ("middle", pa.int64())])


def count_units(text: str) -> int:
    """First pass."""
    numbers = itertools.count()
    deque(zip(UNIT.finditer(text), numbers, strict=False), maxlen=0)
    return next(numbers)


def ends_at(text: str, *ranks: int) -> Iterator[int]:
    """Second pass: where each of the ascending ranks of units ends, in code points."""
    units, done, at = UNIT.finditer(text), 0, 0
    for rank in ranks:
        if rank > done:
            at = next(itertools.islice(units, rank - done - 1, None)).end()
            done = rank
        yield at


def cuts(text: str, first: int | None, second: int | None) -> tuple[int, int | None, int | None]:
    """(units, characters of the prefix, characters of the middle); without numbers to cut by, only the units."""
    n = count_units(text)
    if first is None or second is None:
        return n, None, None
    start, stop = ends_at(text, *sorted((first % (n + 1), second % (n + 1))))
    return n, start, stop - start


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix", "middle")]))
def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, firsts, seconds in batches:
        found = (cuts(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(texts, firsts, seconds, strict=True))  # one text at a time
        yield pa.array([dict(zip(("n", "prefix", "middle"), x, strict=True)) for x in found], _CUTS)


def drawn(id_col: str, seed: int, which: int) -> Column:
    """The which-th (from 1) group of eight hexadecimal digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def fill_in_middle(df: DataFrame, seed: int = 1, percent: int = 90, percent_spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of each row.

    percent of the documents are cut, percent_spm of those with the suffix first.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col), text.alias("t"), *(drawn(id_col, seed, i).alias(f"h{i}") for i in (1, 2, 3, 4)))
    marked = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    plain = (F.col("t") == "") | marked | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < percent_spm, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    cut = F.col("form") != "plain"
    rows = rows.withColumn("c", _cuts("t", F.when(cut, F.col("h1")), F.when(cut, F.col("h2"))))
    start, length = F.col("c.prefix"), F.col("c.middle")
    prefix, middle = F.substr("t", F.lit(1), start), F.substr("t", start + 1, length)
    suffix = F.substr("t", start + length + 1)
    output = (
        F.when(~cut, F.col("t"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return rows.select(id_col, F.col("c.n").alias("n"), "form", start.alias("prefix_chars"), length.alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from: no part contains a mark, so the first of each kind is the mark."""
    body, middle = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    inside = F.substr(body, F.lit(len(PREFIX) + 1))

    def part(mark: str, i: int) -> Column:
        return F.split_part(inside, F.lit(mark), F.lit(i))

    return (
        F.when(form == "psm", F.concat(part(SUFFIX, 1), middle, part(SUFFIX, 2)))
        .when(form == "spm", F.concat(part(PREFIX, 2), middle, part(PREFIX, 1)))
        .otherwise(output)
    )
