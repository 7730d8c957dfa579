"""Token counts as delta-maintained rollups. Native.

A rollup holds additive totals (documents, tokens) by source, language and tokenizer version. It is kept up to date by
batches of signed rows: an insert adds a document, a delete takes it away, a revised count takes the old count away and
adds the new one. A batch is summed by key before it is stored (the sums combine before the shuffle, so a key with a
third of all rows is no hot spot) and committed under its own name: a batch that is delivered again, or that a failed
job had half written, changes nothing, because only the first mark of a name counts.

Cases: null sources, languages and versions are keys of their own; a null text counts no tokens; repeated rows of a
batch count as often as they occur; an empty batch commits nothing but its name; keys whose documents and tokens both
come to zero are left out of the totals; other columns are not read.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
_DDL = "source string, lang string, tokenizer string, docs long, tokens long"

#: Tokenizer versions that built-in functions express: runs of other characters than U+0009-U+000D and U+0020, and bytes.
TOKENIZERS = {
    "words-1": lambda text: F.size(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0))).cast("long"),
    "bytes-1": lambda text: F.octet_length(text).cast("long"),
}


def counted(df: DataFrame, tokenizers: dict | None = None, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """df's source and lang, and the columns named in keep, with a row (tokenizer, tokens) for each tokenizer version.

    The text ends here: what is joined or shuffled later is a count.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts = [F.struct(F.lit(name).alias("tokenizer"), count(text).alias("tokens")) for name, count in (tokenizers or TOKENIZERS).items()]
    names = [*keep, "source", "lang"]
    return df.select(*names, F.explode(F.array(*counts)).alias("c")).select(*names, "c.tokenizer", "c.tokens")


def inserted(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(1), F.col("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(-1), -F.col("tokens"))


def revised(counts: DataFrame, old: str = "old_tokens", new: str = "tokens") -> DataFrame:
    """The document stays; its old count goes and its new one comes."""
    return _signed(counts, F.lit(0), F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)))


def _signed(counts: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return counts.select(*KEYS, docs.cast("long").alias("docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


class Rollup:
    """Totals in a folder that driver and executors share.

    A commit writes its sums to a folder of its own and then creates the batch's mark, a small file that names that
    folder. Creating a file that must not exist yet is one step of the file system, so of two deliveries at once one
    wins and the other's folder is deleted. compact() sums what is committed into a base, so totals read one folder and
    the batches since.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _mark(self, name: str) -> str:
        return f"{self.path}/marks/{urllib.parse.quote(name, safe='')}"

    def _publish(self, name: str, rows: DataFrame, covers: list[str] | None = None) -> bool:
        """Write rows and create the mark; False if another was faster."""
        folder = f"{self.path}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        fs, mark = self._fs(self._mark(name))
        try:
            out = fs.create(mark, False)
        except Py4JJavaError as e:
            if not fs.exists(mark):
                raise e
            if name in self._marks():
                fs.delete(self._fs(folder)[1], True)
                return False
            out = fs.create(mark, True)  # whoever made it has not said what it names, and may be dead
        out.write(bytearray(json.dumps({"folder": folder, "covers": covers}).encode()))
        out.close()
        return True

    def _marks(self) -> dict[str, dict]:
        """What each mark says. One that its writer has not finished is not there yet; a delivery after it writes it anew."""
        fs, p = self._fs(f"{self.path}/marks")
        if not fs.exists(p):
            return {}
        out = {}
        for s in fs.listStatus(p):
            stream = fs.open(s.getPath())
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text:
                out[urllib.parse.unquote(s.getPath().getName())] = json.loads(text)
        return out

    def committed(self, batch: str) -> bool:
        return f"batch {batch}" in self._marks()

    def commit(self, batch: str, *deltas: DataFrame, verify: bool = False) -> bool:
        """Store a batch of signed rows once; False if it was there. With verify, a batch that is there with other sums is an error."""
        there = self.committed(batch)
        if there and not verify:
            return False
        rows = deltas[0]
        for d in deltas[1:]:
            rows = rows.unionByName(d)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        if there:
            old = self.spark.read.schema(_DDL).parquet(self._marks()[f"batch {batch}"]["folder"])
            if not old.exceptAll(sums).isEmpty() or not sums.exceptAll(old).isEmpty():
                raise ValueError(f"batch {batch} is committed with other sums")
            return False
        return self._publish(f"batch {batch}", sums)

    def batches(self) -> list[str]:
        return sorted(n.removeprefix("batch ") for n in self._marks() if n.startswith("batch "))

    def _parts(self) -> tuple[list[str], int, list[str]]:
        """(folders whose sum is the total, number of the last base, batches they stand for)."""
        marks = self._marks()
        last = max((int(n.removeprefix("base ")) for n in marks if n.startswith("base ")), default=0)
        base = marks.get(f"base {last}", {"covers": []})
        since = sorted(n for n in marks if n.startswith("batch ") and n not in set(base["covers"]))
        return [m["folder"] for m in (base, *(marks[n] for n in since)) if "folder" in m], last, [*base["covers"], *since]

    def compact(self) -> bool:
        """Sum all committed batches into a new base. The folders it stands for can be removed once nobody reads them."""
        folders, last, covers = self._parts()
        return bool(folders) and self._publish(f"base {last + 1}", self._sums(folders), covers)

    def _sums(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_DDL).parquet(*folders) if folders else self.spark.createDataFrame([], _DDL)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        return self._sums(self._parts()[0]).filter("docs <> 0 or tokens <> 0")
