"""Change-log notes: a header line "* title date time [tag]:[tag]:" and the lines after it."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import content_hash, trim_unicode
from noteloom.sources import files, lines

# The first time in the line ends the title.
_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
#: How an entry begins.
START = rf"^\* [^\n]+? {_TIME}"
HEADER = rf"^\* ([^\n]+?) ({_TIME})\s*([^\n]*)$"


_FRAGMENT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("last", pa.bool_()), ("entry", pa.string())])


def loader_tags(rest: Column) -> Column:
    """Tags after the time; each needs its colon."""
    return F.regexp_extract_all(rest, F.lit(r"\[([^\]]+)\]:"), F.lit(1))


def parse(texts: DataFrame, trim_title: bool = False) -> DataFrame:
    """Documents of files (file, value: the whole text), in order within a file; other columns stay with them.

    A file is cut before its headers, so a file is one row of work and nothing
    is shuffled. Lines before the first header are dropped, and so are entries
    whose time does not exist. ``trim_title`` is the converter's variant.
    """
    text = F.regexp_replace("value", "\r\n", "\n")
    parts = F.filter(F.split(text, r"(?m)(?=^\* [^\n]+? " + _TIME + r"\s*[^\n]*$)"), lambda p: p.rlike(START))
    own = [c for c in texts.columns if c != "value"]
    return _documents(texts.select(*own, F.posexplode(parts).alias("position", "entry")), own, trim_title)


def _documents(rows: DataFrame, own: list[str], trim_title: bool = False) -> DataFrame:
    """Documents of entries (entry: header and body, position), with columns of their own; those whose time does not exist go."""
    header, body = F.get(F.split("entry", "\n", 2), F.lit(0)), F.coalesce(F.get(F.split("entry", "\n", 2), F.lit(1)), F.lit(""))
    rows = rows.select(*own, "position", header.alias("header"), trim_unicode(body).alias("text"))
    title = F.regexp_extract("header", HEADER, 1)
    rows = rows.select(
        *own, "position", (trim_unicode(title) if trim_title else title).alias("title"), F.try_to_timestamp(F.regexp_extract("header", HEADER, 2), F.lit("yyyy-MM-dd HH:mm:ss")).alias("date"),
        loader_tags(F.regexp_extract("header", HEADER, 3)).alias("tags"), "text",
    ).where(F.col("date").isNotNull())
    return rows.withColumn("id", content_hash("title", F.col("text")))


def fragments(rows: DataFrame) -> DataFrame:
    """(file, block, nth, last, entry) of lines (file, block, value) that come in order: the lines from one header to the next within a block, the nth of it.

    What stands before the first header of a block (nth 0) belongs to an entry that began in an earlier one, and the last piece may go on in a later one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # file, block, nth and lines of the piece that is not over

        def row(last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [held[0]], "block": [held[1]], "nth": [held[2]], "last": [last], "entry": ["\n".join(held[3])]}, schema=_FRAGMENT)

        for batch in batches:
            heads = pa.compute.match_substring_regex(batch.column(2), START).to_pylist()
            for file, block, value, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), heads):
                value = value.removesuffix("\r")
                if not held or (file, block) != (held[0], held[1]):
                    if held:
                        yield row(True)
                    held = [file, block, int(head), [value]]
                elif head:
                    yield row(False)
                    held = [file, block, held[2] + 1, [value]]
                else:
                    held[3].append(value)
        if held:
            yield row(True)

    return rows.select("file", "block", "value").mapInArrow(run, "file string, block long, nth long, last boolean, entry string")


def entries(rows: DataFrame) -> DataFrame:
    """(file, position, entry) of lines, whatever the blocks: pieces are joined only where a block cuts an entry, all others stay in the task that read them."""
    blocks = lines.before(rows.groupBy("file", "block").agg(F.count_if(F.col("value").rlike(START)).alias("heads")), "heads")
    pieces = fragments(rows).join(blocks.select("file", "block", "before"), ["file", "block"]).withColumn("position", F.col("before") + F.col("nth") - 1).where("position >= 0")
    cut = (F.col("nth") == 0) | F.col("last")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "entry"))), lambda x: x["entry"])
    joined = pieces.where(cut).groupBy("file", "position").agg(F.array_join(ordered, "\n").alias("entry"))
    return pieces.where(~cut).select("file", "position", "entry").unionByName(joined)


def render(docs: DataFrame) -> DataFrame:
    """(id, doc_ord, value): each document as change-log text, of which ``parse`` makes it again."""
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("["), t, F.lit("]:"))), "")
    return docs.select("id", "doc_ord", F.concat(F.lit("* "), "title", F.lit(" "), F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), tags, F.lit("\n"), "text", F.lit("\n")).alias("value"))


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents of change-log files, with the number of their file in the order given (``input``). Files of any length are read in splits."""
    if not paths:
        return parse(spark.createDataFrame([], "file string, value string, input long"))
    found = files.listed(spark, paths)
    # As many rows as the driver was given files; Spark sends them if they are few.
    names = spark.createDataFrame([(address, k) for k, (_, address) in enumerate(found)], "file string, input long")
    rows = entries(lines.read(spark, [path for path, _ in found])).join(names, "file")
    return _documents(rows, ["file", "input"])


def numbered(entries: DataFrame) -> DataFrame:
    """Parsed entries as documents: their order is that of the files, and within a file that of the entries."""
    return entries.select("id", "title", "date", "tags", "text", (F.shiftleft("input", 32) + F.col("position")).alias("doc_ord"))


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    return numbered(load(spark, paths))


def to_jsonl(docs: DataFrame) -> DataFrame:
    """One JSON line per document."""
    meta = F.struct("title", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "tags")
    return docs.select(F.to_json(F.struct("id", meta.alias("metadata"), "text")).alias("value"))
