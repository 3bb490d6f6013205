"""Many CSV files -> long-form ``sheet_rows``, whatever their width.

Files are read as lines by the splittable text reader, so one large file, with
multi-line cells or not, is read by many tasks, and a row is an
``array<string>`` of its own length: no schema depends on the widest line.

Whether a line begins a record depends on all quotes before it.  That is
resolved in three steps:

1. every split runs both possible start states (outside and inside a quoted
   cell) at once over its lines: the state it ends in and the records it
   begins, for either start (one light row a split);
2. a prefix pass over a file's splits fixes each split's true start state and
   the number of its first record.  A split maps two states to two states: it
   sets one, keeps or swaps them, so the last setting split and the number of
   swaps since decide;
3. every split parses its records.  A record that crosses splits leaves one
   piece in each; the pieces meet by (file, record) and are parsed there.

The splits of step 3 are matched to those of step 1 by start and length; if
the reader cut the files anew in between, the job fails instead of misreading.

Rules: fields are separated by commas; a field that begins with a quote goes on
to its closing quote (doubled quotes are one), over line ends too; blank lines
are no records; a carriage return outside quotes ends a record as well.  The
first record of each file becomes its ``columns``: as many as it has fields
(blank ones at the end count), more if a row is longer; blank names are
``Unnamed: <i>``, a name that was there before gets ``.1``, ``.2`` and so on.
Empty fields and the usual markers of a missing value are null; all other
cells stay strings.  A file with a record that can't be decoded or parsed, or
whose last quote stays open, is reported beside the data and gives no rows.
"""

from __future__ import annotations

import csv
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import join_few
from ..session import bounded_count, cut_lineage, written

CSV_SHEET = "CSV"            # fixed value: sheet label of a CSV file
UNNAMED = "Unnamed: "        # fixed value: name of a blank header cell
# fixed values: texts that a table reader takes as a missing cell
MISSING_MARKERS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                   "NULL", "NaN", "None", "n/a", "nan", "null")

#: the table of splits (one light row each) is broadcast up to this many rows
MAX_SPLITS = 1_000_000
OUTSIDE, INSIDE = 0, 1
BATCH_BYTES = 4 << 20

#: whole fields, then one whose quote stays open to the end of the line
_OPEN = re.compile(rb'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+\Z')
_QUOTED = re.compile(rb'(?:[^"]++|"")*+')
_BLANK = b" \t\r"


# ------------------------------------------------------------------- states

def next_state(state: int, line: bytes) -> int:
    """State after a line that is entered in ``state``."""
    if b'"' not in line:
        return state
    at = 0
    if state == INSIDE:
        at = _QUOTED.match(line).end()
        if at == len(line):
            return INSIDE
        at = line.find(b",", at)
        if at < 0:
            return OUTSIDE
        at += 1
    return INSIDE if _OPEN.match(line, at) else OUTSIDE


def _records(line: bytes) -> list[bytes]:
    """The records that a line without quotes, outside of any, holds."""
    if b"\r" in line.rstrip(b"\r"):
        return [x for x in line.split(b"\r") if x.strip(_BLANK)]
    return [line] if line.strip(_BLANK) else []


def _begun(state: int, line: bytes) -> int:
    """Number of records that begin in a line entered in ``state``."""
    if state == INSIDE:
        return 0
    return (1 if line.strip(_BLANK) else 0) if b'"' in line else len(_records(line))


def _runs(batch: pa.RecordBatch):
    """``(file, block, size, first row, end)`` of stretches of one split."""
    file, block, size = (batch.column(i).to_pylist() for i in range(3))
    lo = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or block[i] != block[lo] or file[i] != file[lo] or size[i] != size[lo]:
            yield file[lo], block[lo], size[lo], lo, i
            lo = i


STATES = "file string, block long, size long, end_out int, end_in int, n_out long, n_in long"


def _split_states(batches):
    """Both start states at once over the lines of every split."""
    key, ends, counts = None, [], []
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("end_out", pa.int32()),
                        ("end_in", pa.int32()), ("n_out", pa.int64()), ("n_in", pa.int64())])

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, *ends, *counts], schema)], schema=schema)

    for batch in batches:
        lines = batch.column(3).to_pylist()
        for file, block, size, lo, hi in _runs(batch):
            if key != (file, block, size):
                if key is not None:
                    yield row()
                key, ends, counts = (file, block, size), [OUTSIDE, INSIDE], [0, 0]
            for line in lines[lo:hi]:
                for s in (OUTSIDE, INSIDE):
                    counts[s] += _begun(ends[s], line)
                    ends[s] = next_state(ends[s], line)
    if key is not None:
        yield row()


def resolved(states: DataFrame) -> DataFrame:
    """``start, first`` of every split: its true start state and the number of
    the first record that begins in it."""
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("end_out") == INSIDE) & (F.col("end_in") == OUTSIDE)).cast("int")
    x = states.withColumn("swaps", F.sum(swap).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sets = F.when(F.col("end_out") == F.col("end_in"), F.struct("end_out", "swaps"))
    last = F.last(sets, ignorenulls=True).over(before)
    x = x.withColumn("__set", last).withColumn("__swaps", F.coalesce(F.lag("swaps").over(upto), F.lit(0)))
    start = F.coalesce(F.col("__set.end_out"), F.lit(OUTSIDE)).bitwiseXOR(
        F.pmod(F.col("__swaps") - F.coalesce(F.col("__set.swaps"), F.lit(0)), F.lit(2)).cast("int"))
    x = x.withColumn("start", start).withColumn("n", F.when(F.col("start") == OUTSIDE, F.col("n_out")).otherwise(F.col("n_in")))
    return x.select("file", "block", "size", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


# ------------------------------------------------------------------ records

def parse(lines: list[bytes]) -> tuple[list[str] | None, str | None]:
    """Cells of one record given as its lines, or what is wrong with it."""
    try:
        if len(lines) == 1 and b'"' not in lines[0]:
            return lines[0].rstrip(b"\r").decode("utf-8").split(","), None
        csv.field_size_limit(sys.maxsize)
        return next(csv.reader([x.decode("utf-8") + "\n" for x in lines[:-1]] + [lines[-1].rstrip(b"\r").decode("utf-8")])), None
    except (UnicodeDecodeError, csv.Error) as e:
        return None, f"{type(e).__name__}: {e}"


PARSED = "file string, record long, cells array<string>, error string, block long, piece binary"
_PARSED = pa.schema([("file", pa.string()), ("record", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string()),
                     ("block", pa.int64()), ("piece", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARSED)], schema=_PARSED)


def _split_records(batches):
    """Records of every split from its known start state; pieces of records
    that began before the split or don't end in it."""
    key, state, number, lines, own = None, OUTSIDE, 0, [], True
    rows: list[tuple] = []
    held = 0

    def close(complete: bool):
        nonlocal lines, held
        if complete and own:
            rows.append((key[0], number, *parse(lines), None, None))
        else:
            rows.append((key[0], number, None, None, key[1], b"\n".join(lines)))
        held += sum(map(len, lines))
        lines = []

    for batch in batches:
        line_col, start_col, first_col = (batch.column(i).to_pylist() for i in (3, 4, 5))
        for file, block, size, lo, hi in _runs(batch):
            if key != (file, block, size):
                if key is not None and state == INSIDE:
                    close(False)
                key, state, lines = (file, block, size), start_col[lo], []
                own = state == OUTSIDE
                number = first_col[lo] - 1             # of the record that is open or was last
                if block == 0 and line_col[lo].startswith(b"\xef\xbb\xbf"):
                    line_col[lo] = line_col[lo][3:]
            for line in line_col[lo:hi]:
                if state == OUTSIDE:
                    if b'"' not in line:
                        for one in _records(line):
                            number += 1
                            rows.append((file, number, *parse([one]), None, None))
                            held += len(one)
                        continue
                    number += 1
                    own = True
                lines.append(line)
                state = next_state(state, line)
                if state == OUTSIDE:
                    close(True)
                    own = True
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    if key is not None and state == INSIDE:
        close(False)
    if rows:
        yield _batch(rows)


def _joined_pieces(batches):
    for batch in batches:
        rows = []
        for file, number, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            lines, state = piece.split(b"\n"), OUTSIDE
            for line in lines:
                state = next_state(state, line)
            got = (None, "a quoted cell is still open at the end of the file") if state == INSIDE else parse(lines)
            rows.append((file, number, *got, None, None))
        if rows:
            yield _batch(rows)


def _read_lines(spark: SparkSession, paths, glob: str | None) -> DataFrame:
    r = spark.read.option("lineSep", "\n")
    if glob:
        r = r.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return r.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                F.col("_metadata.file_block_length").alias("size"), F.col("value").cast("binary").alias("line"))


def read_records(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """``file, record, cells, error`` of every record of the files, numbered
    from 0 in each file (written once)."""
    lines = _read_lines(spark, paths, glob)
    states = cut_lineage(resolved(lines.mapInArrow(_split_states, STATES)))
    x = lines.withColumn("id", F.monotonically_increasing_id())
    few = bounded_count(states, MAX_SPLITS) <= MAX_SPLITS
    x = x.join(F.broadcast(states) if few else states, ["file", "block", "size"], "left")
    if not few:
        x = x.sortWithinPartitions("file", "block", "id")
    start = F.coalesce("start", F.raise_error(F.lit("the files were split anew while they were read")).cast("int"))
    x = x.select("file", "block", "size", "line", start.alias("start"), "first")
    got = written(x.mapInArrow(_split_records, PARSED), "csv-records")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"])
    cut = got.filter("piece IS NOT NULL").groupBy("file", "record").agg(pieces.alias("p"))
    whole = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0], lambda a, b: F.concat(a, F.lit(b"\n"), b))
    cut = cut.select("file", "record", whole.alias("piece")).mapInArrow(_joined_pieces, PARSED)
    keep = ["file", "record", "cells", "error"]
    return got.filter("piece IS NULL").select(*keep).unionByName(cut.select(*keep))


# ------------------------------------------------------------------- sheets

def column_names(head: list[str | None], width: int) -> list[str]:
    """Header cells as column names: blanks numbered, repeats suffixed."""
    out, seen = [], {}
    for i in range(width):
        name = (head[i] if i < len(head) else None) or f"{UNNAMED}{i}"
        n = seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _headers(batches):
    for b in batches:
        names = [column_names(h or [], w) for h, w in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.list_(pa.string()))], names=["file", "width", "columns"])


def scan_csv(spark: SparkSession, paths, sheet_label: str = CSV_SHEET, missing: tuple[str, ...] = MISSING_MARKERS,
             glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(sheet_rows, errors)``: rows of the files that can be read, and
    ``path, error`` (the first wrong record) of the others.  ``paths`` is a
    folder, pattern or list; with ``glob``, all matching files below it."""
    recs = read_records(spark, paths if isinstance(paths, (str, list)) else list(paths), glob)
    known = lambda c: F.when((c != "") & ~c.isin(*missing) if missing else c != "", c)
    per_file = recs.groupBy("file").agg(
        F.max(F.size("cells")).alias("width"), F.min_by("cells", F.when(F.col("record") == 0, 0)).alias("head"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("record", "error"))).alias("wrong"))
    per_file = cut_lineage(per_file)
    errors = per_file.filter("wrong IS NOT NULL").select(F.col("file").alias("path"), F.concat(
        F.lit("record "), F.col("wrong.record").cast("string"), F.lit(": "), F.col("wrong.error")).alias("error"))
    pad = lambda c, n: F.concat(c, F.array_repeat(F.lit(None).cast("string"), (n - F.size(c)).cast("int")))
    header = (per_file.filter("wrong IS NULL").select("file", F.col("width").cast("long"), "head")
              .mapInArrow(_headers, "file string, width long, columns array<string>"))
    x = join_few(recs.filter("record > 0"), header, ["file"], values=F.col("width"))
    cells = pad(F.transform("cells", known), F.col("width"))
    rows = x.select(F.col("file").alias("source"), F.lit(sheet_label).alias("sheet"), F.lit(0).cast("bigint").alias("sheet_pos"),
                    (F.col("record") - 1).cast("bigint").alias("row_idx"), "columns", cells.alias("cells"))
    return rows, errors


def read_csv_sheets(spark: SparkSession, paths, sheet_label: str = CSV_SHEET,
                    missing: tuple[str, ...] = MISSING_MARKERS) -> DataFrame:
    """``sheet_rows`` for CSV files (``paths``: a folder, glob or list)."""
    return scan_csv(spark, paths, sheet_label, missing)[0]
