"""K2: recursive text split of each sheet's CSV text, over its lines.

The rule (the public recursive character splitter with a length function and
kept separators) on the sheet text (P8: header line + rows):

* separators in order: blank line, newline, space, empty string; use the
  first one found in the text; the separator stays at the front of the
  following piece; empty pieces are dropped;
* pieces shorter than the budget are collected; a longer piece first
  flushes the collected ones (merged), then is split again with the
  remaining separators (or kept whole when none is left);
* merge: add pieces while ``total + len <= budget``; on overflow emit the
  joined (stripped, non-empty) text, then drop pieces from the front while
  ``total > overlap`` or the next piece still does not fit;
* lengths are summed per piece (``len // 5`` tokens by default).

No sheet is ever put together as one string.  The text is a table of lines,
each with the newline before it; pieces of the first two separators are ranges
of lines, so their lengths follow from the lines' lengths.  One light row a
line (its place, length, whether it is blank) goes through a sorted stream that
holds the lines of one open chunk and says which lines make which chunk; texts
are joined to that at the end.  Only a line that is as long as the budget is
itself split, by spaces, in a per-row helper.

A length function other than the default is not a sum over lines; then the
text of a sheet is split whole, one sheet a row (``split_text``).

Afterwards ``chunk_id = lower(base) - n`` runs over all sheets of a file and
``num_rows`` is the number of text lines.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.tokens import CHARS_PER_TOKEN
from ..session import cut_lineage, spread
from .ids import chunk_layout, with_chunk_ids
from .scan import ordered_text

# Fixed values of the recursive splitter.
DEFAULT_BUDGET = 8000
DEFAULT_OVERLAP = 100
SEPARATORS = ["\n\n", "\n", " ", ""]
TYPE_RECURSIVE = "Token Count"
ID_SEP = "-"


def fallback_len(s: str) -> int:
    return len(s) // CHARS_PER_TOKEN


def _split_keep(text: str, sep: str) -> list[str]:
    if not sep:
        return [c for c in text if c != ""]
    parts = re.split(f"({re.escape(sep)})", text)
    out = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts) - 1, 2)]
    if len(parts) % 2 == 0:
        out.append(parts[-1])
    return [p for p in out if p != ""]


def _merge(pieces: list[str], budget: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    docs, cur, total = [], [], 0
    for d in pieces:
        n = length(d)
        if total + n > budget:
            if cur:
                joined = "".join(cur).strip()
                if joined:
                    docs.append(joined)
                while total > overlap or (total + n > budget and total > 0):
                    total -= length(cur[0])
                    cur = cur[1:]
        cur.append(d)
        total += n
    joined = "".join(cur).strip()
    if joined:
        docs.append(joined)
    return docs


def split_text(text: str, budget: int = DEFAULT_BUDGET, overlap: int = DEFAULT_OVERLAP,
               length: Callable[[str], int] = fallback_len, separators: list[str] | None = None) -> list[str]:
    seps = SEPARATORS if separators is None else separators
    sep, rest = seps[-1], []
    for i, s in enumerate(seps):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, seps[i + 1:]
            break
    out, good = [], []
    for piece in _split_keep(text, sep):
        if length(piece) < budget:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, budget, overlap, length))
            good = []
        if not rest:
            out.append(piece)
        else:
            out.extend(split_text(piece, budget, overlap, length, rest))
    if good:
        out.extend(_merge(good, budget, overlap, length))
    return out


SPLIT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("sheet_pos", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("content", T.StringType()),
])
PLACE = ["source", "sheet", "row", "sub"]


# ------------------------------------------------------------------- over lines

def text_lines(rows: DataFrame) -> DataFrame:
    """``source, sheet, sheet_pos, row, sub, piece, empty``: the lines of every
    sheet's CSV text in order of (row, sub), each with the newline before it;
    row 0 is the header, the last one what follows the text's last newline.
    ``empty``: the newline before the line and that after it are neighbours."""
    sheet = rows.groupBy("source", "sheet").agg(F.max("sheet_pos").alias("sheet_pos"), F.max("columns").alias("__cols"),
                                                (F.max("row_idx") + 2).alias("__last"))
    place = ["source", "sheet", "sheet_pos"]
    no, yes = F.lit(False), F.lit(True)
    body = rows.select(*place, (F.col("row_idx") + 1).alias("row"), tx.csv_line("cells").alias("__l"), no.alias("__end"))
    head = sheet.select(*place, F.lit(0).cast("bigint").alias("row"), tx.csv_line("__cols").alias("__l"), no.alias("__end"))
    tail = sheet.select(*place, F.col("__last").alias("row"), F.lit("").alias("__l"), yes.alias("__end"))
    x = body.unionByName(head).unionByName(tail).where(F.col("__l").isNotNull())
    x = x.select(*place, "row", "__end", F.posexplode(F.split("__l", "\n", -1)).alias("sub", "__t"))
    first = (F.col("row") == 0) & (F.col("sub") == 0)
    return x.select(*place, "row", "sub", F.when(first, F.col("__t")).otherwise(F.concat(F.lit("\n"), "__t")).alias("piece"),
                    ((F.col("__t") == "") & ~first & ~F.col("__end")).alias("empty"))


ANNOUNCED = -1               # row of a line that only says that its sheet has blank lines
MEMBERS = "source string, sheet string, sheet_pos long, part long, row long, sub int, n_own int"


class _Merge:
    """The pieces of one run, merged into chunks as they come."""

    def __init__(self, budget: int, overlap: int, emit):
        self.budget, self.overlap, self.emit = budget, overlap, emit
        self.cur, self.total = deque(), 0

    def add(self, tokens: int, lines: list, text: bool):
        if self.total + tokens > self.budget:
            if self.cur:
                self.emit(self.cur)
            while self.total > self.overlap or (self.total + tokens > self.budget and self.total > 0):
                self.total -= self.cur.popleft()[0]
        self.cur.append((tokens, lines, text))
        self.total += tokens

    def flush(self):
        if self.cur:
            self.emit(self.cur)
        self.cur, self.total = deque(), 0


class _Sheet:
    """The lines of one sheet, in order, to the members of its chunks."""

    def __init__(self, key: tuple, blocks: bool, budget: int, overlap: int, out: list):
        self.key, self.budget, self.out, self.part = key, budget, out, 0
        self.blocks, self.lines = _Merge(budget, overlap, self._emit), _Merge(budget, overlap, self._emit)
        self.split = blocks              # the text has blank lines: they come first
        self.long = not blocks           # the open block is split into lines
        self.block, self.chars, self.newlines = [], 0, 0

    def _emit(self, pieces):
        if any(text for _n, _l, text in pieces):
            self.out.extend((*self.key, self.part, row, sub, 0) for _n, lines, _t in pieces for row, sub in lines)
            self.part += 1

    def add(self, row: int, sub: int, chars: int, text: bool, empty: bool, n_own: int):
        # a blank line separates where its newline begins a pair of newlines
        if self.split and empty and self.newlines % 2 == 0:
            self._close()
        self.newlines = self.newlines + 1 if empty else 0
        self.chars += chars
        if not self.long:
            self.block.append((row, sub, chars, text, n_own))
            if self.chars // CHARS_PER_TOKEN < self.budget:
                return
            self.blocks.flush()
            self.long = True
            for line in self.block:
                self._line(*line)
            self.block = []
        else:
            self._line(row, sub, chars, text, n_own)

    def _line(self, row, sub, chars, text, n_own):
        if chars // CHARS_PER_TOKEN < self.budget:
            self.lines.add(chars // CHARS_PER_TOKEN, [(row, sub)], text)
            return
        self.lines.flush()
        if n_own:
            self.out.append((*self.key, self.part, row, sub, n_own))
            self.part += n_own

    def _close(self):
        if self.long:
            self.lines.flush()
        elif self.block:
            self.blocks.add(self.chars // CHARS_PER_TOKEN, [x[:2] for x in self.block], any(x[3] for x in self.block))
        self.block, self.chars, self.long = [], 0, False

    def end(self):
        self._close()
        self.blocks.flush()


def _members(budget: int, overlap: int):
    cols = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches):
        sheet, out = None, []
        for pdf in batches:
            for src, sh, pos, row, sub, chars, text, empty, n_own in pdf.itertuples(index=False, name=None):
                if sheet is None or sheet.key[0] != src or sheet.key[1] != sh:
                    if sheet is not None:
                        sheet.end()
                    sheet = _Sheet((src, sh, None if pd.isna(pos) else int(pos)), row == ANNOUNCED, budget, overlap, out)
                if row == ANNOUNCED:
                    continue
                sheet.add(row, sub, chars, text, empty, n_own)
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=cols)
                    out.clear()
        if sheet is not None:
            sheet.end()
        if out:
            yield pd.DataFrame(out, columns=cols)

    return run


def _split_over_lines(rows: DataFrame, budget: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of every sheet, ``source, sheet, sheet_pos, part, own`` (the
    text, if it is part of one line), and the texts of those made of lines,
    ``source, sheet, part, joined``."""
    lines = text_lines(rows)
    tokens = F.floor(F.length("piece") / CHARS_PER_TOKEN)

    @F.pandas_udf("array<string>")
    def own(piece: pd.Series) -> pd.Series:
        return piece.map(lambda p: split_text(p, budget, overlap, fallback_len, SEPARATORS[2:]))

    # lines that are split themselves: their chunks are made once
    longs = cut_lineage(lines.where(tokens >= budget).withColumn("texts", own("piece")).drop("piece"))
    light = ["source", "sheet", "sheet_pos", "row", "sub"]
    n = F.length("piece").cast("bigint")
    short = lines.where(tokens < budget).select(*light, n.alias("chars"), (~tx.is_blank("piece")).alias("text"), "empty", F.lit(0).alias("n_own"))
    # the length of such a line only matters as not shorter than the budget
    over = F.lit(budget * CHARS_PER_TOKEN).cast("bigint")
    own_rows = longs.select(*light, over.alias("chars"), F.lit(True).alias("text"), "empty", F.size("texts").alias("n_own"))
    x = short.unionByName(own_rows)
    # a blank line is announced ahead of its sheet's lines
    twice = F.explode(F.when(F.col("empty"), F.array("row", F.lit(ANNOUNCED).cast("bigint"))).otherwise(F.array("row")))
    members = (x.withColumn("row", twice).repartition("source", "sheet")
               .sortWithinPartitions("source", "sheet", "row", "sub")
               .select(*light, "chars", "text", "empty", "n_own")
               .mapInPandas(_members(budget, overlap), MEMBERS))
    members = cut_lineage(members)
    keys = ["source", "sheet", "part"]
    of_lines = members.where("n_own = 0")
    joined = (of_lines.join(lines.select(*PLACE, "piece"), PLACE)
              .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "sub", "piece"))).alias("p"))
              .select(*keys, tx.py_strip(F.array_join(F.col("p.piece"), "")).alias("joined")))
    merged = of_lines.where("source IS NOT NULL AND sheet IS NOT NULL").groupBy(*keys).agg(F.max("sheet_pos").alias("sheet_pos"))
    single = (members.where("n_own > 0").join(longs.select(*PLACE, "texts"), PLACE)
              .select("source", "sheet", "sheet_pos", "part", F.posexplode("texts").alias("k", "own")))
    single = single.select("source", "sheet", "sheet_pos", (F.col("part") + F.col("k")).alias("part"), "own")
    return merged.withColumn("own", F.lit(None).cast("string")).unionByName(single), joined


# --------------------------------------------------------- other length functions

def _splitter(budget: int, overlap: int, length):
    def run(batches):
        for pdf in batches:
            out = []
            for src, sh, pos, txt in zip(pdf["source"], pdf["sheet"], pdf["sheet_pos"], pdf["text"]):
                p = None if pd.isna(pos) else int(pos)
                for i, c in enumerate(split_text(txt or "", budget, overlap, length)):
                    out.append((src, sh, p, i, c))
            yield pd.DataFrame(out, columns=["source", "sheet", "sheet_pos", "part", "content"])
    return run


def sheet_csv_text(rows: DataFrame) -> DataFrame:
    """P8 per sheet: header line, then one line per row, each ending in a
    newline (as a data frame written to CSV without its index)."""
    lines = rows.withColumn("__line", tx.csv_line("cells"))
    body = ordered_text(lines, ["source", "sheet"], "row_idx", "__line", "\n", "__body",
                        extra_aggs=[(F.max("columns"), "max", "__cols"), (F.max("sheet_pos"), "max", "sheet_pos")])
    head = tx.csv_line("__cols")
    return body.select("source", "sheet", "sheet_pos",
                       F.concat(head, F.lit("\n"), F.col("__body"), F.lit("\n")).alias("text"))


def chunk_recursive(rows: DataFrame, budget: int = DEFAULT_BUDGET, overlap: int = DEFAULT_OVERLAP,
                    length: Callable[[str], int] = fallback_len) -> DataFrame:
    """K2 chunks in the ``chunks`` layout."""
    if length is fallback_len:
        light, joined = _split_over_lines(rows, budget, overlap)
        # ids come from the bounds alone; the text is attached afterwards, lazily
        parts = with_chunk_ids(light, ID_SEP, lower=True).join(joined, ["source", "sheet", "part"], "left")
        parts = parts.withColumn("content", F.coalesce("own", "joined")).drop("own", "joined")
    else:
        parts = with_chunk_ids(spread(sheet_csv_text(rows)).mapInPandas(_splitter(budget, overlap, length), SPLIT_SCHEMA), ID_SEP, lower=True)
    out = (parts.withColumn("chunk_type", F.lit(TYPE_RECURSIVE))
                .withColumn("start_row", F.lit(None).cast("bigint"))
                .withColumn("end_row", F.lit(None).cast("bigint"))
                .withColumn("total_rows", F.lit(None).cast("bigint"))
                .withColumn("num_rows", tx.line_count("content"))
                .withColumn("token_count", F.lit(None).cast("bigint"))
                .withColumn("total_parts", F.lit(None).cast("bigint"))
                .withColumn("section_label", F.lit(None).cast("string")))
    return chunk_layout(out)
