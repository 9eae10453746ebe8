"""Cleaning of page text and tables: column expressions, and row-sequence operators as windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.fixed import (
    ARTICLE_LINE,
    CHAPTER_LINE,
    CHECKBOXES,
    CHOICE,
    DATE_PHRASE,
    FILL_IN,
    FINE_RANGE,
    FOOTER_PART,
    FORM_DOTS,
    HEADER_LINE,
    HEADING_LINE,
    MERGE_END_LETTERS,
    PAGE_NUMBER_LINE,
    REFINE_LETTERS,
    REVOCATION,
    UNIT_TOKEN,
    UNIT_TOKEN_DECREE,
    java, java_ascii_words,
)

#: What Python's str.strip takes off, as far as it occurs in text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0　"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


@F.pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC: the one scalar of this module that the JVM has no function for."""
    import unicodedata

    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def split_lines(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, pos (from 0) and line: the trimmed lines that aren't blank."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")


def is_noise(line: Column) -> Column:
    """Print headers, site footers and page numbers."""
    return line.rlike(java(HEADER_LINE)) | line.rlike(java(FOOTER_PART)) | line.rlike(java(PAGE_NUMBER_LINE))


def form_placeholders(line: Column) -> Column:
    """Dotted fill-ins and check boxes as words; null for a line that holds nothing else."""
    out = strip(F.regexp_replace(F.regexp_replace(line, FORM_DOTS, f" {FILL_IN} "), CHECKBOXES, f" {CHOICE} "))
    return F.when(~out.isin("", FILL_IN, CHOICE), out)


def promote_headings(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, java(CHAPTER_LINE), "# $1"), java(ARTICLE_LINE), "## $1")


def bold_dates(line: Column) -> Column:
    return F.regexp_replace(line, java(DATE_PHRASE), "**$1**")


def wrap_units(line: Column, law: bool = True, ascii_words: bool = False) -> Column:
    """Units of a law's line, or of one of a decree or circular, which have one more. They stand between the ends of words,
    by Unicode, or by ASCII as in RE2."""
    token = UNIT_TOKEN if law else UNIT_TOKEN_DECREE
    return F.regexp_replace(line, java_ascii_words(token) if ascii_words else java(token), r"\$\$$1\$\$")


def merge_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Joins lines that were broken in mid-sentence. Whether a line goes on from the one above depends on
    that pair alone (the last letter of what is merged so far is the last letter of the line above), so
    islands of the flag's running sum are the merged lines."""
    by = Window.partitionBy(*keys).orderBy("pos")
    above, first = F.lag("line").over(by), F.substring("line", 1, 1)
    goes_on = above.rlike(f"[{MERGE_END_LETTERS}]$") & (first.rlike(r"^\p{Ll}")) & ~F.col("line").rlike(java(HEADING_LINE))
    flagged = lines.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    islands = flagged.withColumn("line_no", F.sum("__new").over(by))
    return islands.groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("line"))


def clean_pages(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The whole cleaning chain: keys, line_no, line."""
    lines = split_lines(df.withColumn(text, nfc(F.col(text))), text, keys).where(~is_noise(F.col("line")))
    lines = lines.withColumn("line", form_placeholders(F.col("line"))).where("line IS NOT NULL")
    return merge_lines(lines.withColumn("line", wrap_units(bold_dates(promote_headings(F.col("line"))))), keys)


def warned(text: Column, warning: Column) -> Column:
    """A page behind its file's warning, if there is one."""
    return F.when(F.coalesce(warning, F.lit("")) != "", F.concat(F.lit("> "), warning, F.lit("\n\n"), text)).otherwise(text)


def keep_by_keywords(df: DataFrame, text: str, policy: DataFrame, key: str) -> DataFrame:
    """Blocks that their file's policy keeps: all, or those with an included and without an excluded
    keyword; empty lists ask nothing. Files without a policy are kept. policy is a small table of files."""
    t = F.lower(F.col(text))
    has = lambda words: F.exists(words, lambda w: F.contains(t, w))
    empty = lambda words: F.coalesce(F.size(words), F.lit(0)) <= 0
    inside = (empty(F.col("include")) | has(F.col("include"))) & (empty(F.col("exclude")) | ~has(F.col("exclude")))
    joined = df.join(policy, key, "left")
    return joined.where(F.coalesce("keep_all", F.lit(True)) | inside).select(df["*"])


def concat_pages(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], text: str, separator: str = "\n\n") -> DataFrame:
    """Blocks of a document in order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["__t"]), separator).alias(text))


def merge_appended(documents: DataFrame, amendments: DataFrame) -> DataFrame:
    """documents (name, content); amendments (name, target, marker, content, ord). An amendment is appended
    to its target behind its marker; if there is no such document it stands by itself."""
    found = amendments.join(documents.select(F.col("name").alias("target"), F.lit(True).alias("found")), "target", "left")
    parts = documents.select("name", F.lit(0).alias("ord"), F.col("content").alias("part"))
    parts = parts.unionByName(found.where("found").select(F.col("target").alias("name"), (F.col("ord") + 1).alias("ord"), F.concat("marker", "content").alias("part")))
    parts = parts.unionByName(found.where("found IS NULL").select("name", F.lit(0).alias("ord"), F.col("content").alias("part")))
    return concat_pages(parts.withColumnRenamed("part", "content"), ("name",), ("ord",), "content", "")


#: Side of the grid's smallest cells; coordinates beyond REACH stand in the outermost ones.
CELL, REACH = 64.0, float(1 << 40)


def outside_boxes(chars: DataFrame, boxes: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """chars (page, x, y) that stand in no box (page, x0, top, x1, bottom) of their page. Boxes are dealt into the cells of a
    grid as coarse as they are large, so that each is in nine of them at most; a character meets the boxes of its own cell
    only, level by level, of which there are as many as powers of two between the smallest box and the largest. A page is
    as many keys as it has cells."""
    clip = lambda c: F.greatest(F.lit(-REACH), F.least(F.lit(REACH), c))
    side = lambda level: F.lit(CELL) * F.pow(F.lit(2.0), level)
    cell = lambda c, level: F.floor(clip(c) / side(level)).cast("long")
    b = boxes.select("page", *[(F.col(c) + d).alias(n) for n, c, d in (("l", "x0", -tolerance), ("r", "x1", tolerance), ("u", "top", -tolerance), ("d", "bottom", tolerance))])
    b = b.where("l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL")
    span = F.greatest(clip(F.col("r")) - clip(F.col("l")), clip(F.col("d")) - clip(F.col("u")), F.lit(CELL))
    b = b.withColumn("level", F.ceil(F.log2(span / CELL)).cast("int"))
    levels = sorted(r.level for r in b.select("level").distinct().collect())  # at most 36
    tiles = b.withColumn("cx", F.explode(F.sequence(cell(F.col("l"), F.col("level")), cell(F.col("r"), F.col("level"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("u"), F.col("level")), cell(F.col("d"), F.col("level")))))
    out = chars
    for level in levels:
        c, t = out.alias("c"), tiles.where(F.col("level") == level).alias("t")
        same = (F.col("c.page") == F.col("t.page")) & (cell(F.col("c.x"), F.lit(level)) == F.col("t.cx")) & (cell(F.col("c.y"), F.lit(level)) == F.col("t.cy"))
        out = c.join(t, same & F.col("c.x").between(F.col("t.l"), F.col("t.r")) & F.col("c.y").between(F.col("t.u"), F.col("t.d")), "left_anti")
    return out


def text_outside_tables(chars: DataFrame, boxes: DataFrame, tolerance: float = 2.0, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """keys and text: a page's letters (keys, page, n, x, y, c) in their order n, without those that stand in a table's box."""
    return concat_pages(outside_boxes(chars, boxes, tolerance), keys, ("n",), "c", "").withColumnRenamed("c", "text")


def markdown_tables(cells: DataFrame) -> DataFrame:
    """cells (tbl, row, col, cell) -> (tbl, markdown). Blank rows go, ragged rows are padded, blank cells take
    the last value above them in their column, pipes are escaped, a rule follows the first row."""
    cell = F.coalesce(strip(F.regexp_replace("cell", "\n", " ")), F.lit(""))
    df = cells.select("tbl", "row", "col", F.nullif(cell, F.lit("")).alias("cell"))
    live = df.groupBy("tbl", "row").agg(F.count("cell").alias("n")).where("n > 0").select("tbl", "row")
    width = df.join(live, ["tbl", "row"]).groupBy("tbl").agg(F.max("col").alias("last"))
    grid = live.join(width, "tbl").select("tbl", "row", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("col"))
    full = grid.join(df, ["tbl", "row", "col"], "left")
    down = Window.partitionBy("tbl", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("cell", F.replace(F.coalesce(F.last("cell", ignorenulls=True).over(down), F.lit("")), F.lit("|"), F.lit("\\|")))
    rows = concat_pages(full, ("tbl", "row"), ("col",), "cell", " | ").withColumn("line", F.concat(F.lit("| "), "cell", F.lit(" |")))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("tbl").orderBy("row")) == 1).join(width, "tbl")
    rule = F.concat(F.lit("\n|"), F.array_join(F.array_repeat(F.lit("---"), F.col("last").cast("int") + 1), "|"), F.lit("|"))
    rows = rows.withColumn("line", F.when(F.col("first"), F.concat("line", rule)).otherwise(F.col("line")))
    return concat_pages(rows.select("tbl", "row", "line"), ("tbl",), ("row",), "line", "\n").withColumnRenamed("line", "markdown")


#: Set around a table line, its number and its text, while the lines beside it are repaired; they occur in no text.
OPEN, MIDDLE = "\ue001", "\ue002"


def refine(text: Column) -> Column:
    """Repairs page breaks: hyphens at line ends, lines broken in mid-sentence, drawn rules, runs of blank
    lines. Lines of a Markdown table are set in marks, which no rule meets, and come back as they were; only one
    that a hyphen has pulled up to the line above is left as a placeholder."""
    is_table = lambda x: strip(x).startswith("|") | (strip(x).rlike(r"^[-:|]+$") & F.contains(x, F.lit("|")))
    marked = F.transform(F.split(text, "\n"), lambda x, i: F.when(is_table(x), F.concat(F.lit(OPEN), i.cast("string"), F.lit(MIDDLE), x, F.lit(OPEN))).otherwise(x))
    out = F.when(F.contains(text, F.lit("|")), F.array_join(marked, "\n")).otherwise(text)
    out = F.regexp_replace(out, r"(?U)(\s*-\s*)\n\s*", "$1")
    out = F.regexp_replace(out, f"(?<=[{REFINE_LETTERS},;])\n(?=[{REFINE_LETTERS}])", " ")
    out = F.regexp_replace(out, r"(?mdU)^[-=_]{5,}\s*$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, rf"(?md)^[ \t]*{OPEN}\d+{MIDDLE}([^{OPEN}\n]*){OPEN}[ \t]*$", "$1")
    return strip(F.regexp_replace(out, rf"{OPEN}(\d+){MIDDLE}[^{OPEN}\n]*{OPEN}", "__TABLE_LINE_$1__"))


def style_penalties(text: Column) -> Column:
    """Bold fine ranges and licence revocations; nested marks collapse."""
    out = F.regexp_replace(F.regexp_replace(text, java(FINE_RANGE), "**$1**"), java(REVOCATION), "**$1**")
    return F.regexp_replace(out, r"\*{4,}", "**")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    return (word_count(text) * F.lit(1.3)).cast("int")


def redact_dsn(dsn: Column) -> Column:
    """The password of a connection string is hidden."""
    return F.regexp_replace(dsn, r"://([^:]+):[^@]+@", "://$1:***@")


def safe_name(name: Column) -> Column:
    clean = F.regexp_replace(name, r"(?U)[^\w\-]", "_")
    return F.when(F.length(clean) > 150, F.concat(F.substring(clean, 1, 140), F.lit("_"), F.substring(F.md5(clean.cast("binary")), 1, 8))).otherwise(clean)


def visible_text(html: Column) -> Column:
    """A page's text outside scripts, styles and markup, its blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", " "), r"[ \t\n\r]+", " "))
