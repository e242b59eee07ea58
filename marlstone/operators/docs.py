"""Documents: pages to sections, sections to overlapping chunks, links in pages."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text

MIN_CHARS, MAX_CHARS, OVERLAP = 300, 2400, 250
FOCUS = ("mdna", "strategy", "risk", "governance", "sustainability", "business_overview")
FIRST_HEADING = "Gioi thieu"
#: Phrases of financial statements' disclosures, which are no report text.
DISCLOSURES = ("thuyet minh bao cao tai chinh", "bao cao tai chinh hop nhat", "bang can doi ke toan", "bao cao luu chuyen tien te", "bao cao kiem toan doc lap")


def sections(pages: DataFrame, file_col: str = "file", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(file, section, heading, text, page_start, page_end): a heading line starts a section, which may run over pages.

    Lines before the first heading are section 0, under a heading of its own.  A section that a heading ends has that
    heading's page as its last, a file's last section the file's last page.
    """
    split = pages.select(F.col(file_col).alias("file"), F.col(page_col).alias("page"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw"))
    lines = split.withColumn("line", text.strip("raw")).where("line <> ''").withColumn("heading", text.is_heading("line"))
    order = Window.partitionBy("file").orderBy("page", "line_no")
    marked = lines.withColumn("section", F.count_if("heading").over(order))
    ended = marked.groupBy("file", "section").agg(
        F.coalesce(F.max(F.when(F.col("heading"), F.col("line"))), F.lit(FIRST_HEADING)).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.min("page").alias("page_start"),
    )
    last = pages.groupBy(F.col(file_col).alias("file")).agg(F.max(page_col).alias("last_page"))
    after = F.lead("page_start").over(Window.partitionBy("file").orderBy("section"))
    ended = ended.withColumn("page_start", F.when(F.col("section") == 0, 1).otherwise(F.col("page_start")))
    return ended.join(last, "file").withColumn("page_end", F.coalesce(after, "last_page")).drop("last_page")


def _windows(part: Column, most: int, overlap: int) -> Column:
    """A long paragraph's windows, each ``overlap`` into the one before; the last is the first that reaches the end."""
    step = most - overlap
    last = F.ceil((F.length(part) - most) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: text.strip(F.substring(part, k * step + 1, F.lit(most))))


def _packed(body: Column, most: int, overlap: int) -> Column:
    """Paragraphs joined as long as they fit, in order; one fold over the paragraphs of one text."""
    state = lambda open_, done: F.struct(open_.alias("open"), done.alias("done"))
    closed = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))

    def take(s: Column, part: Column) -> Column:
        fits = (s["open"] != "") & (F.length(s["open"]) + 2 + F.length(part) <= most)
        return F.when(fits, state(F.concat(s["open"], F.lit("\n\n"), part), s["done"])).when(F.length(part) <= most, state(part, closed(s))).otherwise(state(F.lit(""), F.concat(closed(s), _windows(part, most, overlap))))

    parts = F.filter(F.transform(F.split(body, "\n{2,}"), text.strip), lambda p: p != "")
    return F.aggregate(parts, state(F.lit(""), F.array().cast("array<string>")), take, closed)


def _lead_in(before: Column, piece: Column, most: int, overlap: int) -> Column:
    """The piece after the end of the one before it: from the last sentence border in its tail, else the first white space, else all of it, cut at the left to fit."""
    tail = F.right(before, F.lit(overlap))
    after = lambda pattern: F.nullif(text.strip(F.regexp_extract(tail, f"(?Us)^{pattern}\\s+(.*)$", 1)), F.lit(""))
    prefix = F.coalesce(after(".*[.!?;:]"), after("\\S*?"), text.strip(tail))
    room = most - F.length(piece) - 1
    fitted = lambda p: F.when(F.length(p) <= room, p).when(room > 0, F.regexp_replace(F.right(p, room), "(?U)^\\s+", "")).otherwise("")
    return text.let(prefix, lambda p: F.concat_ws("\n", F.nullif(fitted(p), F.lit("")), piece))


def split_chunks(rows: DataFrame, text_col: str = "text", least: int = MIN_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """A row a piece, with piece_index: paragraphs packed up to ``most`` characters, longer ones cut with overlap; pieces below ``least`` go, then each gets the end of the one before.

    A null or blank text has no pieces.
    """
    if overlap >= most:
        raise ValueError("overlap must be below the largest length")
    others = [F.col(f"`{c}`") for c in rows.columns if c != text_col]
    pieces = F.filter(_packed(F.coalesce(text_col, F.lit("")), most, overlap), lambda p: F.length(p) >= least)
    found = rows.select(*others, pieces.alias("__pieces"))
    if overlap > 0:
        pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "__pieces").alias("before"), F.col("__pieces").alias("piece"))
        led = F.transform(F.filter(pairs, lambda x: x["piece"].isNotNull()), lambda x: F.when(x["before"].isNull(), x["piece"]).otherwise(_lead_in(x["before"], x["piece"], most, overlap)))
        found = found.withColumn("__pieces", led)
    # An inner posexplode would add a filter on the pieces' number, which works the pieces out once more.
    return found.select(*others, F.posexplode_outer("__pieces").alias("piece_index", text_col)).where(F.col(text_col).isNotNull())


def chunks(section_rows: DataFrame, stock: Column, year: Column, least: int = MIN_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP, focus: bool = True) -> DataFrame:
    """Numbered chunks of report sections, in the order of rules that the filters need.

    Sections below the least length go, then by category, heading and disclosure; the others are cut, garbled pieces
    and tables of contents go, and what is left is numbered within its file.
    """
    rows = section_rows.where(F.length("text") >= least).withColumns({"stock_code": stock, "year": year, "category": text.category(F.col("heading"), F.col("text"))})
    rows = rows.where(F.col("category").isin(*FOCUS)) if focus else rows
    disclosed = text.normalized(F.concat_ws(" ", "heading", "text")).rlike("|".join(DISCLOSURES))
    rows = rows.where(~text.is_noise_heading(F.col("heading")) & ~disclosed)
    kept = split_chunks(rows, "text", least, most, overlap).where(~text.is_garbled("text") & ~text.looks_like_contents("text"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("section", "piece_index"))
    return kept.withColumn("chunk_index", number).withColumn("chunk_id", F.concat_ws("_", "stock_code", "year", F.format_string("%04d", "chunk_index")))


def prefer_ocr(native: Column, ocr: Column) -> Column:
    """Whether a page's second reading is better: the first is empty or garbled and the second isn't, or is much longer."""
    n, o = F.length(text.strip(F.coalesce(native, F.lit("")))), F.length(text.strip(F.coalesce(ocr, F.lit(""))))
    bad, worse = text.is_garbled(native), text.is_garbled(ocr)
    return F.when(o == 0, F.lit(False)).when(n == 0, F.lit(True)).when(bad & ~worse, F.lit(True)).when(worse & ~bad, F.lit(False)).when(bad, o >= 1.2 * n).otherwise(o >= 1.5 * n)


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wanted: str = r"(?i)\.pdf$|\?.*pdf", most: int | None = None) -> DataFrame:
    """(id, link_no, link): absolute http links of a page that match, first occurrence each, in page order."""
    hrefs = F.posexplode(F.regexp_extract_all(html_col, F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']+)[\"']"), 1))
    found = pages.select(id_col, url_col, hrefs.alias("at", "href"))

    @F.pandas_udf("string")
    def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
        def one(b: str, h: str) -> str | None:
            try:
                full = urljoin(b, h.strip())
                return full.split("#")[0] if urlsplit(full).scheme in ("http", "https") else None
            except ValueError:
                return None

        return pd.Series([one(b or "", h) for b, h in zip(base, href, strict=True)])

    full = found.withColumn("link", absolute(url_col, "href")).where(F.col("link").isNotNull() & F.col("link").rlike(wanted))
    first = full.groupBy(id_col, "link").agg(F.min("at").alias("at"))
    numbered = first.withColumn("link_no", F.row_number().over(Window.partitionBy(id_col).orderBy("at")))
    return (numbered.where(f"link_no <= {int(most)}") if most else numbered).select(id_col, "link_no", "link")


def html_lines(html: Column) -> Column:
    """Text of simple markup, a line a tag."""
    return F.filter(F.transform(F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n"), text.strip), lambda x: x != "")


def business_areas(html: Column, most: int = 2000) -> Column:
    """Lines without their last full stop, each once whatever its case, joined, cut with an ellipsis."""
    lines = F.transform(html_lines(html), lambda x: F.regexp_replace(x, "\\.+$", ""))
    # Looking each line up among all lines takes a page's lines squared: sorted, a line's copies stand behind its first.
    ordered = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("lower"), i.alias("at"), x.alias("line"))))
    first = text.let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["lower"] != x["lower"])))
    once = F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))).otherwise(x)
    return text.let(F.array_join(F.transform(once, lambda x: x["line"]), "; "), cut)


def embedding_text(title: Column, body: Column, chunk_id: Column, most: int = 3500) -> Column:
    joined = text.strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))
    return F.coalesce(F.nullif(F.substring(joined, 1, most), F.lit("")), chunk_id)


def embedded(pending: DataFrame, embedder, id_col: str = "chunk_id", text_col: str = "input") -> DataFrame:
    """(id, embedding) from an injected function of a list of texts, called with batches inside tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "embedding": list(embedder(f[text_col].tolist()))})

    return pending.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {pending.schema[id_col].dataType.simpleString()}, embedding array<float>")
