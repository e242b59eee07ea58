"""Company records from several sources: overviews, snapshots, codes, lookups, and the inputs of a valuation."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import checks, num, text
from marlstone.operators import ingest, valuation

# A vendor's column names in the order in which they are tried, and the fields of the receiving service.
INDUSTRY_COLUMNS = ("industry", "industry_name", "industry_label", "industrytype", "sector")
LEVEL_NAMES = ("icb_name2", "icb_name3", "icb_name4")
CODE_COLUMNS = ("icb_code", "icbid", "ma_nganh_icb", "industry_code", "industrycode")
LEVEL_CODES = tuple(f"{stem}{level}" for level in (4, 3, 2, 1) for stem in ("icbcode", "icb_code", "icb_code_"))
NAME_COLUMNS = ("short_name", "company_name", "company_full_name", "organ_name", "organization_name", "ticker_name", "company_listing_name")
PROFILE_KEYS = ("companyName", "company_name", "short_name", "shortName", "companyFullName", "company_full_name", "fullName", "organ_name", "organization_name", "organizationName", "ticker_name", "company_listing_name", "companyListingName")
PUSHED = {
    ("indicators", True): ("pe", "pb", "ps", "roe", "roa", "eps", "bvps", "cplh"),
    ("indicators", False): ("pe", "pb", "ps", "roe", "roa", "eps", "bvps", "cplh", "lng", "lnr"),
    ("income", True): ("profitAfterTax", "netInterestIncome", "netFeeAndCommissionIncome", "netOtherIncomeOrExpenses", "interestExpense", "netProfit"),
    ("income", False): ("profitAfterTax", "netRevenue", "totalRevenue", "netProfit"),
    ("balance", True): ("cashAndCashEquivalents", "totalAssets", "equity", "totalCapital", "totalLiabilities", "balancesWithSbv", "interbankPlacementsAndLoans", "tradingSecurities", "investmentSecurities", "loansToCustomers", "govAndSbvDebt", "depositsBorrowingsOthers", "depositsFromCustomers", "convertibleAndOtherPapers"),
    ("balance", False): ("cashAndCashEquivalents", "totalAssets", "equity", "totalCapital", "totalLiabilities", "shortTermInvestments", "shortTermReceivables", "longTermReceivables", "inventories", "fixedAssets", "shortTermBorrowings", "longTermBorrowings", "advancesFromCustomers"),
}
RENAMED = {"interestExpense": "interestAndSimilarExpenses"}
SNAPSHOT = {"livePriceVnd": "livePriceVnd", "livePe": "livePe", "livePb": "livePb", "livePs": "livePs", "currentPe": "currentPE", "currentPb": "currentPB", "currentPs": "currentPS", "medianPe": "medianPE", "medianPb": "medianPB", "medianPs": "medianPS"}


def _filled(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns (in any case) that the frame has and that isn't blank or NaN."""
    have = {c.lower(): c for c in df.columns}
    found = []
    for n in names:
        if n in have:
            c = F.col(f"`{have[n]}`").cast("string")
            found.append(F.when(c != "NaN", F.nullif(text.strip(c), F.lit(""))))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _nodes(document: object) -> Iterator[object]:
    """All objects and arrays of a JSON value, each before what it holds, in the order of the text."""
    waiting = [document]
    while waiting:
        node = waiting.pop()
        held = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else None
        if held is not None:
            yield node
            waiting.extend(reversed(held))


def key_search(wanted: Sequence[str]):
    """A function of (JSON, text to pass over): the first wanted key with a scalar value that isn't blank, an object's own keys before what lies below, else NULL.

    Keys have no known path, so a batch of texts is parsed in Python; call it for the rows that need it.
    """
    names = {w.lower() for w in wanted}

    def first(raw: str | None, besides: str | None) -> str | None:
        try:
            objects = (node for node in _nodes(json.loads(raw or "null")) if isinstance(node, dict))
            fields = (str(v).strip() for node in objects for k, v in node.items() if k.lower() in names and isinstance(v, (str, int, float)))
            return next((v for v in fields if v and v.lower() != (besides or "").lower()), None)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def search(raw: pd.Series, besides: pd.Series) -> pd.Series:
        return pd.Series(list(map(first, raw, besides)), dtype=object)

    return search


def overview(df: DataFrame, most: int = 2000) -> DataFrame:
    """df with companyName, industryLabelFull, description and icbCode, from a vendor's columns in any case."""
    low = {c.lower() for c in df.columns}
    more = [c.lower() for c in df.columns if "industry" in c.lower() and "industry_id" not in c.lower() and c.lower() not in INDUSTRY_COLUMNS]
    industry = F.coalesce(_filled(df, [*INDUSTRY_COLUMNS, *more]), _filled(df, LEVEL_NAMES))
    names = [c.lower() for c in df.columns if "name" in c.lower() and not any(w in c.lower() for w in ("industry", "share", "owner")) and not c.lower().startswith("icb_")]
    code = F.coalesce(*(ingest.icb_code(_filled(df, [c])) for c in (*CODE_COLUMNS, *LEVEL_CODES) if c in low), F.lit(None))
    path = F.array_join(F.array_distinct(F.filter(F.array(*(_filled(df, [c]) for c in LEVEL_NAMES)), lambda x: x.isNotNull())), " > ")
    label = F.coalesce(F.nullif(path, F.lit("")), F.col("__industry"))
    name = _filled(df, [*NAME_COLUMNS, *names])
    out = df.withColumn("__industry", industry)
    if "company_profile" in low:
        unnamed = F.when(name.isNull(), F.col("company_profile").cast("string"))
        out = out.withColumn("__found", F.when(unnamed.isNotNull(), key_search(PROFILE_KEYS)(unnamed, F.coalesce("__industry", F.lit("")))))
        name = F.coalesce(name, F.col("__found"))
    out = out.withColumn("__name", name)
    says = [F.col("__name"), F.concat(F.lit("hoạt động trong lĩnh vực "), F.col("__industry")), F.concat(F.lit("thành lập năm "), _filled(df, ("established_year", "establishedyear", "established"))), F.concat(F.lit("Website: "), _filled(df, ("website", "web")))]
    return out.withColumns({
        "companyName": F.col("__name"),
        "industryLabelFull": F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 3), F.lit("..."))).otherwise(label),
        "description": F.nullif(F.concat_ws(" ", *says), F.lit("")),
        "icbCode": code,
    }).drop("__industry", "__name", "__found")


def pushed(df: DataFrame, kind: str, bank: bool, company: Column, year: int = 2026, quarter: int = 1) -> DataFrame:
    """Rows of kind indicators, income or balance as the receiving service names them; a missing field is NULL, a missing period a default."""
    period = [(F.coalesce(F.col(n).cast("int"), F.lit(v)) if n in df.columns else F.lit(v)).alias(n) for n, v in (("year", year), ("quarter", quarter))]
    fields = [(F.col(source).cast("double") if (source := RENAMED.get(f, f)) in df.columns else F.lit(None).cast("double")).alias(f) for f in PUSHED[kind, bank]]
    return df.select(company.alias("companyId"), *period, *fields)


def company_overview(payload: Column) -> Column:
    """All that an analysis payload keeps for metrics: its overview, as JSON."""
    return F.get_json_object(payload, "$.overview")


def live_snapshot(df: DataFrame, payload: str = "payload", symbol: str = "symbol") -> DataFrame:
    """symbol, live, current and median multiples and what each live one is called, from a payload's overview."""
    of = lambda key: F.get_json_object(payload, f"$.overview.{key}")
    named = F.coalesce(F.nullif(F.col(symbol), F.lit("")), F.nullif(F.upper(text.strip(of("symbol"))), F.lit("")))
    out = df.select(named.alias("symbol"), of("livePriceSource").alias("livePriceSource"), *(num.finite(of(key)).alias(name) for name, key in SNAPSHOT.items()))
    return out.withColumns({f"{m.lower()}View": num.relative_view(f"live{m}", f"median{m}") for m in ("Pe", "Pb", "Ps")})


def with_code(df: DataFrame, listing: DataFrame, order: str, symbol: str = "symbol") -> DataFrame:
    """df with icb_code of its symbol, in any case, by a listing (symbol, icb_code) whose first row in ``order`` counts."""
    key = F.upper(text.strip(symbol))
    codes = listing.select(key.alias("__key"), ingest.icb_code(F.col("icb_code")).alias("icb_code"), order).where("icb_code is not null").groupBy("__key").agg(F.min_by("icb_code", order).alias("icb_code"))
    return df.withColumn("__key", key).join(codes, "__key", "left").drop("__key")


def details(found: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Search results with their chunks' columns; a result without a chunk stays. Few results are few keys: AQE may broadcast them by size."""
    return found.join(chunks, id_col, "left")


def new_codes(after: DataFrame, before: DataFrame, code: str = "code") -> DataFrame:
    """Known codes that weren't there before."""
    return after.select(code).where(f"{code} <> 'UNKNOWN'").distinct().join(before.select(code), code, "left_anti")


def code_counts(files: DataFrame, name: str = "name") -> DataFrame:
    """(code, files) of every code that file names hold, UNKNOWN included."""
    stem = F.regexp_replace(F.col(name), "\\.[^.]*$", "")
    return files.groupBy(text.stock_from_name(stem).alias("code")).agg(F.count("*").alias("files"))


def counts_line(counts: DataFrame) -> DataFrame:
    """One row: {A:1, B:2} of the known codes in order. The codes are those of one market, so the line is short."""
    known = F.transform(F.array_sort(F.collect_list(F.when(F.col("code") != "UNKNOWN", F.struct("code", "files")))), lambda x: F.concat_ws(":", x["code"], x["files"].cast("string")))
    return counts.agg(F.concat(F.lit("{"), F.array_join(known, ", "), F.lit("}")).alias("line"))


def run_summary(pages: DataFrame, dropped: Column | None = None) -> DataFrame:
    """One row of a run over pages (file, native, ocr): files, pages, pages with text and with OCR, and rates in percent, 0 without pages."""
    filled = lambda c: F.coalesce(text.strip(c) != "", F.lit(False))
    rows = pages.select("file", filled("native").alias("t"), filled("ocr").alias("o"), (dropped if dropped is not None else F.lit(0)).alias("d"))
    out = rows.agg(
        F.countDistinct("file").alias("files_processed"), F.countDistinct(F.when(F.col("o"), F.col("file"))).alias("files_with_ocr"), F.coalesce(F.sum("d"), F.lit(0)).alias("chunks_dropped_garbled"), F.count("*").alias("pages_total"),
        F.count_if(F.col("t") | F.col("o")).alias("pages_with_text"), F.count_if("o").alias("pages_with_ocr"),
    )
    rate = lambda of: F.coalesce(F.try_divide(F.col("pages_with_ocr") * 100.0, F.col(of)), F.lit(0.0))
    return out.withColumns({"ocr_rate_on_total_pages_pct": rate("pages_total"), "ocr_rate_on_text_pages_pct": rate("pages_with_text")})


def suggested(companies: DataFrame, query: str, k: int = 10, symbol: str = "symbol", name: str = "name") -> DataFrame:
    """The k companies that a search word fits best: the symbol itself, symbols that start with it, names that do, names that have it."""
    q, s, n = F.lit(query.strip()), F.upper(text.strip(symbol)), text.normalized(name)
    folded = text.normalized(q)
    fit = F.when(s == F.upper(q), 0).when(s.startswith(F.upper(q)), 1).when(n.startswith(folded), 2).when(n.contains(folded), 3)
    return companies.withColumn("fit", fit).where("fit is not null").orderBy("fit", symbol).limit(k)


def listed_symbols(companies: DataFrame, exchanges: str | None = None, limit: int | None = None, order: str = "id", symbol: str = "id") -> DataFrame:
    """Trimmed upper-case symbols in order, each once, of the wanted exchanges."""
    rows = ingest.exchange_filter(companies, exchanges) if exchanges else companies
    named = rows.select(F.upper(text.strip(symbol)).alias("symbol"), F.col(order).alias("__order")).where("symbol <> ''")
    first = named.groupBy("symbol").agg(F.min("__order").alias("__order")).orderBy("__order", "symbol")
    return (first.limit(limit) if limit is not None else first).select("symbol")


def report_links(feed: DataFrame, years: int, symbol: str = "symbol", name: str = "name", link: str = "link", year: str = "year", order: str = "ord") -> DataFrame:
    """(symbol, year, name, link): a symbol's annual reports, the first link of a year, of its latest years only."""
    folded = text.normalized(F.coalesce(F.col(name), F.lit("")))
    given = F.col(year).try_cast("int")
    when = F.coalesce(F.when(given.between(1900, 2100), given), F.nullif(F.regexp_extract(name, "(20\\d{2})", 1), F.lit("")).cast("int"))
    kept = feed.withColumn("__year", when).where(folded.contains("bao cao thuong nien") & ~folded.rlike("ban dieu le|ban cao bach") & F.col("__year").isNotNull() & (F.trim(link) != ""))
    first = kept.groupBy(F.col(symbol).alias("symbol"), F.col("__year").alias("year")).agg(F.min_by(F.struct(F.col(name).alias("name"), F.col(link).alias("link")), order).alias("r"))
    ranked = first.withColumn("n", F.dense_rank().over(Window.partitionBy("symbol").orderBy(F.desc("year"))))
    return ranked.where(f"n <= {int(years)}").select("symbol", "year", "r.name", "r.link")


def valuation_inputs(metrics: DataFrame, financial: DataFrame, daily: DataFrame, live: DataFrame, forecast: DataFrame) -> DataFrame:
    """What a fair value needs, one row a symbol, from five sources; ``error`` names the sources of the three critical ones that lack it.

    metrics: symbol, eps, bvps, roe, cplh, industry_code, industry_label.  financial: symbol, year, profit.  daily: symbol,
    pe, pb.  live: symbol, live_price.  forecast: symbol, profit_pred.  Each source is one row a symbol before the joins.
    """
    history = valuation.profit_cagr(financial)
    medians = daily.groupBy("symbol").agg(F.median("pe").alias("median_pe"), F.median("pb").alias("median_pb"))
    marked = [(n, f.withColumn(f"__{n}", F.lit(True))) for n, f in (("metrics", metrics), ("financial", history), ("live", live.select("symbol", "live_price")))]
    out = marked[0][1]
    for _, f in marked[1:]:
        out = out.join(f, "symbol", "full")
    out = out.join(medians, "symbol", "left").join(forecast.select("symbol", F.col("profit_pred").alias("forecast_profit")), "symbol", "left")
    gone = F.filter(F.array(*(F.when(F.col(f"__{n}").isNull(), F.lit(n)) for n, _ in marked)), lambda x: x.isNotNull())
    error = F.when(F.size(gone) > 0, F.concat(F.lit("Không lấy được dữ liệu: "), F.array_join(gone, "; ")))
    industry = valuation.industry(F.col("industry_code"), F.col("industry_label"))
    return out.withColumns({"error": error, "industry": industry}).drop(*(f"__{n}" for n, _ in marked))


def industries_of(companies: DataFrame, symbols: Sequence[str], symbol: str = "symbol", code: str = "industry_code", label: str = "industry_label", order: str = "ord") -> DataFrame:
    """(symbol, code, label, industry) of each wanted symbol, trimmed and in upper case, once; the first row in ``order`` counts, and a symbol without one has no code.

    An empty list is an error.
    """
    wanted = [s.strip().upper() for s in checks.required_list({"symbols": list(symbols)}, "symbols")]
    asked = companies.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(w for w in wanted if w)], "symbol string")
    rows = companies.select(F.upper(text.strip(symbol)).alias("symbol"), F.struct(F.col(code).cast("string").alias("code"), F.col(label).alias("label")).alias("i"), F.col(order).alias("__o"))
    first = rows.join(F.broadcast(asked), "symbol", "left_semi").groupBy("symbol").agg(F.min_by("i", "__o").alias("i"))  # one request's symbols
    return asked.join(first, "symbol", "left").select("symbol", F.col("i.code").alias(code), F.col("i.label").alias(label), valuation.industry(F.col("i.code"), F.col("i.label")).alias("industry"))


def market_data(sections: dict[str, DataFrame], include: Sequence[str] | str | None = None, annual: int | None = None, quarterly: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(symbol, section, year, quarter, payload): the wanted sections of symbols' market data as JSON rows.

    sections: frames (symbol, year, quarter, values) by name; a null or zero quarter is a whole year. include: names, as a list or a text with
    commas; nothing means all, an unknown name is an error. annual and quarterly: how many of the latest whole years and quarters of each symbol
    and section stay, all without a number. first and last: bounds of the year, both included.
    """
    names = [n.strip() for n in (include.split(",") if isinstance(include, str) else [str(n) for n in include or ()]) if n.strip()] or list(sections)
    unknown = [n for n in names if n not in sections]
    if unknown:
        raise ValueError(f"sections {', '.join(unknown)} aren't among {', '.join(sections)}")
    out = None
    for name in dict.fromkeys(names):
        f = sections[name]
        values = [c for c in f.columns if c not in ("symbol", "year", "quarter")]
        one = f.select(F.upper(text.strip("symbol")).alias("symbol"), F.lit(name).alias("section"), F.col("year").cast("int").alias("year"), F.nullif(F.col("quarter").cast("int"), F.lit(0)).alias("quarter"), F.to_json(F.struct(*values)).alias("payload"))
        out = one if out is None else out.unionByName(one)
    for bound, fits in ((first, lambda y: y >= first), (last, lambda y: y <= last)):
        out = out.where(fits(F.col("year"))) if bound is not None else out
    if annual is None and quarterly is None:
        return out
    kind = F.col("quarter").isNull()
    place = F.dense_rank().over(Window.partitionBy("symbol", "section", kind).orderBy(F.desc("year"), F.desc_nulls_last("quarter")))
    most = F.when(kind, F.lit(annual)).otherwise(F.lit(quarterly))
    return out.withColumns({"__place": place, "__most": most}).where("__most is null or __place <= __most").drop("__place", "__most")
