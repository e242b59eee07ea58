"""Structured results of language models: repaired, validated, clamped, completed; spending ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text

#: What stands in for a missing warning or tip.
FALLBACKS = {
    "WARNING": ("fallback-warning", "Theo dõi chi tiêu", "Duy trì ghi nhận giao dịch đều để phát hiện sớm biến động chi tiêu."),
    "TIP": ("fallback-tip", "Mẹo tài chính", "Đặt mức trần cho 1–2 danh mục chi lớn để kiểm soát ngân sách."),
}


# Formats that models wrap their answers in.
_REASONING = "(?is)<\\|?think\\|?>.*?<\\|?/?think\\|?>"
_FENCED = "(?s)^```(?:json)?(.*?)(?:```)?$"


def _is_object(body: Column) -> Column:
    """Whether a text is one JSON object and nothing else. The parser stops after a value, so that the text is read once in brackets and once as a field."""
    field = F.schema_of_variant(F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))))
    return F.coalesce(field.startswith("OBJECT<v: OBJECT"), F.lit(False)) & F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull()


def _without_trailing_commas(body: Column) -> Column:
    """Commas before a closing bracket go, unless they are in a string."""
    return F.regexp_replace(body, '("(?:[^"\\\\]++|\\\\.)*+")|,(?=\\s*[}\\]])', "$1")


def repaired_json(raw: Column | str) -> Column:
    """The text of a JSON object, from text with reasoning tags, fences, trailing commas or without its braces; else NULL.

    Numbers beyond JSON (NaN, Infinity) and repeated keys are no JSON.
    """
    body = text.strip(F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, _REASONING, ""))
    body = F.when(body.startswith("```"), text.strip(F.regexp_extract(body, _FENCED, 1))).otherwise(body)

    def object_(t: Column) -> Column:
        return F.when(_is_object(t), t)

    def first(b: Column) -> Column:
        # an array or a scalar is an answer too, but no object
        other = F.try_parse_json(F.concat(F.lit("["), b, F.lit("]"))).isNotNull()
        braced = F.coalesce(object_(b), text.let(_without_trailing_commas(b), object_))
        return F.when(b.startswith("{"), braced).when((b != "") & ~other, text.let(F.concat(F.lit("{"), b, F.lit("}")), object_))

    return text.let(body, first)


def insights(items: DataFrame, request: str = "request_id", place: str = "place", sparse: Column | None = None) -> DataFrame:
    """(request, type, id, title, message, confidence): of the first five items the last valid one of each type, or its fallback.

    items: request, place from 0, id, type, title, message, confidence.
    """
    low = F.coalesce(sparse, F.lit(False)) if sparse is not None else F.lit(False)
    top = F.when(low, 0.75).otherwise(1.0)
    kind = F.upper("type")
    title, message = F.substring(F.trim("title"), 1, 60), F.substring(F.trim("message"), 1, 180)
    confidence = F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.0)), top)
    rows = items.where(F.col(place) < 5).select(request, place, kind.alias("type"), F.coalesce("id", F.concat(F.lit("insight-"), F.col(place).cast("string"))).alias("id"), title.alias("title"), message.alias("message"), confidence.alias("confidence"))
    good = rows.where(F.col("type").isin("WARNING", "TIP") & (F.col("title") != "") & (F.col("message") != ""))
    chosen = good.groupBy(request, "type").agg(F.max_by(F.struct("id", "title", "message", "confidence"), place).alias("row"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("type"), *(F.lit(v).alias(f"f_{n}") for n, v in zip(("id", "title", "message"), f, strict=True))) for k, f in FALLBACKS.items())))
    every = items.groupBy(request).agg(F.max(low).alias("low")).select(request, "low", kinds.alias("f")).select(request, "low", "f.*")
    out = every.join(chosen, [request, "type"], "left")
    fields = [F.coalesce(F.col(f"row.{n}"), F.col(f"f_{n}")).alias(n) for n in ("id", "title", "message")]
    return out.select(request, "type", *fields, F.coalesce("row.confidence", F.when(F.col("low"), 0.65).otherwise(0.7)).alias("confidence"))


def prefill(drafts: DataFrame, categories: Column, accounts: Column) -> DataFrame:
    """Drafts (amount, type, categoryId, accountId, note, transactionDate, confidence, warnings) with only allowed values, and what is missing."""
    c = F.col
    bad_category, bad_account = (F.coalesce((c(n) != "") & ~F.array_contains(allowed, c(n)), F.lit(False)) for n, allowed in (("categoryId", categories), ("accountId", accounts)))
    extra = F.filter(
        F.array(F.when(bad_category, "Hệ thống: categoryId không nằm trong danh sách cho phép"), F.when(bad_account, "Hệ thống: accountId không nằm trong danh sách cho phép")), lambda x: x.isNotNull()
    )
    out = drafts.withColumns({
        "warnings": F.slice(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), extra), 1, 10),
        "amount": F.when(c("amount") > 0, c("amount")),
        "categoryId": F.when(~bad_category, c("categoryId")),
        "accountId": F.when(~bad_account, c("accountId")),
        "note": F.substring("note", 1, 500),
        "transactionDate": F.date_format(F.col("transactionDate").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "confidence": F.least(F.greatest(F.coalesce(c("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)),
    })
    missing = F.filter(F.array(*(F.when(c(n).isNull(), n) for n in ("amount", "type", "categoryId", "accountId", "transactionDate"))), lambda x: x.isNotNull())
    return out.withColumn("missingFields", missing)


def recently_active(series: Column) -> Column:
    """Whether one of the last two points of at least two has income or expense."""
    return F.when(F.size(series) >= 2, F.exists(F.slice(series, -2, 2), lambda m: (m["income"] > 0) | (m["expense"] > 0))).otherwise(False)


def spending_percent(expense: Column, income: Column) -> Column:
    """Spending as a whole percentage of income, half to even; NULL without income."""
    return F.bround(F.try_divide(expense, F.when(income > 0, income)) * 100).cast("int")


_USAGE = {"input": ("prompt_tokens", "input_tokens"), "output": ("completion_tokens", "output_tokens"), "total": ("total_tokens",)}


def usage(raw: Column) -> dict[str, Column]:
    """Token counts of a JSON usage object; a missing total is their sum."""
    got = {n: F.coalesce(*(F.get_json_object(raw, f"$.{k}").try_cast("long") for k in keys)) for n, keys in _USAGE.items()}
    return got | {"total": F.coalesce(got["total"], F.coalesce(got["input"], F.lit(0)) + F.coalesce(got["output"], F.lit(0)))}


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.10, price_out: float = 0.40) -> Column:
    """Of a million tokens each way, rounded to eight places."""
    return F.bround(tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6, 8)


_CALLS = "array<struct<id:string,function:struct<name:string,arguments:string>>>"


def tool_calls(df: DataFrame, body: str = "body") -> DataFrame:
    """df with content, finish_reason and calls (id, name, arguments) of a model's reply; arguments that are no JSON object are {}."""
    message = lambda key: F.get_json_object(body, f"$.choices[0].{key}")
    raw = F.coalesce(F.from_json(message("message.tool_calls"), _CALLS), F.array().cast(_CALLS))
    arguments = lambda a: F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(a)).startswith("OBJECT"), F.lit(False)), a).otherwise("{}")
    calls = F.transform(raw, lambda c: F.struct(F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(c["function"]["name"], F.lit("")).alias("name"), arguments(c["function"]["arguments"]).alias("arguments")))
    finish = F.coalesce(message("finish_reason"), F.when(message("message").isNotNull() | F.get_json_object(body, "$.choices[0]").isNotNull(), "stop"))
    return df.withColumns({"content": F.coalesce(message("message.content"), F.when(F.get_json_object(body, "$.choices[0]").isNull(), "")), "finish_reason": finish, "calls": calls})
