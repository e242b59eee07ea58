"""Text column expressions: folding, slugs, tokens, keywords, headings, garbled text, names in file names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ranges(codes: list[int]) -> str:
    """A regular expression's class of code points, which ascend. What is below the first is turned down at once, as ranges are tried one by one."""
    out, first = [], 0
    for k, code in enumerate(codes):
        if k + 1 == len(codes) or codes[k + 1] != code + 1:
            out.append(f"\\x{{{codes[first]:x}}}-\\x{{{code:x}}}")
            first = k + 1
    return f"[\\x{{{codes[0]:x}}}-\\x{{10ffff}}&&[{''.join(out)}]]"


def _folds() -> tuple[dict[str, str], list[int]]:
    """Of the planes that have decompositions: characters whose compatible decomposition without marks differs from them, and the marks."""
    found, marks = {}, []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not base:
            marks.append(code)
        elif base != c:
            found[c] = base
    return found, marks


_FOLDS, _MARK_CODES = _folds()
_FROM, _TO = ("".join(x[k] for x in _FOLDS.items() if len(x[1]) == 1) for k in (0, 1))
_FROM += "".join(map(chr, _MARK_CODES))  # what has no counterpart goes
#: Ligatures, fractions, syllables and the like, which become several characters.
_SEVERAL = {c: base for c, base in _FOLDS.items() if len(base) > 1}
_SEVERAL_CLASS = _ranges([ord(c) for c in _SEVERAL])


def _spelt(c: Column) -> Column:
    """What one character of _SEVERAL becomes, place by place."""
    places = []
    for k in range(max(map(len, _SEVERAL.values()))):
        some = {x: base for x, base in _SEVERAL.items() if len(base) > k}
        place = F.translate(c, "".join(some), "".join(base[k] for base in some.values()))
        places.append(place if k < 2 else F.when(c.rlike(_ranges([ord(x) for x in some])), place).otherwise(""))
    return F.concat(*places)


def folded(x: Column | str) -> Column:
    """Compatible decomposition (NFKD) without combining marks."""
    def several(t: Column) -> Column:
        parts = F.split(t, f"(?={_SEVERAL_CLASS})")
        spelt = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{_SEVERAL_CLASS}"), F.concat(_spelt(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))).otherwise(p)), "")
        return F.when(t.rlike(_SEVERAL_CLASS), spelt).otherwise(t)

    plain = F.translate(_c(x), _FROM, _TO)
    return F.when(F.octet_length(_c(x)) == F.char_length(_c(x)), _c(x)).otherwise(let(plain, several))


#: All of Unicode's white space, and the four separators of ASCII that Python counts as such.
_WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(x: Column | str) -> Column:
    """Trimmed of all of Unicode's white space, not only U+0020."""
    return F.btrim(_c(x), F.lit(_WHITE))


def normalized(x: Column | str, fold_dj: bool = False) -> Column:
    """Without accents, trimmed, lower case, white space as one space. The letter dj has no decomposition; fold_dj maps it to d."""
    t = folded(x)
    if fold_dj:
        t = F.translate(t, "đĐ", "dD")
    return F.regexp_replace(F.lower(strip(t)), "(?U)\\s+", " ")


#: Letters of Latin scripts that are one base letter with accents, and these letters.
_ACCENTED, _PLAIN = ("".join(x[k] for x in _FOLDS.items() if len(x[1]) == 1 and "À" <= x[0] < "\u2000") for k in (0, 1))


def ascii_lower(x: Column | str) -> Column:
    """Lower case with Vietnamese accents, and dj, folded."""
    return F.translate(F.translate(F.lower(_c(x)), _ACCENTED, _PLAIN), "đ", "d")


def match_key(x: Column | str) -> Column:
    """ASCII only, upper case, without spaces and underscores; letters without a decomposition are gone."""
    return F.regexp_replace(F.upper(F.regexp_replace(folded(x), "[^\\x00-\\x7F]", "")), "[\\s_]+", "")


def slug(x: Column | str) -> Column:
    """Runs of anything but ASCII letters and digits as one underscore, upper case; UNKNOWN if nothing is left."""
    s = F.upper(F.regexp_replace(F.regexp_replace(_c(x), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("UNKNOWN"))


def tokens(x: Column | str) -> Column:
    """Runs of two or more ASCII letters and digits of the folded text; white space needs no folding for that."""
    # Extracting all matches would copy the text for each of them.
    return F.filter(F.split(F.lower(folded(x)), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


#: Words that are no keywords.
STOPWORDS = ("la", "là", "cua", "của", "the", "va", "và", "cho", "nhung", "những", "nam", "năm", "bao", "nhiêu")


def keywords(x: Column | str, most: int = 12) -> Column:
    """The first distinct words of two or more characters that are no stopwords."""
    words = F.split(F.lower(_c(x)), "(?U)\\W+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))), 1, most)


def keyword_score(text: Column | str, words: list[str]) -> Column:
    """Occurrences of each keyword as a substring; the first three count in full, the others 0.6."""
    t = F.lower(_c(text))
    score = F.lit(0.0)
    for i, w in enumerate(words):
        score = score + (F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w) * (1.0 if i < 3 else 0.6)
    return score


def is_heading(line: Column | str) -> Column:
    """Chapter words, section numbers, roman numerals, short capitals, or a short line that ends with a colon."""
    starts = lambda n: n.rlike("^(chuong|phan|muc)\\b") | n.rlike("^\\d{1,2}(\\.\\d{1,2}){0,3}\\b") | n.rlike("^(i|ii|iii|iv|v|vi|vii|viii|ix|x)\\b")
    capitals = let(F.regexp_replace(_c(line), "[^A-Za-z]", ""), lambda raw: F.length(raw).between(4, 80) & (raw == F.upper(raw)))
    colon = strip(line).endswith(":") & (F.length(strip(line)) <= 120)
    return F.coalesce(let(normalized(line), lambda n: F.length(n).between(1, 160) & (starts(n) | colon | capitals)), F.lit(False))


def is_noise_heading(heading: Column | str) -> Column:
    h, n = strip(F.coalesce(_c(heading), F.lit(""))), normalized(F.coalesce(_c(heading), F.lit("")))
    return (n == "") | h.isin(":", "-", "--") | n.rlike("^\\d{1,3}$") | n.rlike("^\\d{1,3}\\s*/\\s*\\d{1,3}$") | (n.rlike("^\\d+(\\.\\d+){1,3}$") & (F.length(n) <= 7))


def looks_like_contents(text: Column | str) -> Column:
    """Of at least six lines, mostly short and numbered ones, or three with dotted leaders."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), strip), lambda x: x != "")
    n = F.size(lines)
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 45))
    numbered = F.size(F.filter(lines, lambda x: normalized(x).rlike("^(\\d+|[ivx]+|[-•])")))
    dotted = F.size(F.filter(lines, lambda x: x.rlike("\\.{3,}")))
    return F.coalesce((n >= 6) & (((short >= 0.70 * n) & (numbered >= 0.45 * n)) | (dotted >= 3)), F.lit(False))


_EDGE = "^[.,;:!?()\\[\\]{}\"'`]+|[.,;:!?()\\[\\]{}\"'`]+$"


def is_garbled(text: Column | str) -> Column:
    """Text that a broken font or scan has left: words mixed of letters and digits, odd symbols, replacement characters."""
    return let(strip(F.coalesce(_c(text), F.lit(""))), lambda t: let(_signs(t), _judged))


def _signs(t: Column) -> Column:
    """Numbers of a text's words and of those that are mixed, odd and weird, of characters lost and of all."""

    def counted(words: Column) -> Column:
        # Edges hold neither letters nor digits, so that only the few mixed words need to lose theirs.
        mixed = F.when(t.rlike("\\d"), F.transform(F.filter(words, lambda w: w.rlike("\\d") & w.rlike("[A-Za-z]")), lambda w: F.regexp_replace(w, _EDGE, ""))).otherwise(F.array().cast("array<string>"))
        weird = F.when(t.rlike("[\\^~`|{}<>]"), F.size(F.filter(words, lambda w: w.rlike("[\\^~`|{}<>]")))).otherwise(0)
        lost = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
        return let(mixed, lambda m: F.struct(F.size(words).alias("n"), F.size(m).alias("mixed"), F.size(F.filter(m, _suspicious)).alias("odd"), weird.alias("weird"), lost.alias("lost"), F.length(t).alias("size")))

    return let(F.array_remove(F.split(t, "(?U)\\s+"), ""), counted)


def _judged(found: Column) -> Column:
    n, n_mixed, n_odd, weird, lost, size = (found[k] for k in ("n", "mixed", "odd", "weird", "lost", "size"))
    sure = (lost >= 0.01 * size) | ((lost >= 3) & (lost >= 0.002 * size)) | ((n_odd >= 8) & (n_odd >= 0.12 * n))
    long = (n_odd >= 0.10 * n) | ((n_odd >= 0.07 * n) & (weird >= 0.03 * n)) | ((n_mixed >= 0.40 * n) & (n_odd >= 5))
    medium = (n_odd >= 3) | ((n_odd >= 0.20 * n) & (weird >= 1))
    brief = (n_odd >= 2) | ((weird >= 2) & (lost >= 1))
    return (n > 0) & (sure | F.when(n >= 20, long).when(n >= 8, medium).otherwise(brief))


def _suspicious(word: Column) -> Column:
    financial = word.rlike("^[Qq][1-4](?:[/-]?\\d{2,4})?$") | word.rlike("^(?:FY|fy)\\d{2,4}$") | word.rlike("^[A-Z]{2,8}\\d{2,4}$") | word.rlike("^\\d+(?:[.,]\\d+)?[xX]$")
    groups = F.size(F.regexp_extract_all(word, F.lit("[A-Za-z]+|\\d+"), 0))
    digits, letters = F.regexp_count(word, F.lit("(?U)\\d")), F.regexp_count(word, F.lit("\\p{L}"))
    return ~financial & ((groups >= 3) | word.rlike("[A-Za-z]\\d[A-Za-z]") | word.rlike("\\d[A-Za-z]\\d") | ((F.length(word) >= 6) & (digits >= 0.30 * (digits + letters))))


# Words that tell a section's category, in the order in which they are tried.
CATEGORIES = {
    "mdna": ("bao cao ban giam doc", "bao cao cua ban dieu hanh", "ban dieu hanh", "danh gia ket qua", "bao cao va danh gia cua ban dieu hanh", "thu cua chu tich", "thong diep cua chu tich", "tong giam doc", "giam doc dieu hanh", "md&a", "mda"),
    "strategy": ("ke hoach", "dinh huong", "chien luoc", "tam nhin", "su menh", "muc tieu", "ke hoach sxkd", "ke hoach tuong lai", "dinh huong phat trien"),
    "risk": ("rui ro", "quan ly rui ro", "thach thuc", "khung quan ly rui ro"),
    "governance": ("quan tri cong ty", "hoi dong quan tri", "bao cao quan tri", "hdqt", "ban kiem soat", "bks"),
    "sustainability": ("phat trien ben vung", "esg", "csr", "trach nhiem xa hoi", "moi truong"),
    "business_overview": ("thong tin chung", "ve chung toi", "tong quan", "thong tin co ban", "gioi thieu", "lich su", "nganh nghe"),
}


def category(heading: Column | str, text: Column | str | None = None, fold_dj: bool = False) -> Column:
    """The section's category from its heading and first three lines: numbered chapters, then strong phrases, then keywords."""
    lines = F.transform(F.slice(F.split(_c(text), "\n"), 1, 3), strip) if text is not None else F.array()
    preview = normalized(F.array_join(lines, " "), fold_dj) if text is not None else F.lit("")
    said = F.trim(F.concat_ws(" ", normalized(F.coalesce(_c(heading), F.lit("")), fold_dj), preview))
    return let(said, _category_of)


def _category_of(s: Column) -> Column:
    any_of = lambda *w: reduce(or_, (s.contains(x) for x in w))
    numbered = lambda n: s.contains(n) & s.rlike(f"\\b{n.replace('.', chr(92) + '.')}(\\.\\d+)?\\b")
    out = (
        F.when(numbered("1.7"), "strategy")
        .when(numbered("1.8"), "risk")
        .when(numbered("1.10") & any_of("rui ro"), "risk")
        .when(any_of("chuong 3") & any_of("ban dieu hanh", "danh gia"), "mdna")
        .when(any_of("chuong 5", "phan 4") & any_of("quan tri"), "governance")
        .when(any_of("chuong 6", "phan 6") & any_of("ben vung", "esg"), "sustainability")
        .when(any_of("chuong 1", "phan 1") & any_of("ve chung toi", "tong quan", "thong tin chung"), "business_overview")
        .when(any_of("bao cao ban giam doc", "ban dieu hanh", "danh gia ket qua hoat dong"), "mdna")
    )
    for name, words in CATEGORIES.items():
        out = out.when(any_of(*words), name)
    return out.otherwise("other")


def chapter_hint(heading: Column | str) -> Column:
    n = normalized(F.coalesce(_c(heading), F.lit("")))
    word, number = (F.regexp_extract(n, "\\b(chuong|phan)\\s+([ivx]+|\\d{1,2})\\b", k) for k in (1, 2))
    section = F.regexp_extract(n, "^(\\d{1,2}(?:\\.\\d{1,2}){0,3})\\b", 1)
    return F.when(word != "", F.concat(word, F.lit("_"), number)).when(section != "", section)


_NOT_CODES = ("annual", "report", "bao", "cao", "nam", "tai", "chinh", "hop", "nhat", "investor", "relations", "bctn", "bcb", "bdl", "cn", "bc")


def _brand(stem: Column) -> Column:
    n = normalized(stem)
    return F.when(n.contains("hpg") | n.contains("hoa phat"), "HPG").when(n.contains("acb") | n.contains("a chau") | n.contains("asia commercial"), "ACB")


def _code(word: Column) -> Column:
    return word.rlike("^[A-Z0-9]{2,6}$") & word.rlike("[A-Z]")


def stock_from_name(stem: Column | str) -> Column:
    """A file's stock code: its first word if it looks like one, then brand hints, then the first such word anywhere."""
    s = strip(stem)
    first = F.upper(F.regexp_extract(s, "^[_\\-\\s]*([^_\\-\\s]+)", 1))
    found = F.upper(F.regexp_extract(s, "([A-Za-z][A-Za-z0-9]{1,5})", 1))
    return F.coalesce(F.when(_code(first), first), _brand(s), F.nullif(found, F.lit("")), F.lit("UNKNOWN"))


def stock_from_name_hints_first(stem: Column | str) -> Column:
    """The other rule: brand hints first, and words such as report or annual are no codes."""
    s = _c(stem)
    words = F.filter(F.concat(F.array(F.upper(F.regexp_extract(strip(s), "^([^_\\-\\s]*)", 1))), F.transform(F.split(s, "[^A-Za-z0-9]+"), F.upper)), lambda w: _code(w) & ~F.lower(w).isin(*_NOT_CODES))
    found = F.upper(F.regexp_extract(s, "([A-Za-z][A-Za-z0-9]{1,5})", 1))
    return F.coalesce(_brand(s), F.get(words, F.lit(0)), F.nullif(found, F.lit("")), F.lit("UNKNOWN"))


def year_from_name(stem: Column | str) -> Column:
    s = _c(stem)
    four = F.nullif(F.regexp_extract(s, "\\b(20\\d{2})\\b", 1), F.lit("")).cast("int")
    two = F.nullif(F.regexp_extract(s, "(?i)(?:^|[_\\-])(\\d{2})(?:CN|TC|TN|BCTN|BC|$)", 1), F.lit("")).cast("int")
    return F.coalesce(four, F.when(two <= 30, two + 2000).otherwise(two + 1900), F.lit(0))


# Names of features for readers; an exact name, then the first part that occurs, else the last.
FEATURE_LABELS = {
    "nim_pct": "biên lãi thuần", "other_income": "thu nhập ngoài lãi", "interbank_placements": "quy mô cho vay/đặt vốn liên ngân hàng", "assets_to_equity": "đòn bẩy tài chính (tài sản/vốn chủ sở hữu)",
    "gdp_ty_dong_log": "môi trường tăng trưởng kinh tế", "fee_and_commission_income": "thu nhập từ phí dịch vụ", "profit_after_tax": "mặt bằng lợi nhuận sau thuế nền", "revenue_current": "mặt bằng doanh thu hiện tại",
    "net_interest_income": "thu nhập lãi thuần", "cpi_inflation_yoy_pp": "lạm phát CPI", "usd_vnd_log": "tỷ giá USD/VND", "interest_deposit_12m_pct": "lãi suất tiền gửi 12 tháng",
    "interest_loan_midlong_pct": "lãi suất cho vay trung dài hạn", "interest_loan_short_pct": "lãi suất cho vay ngắn hạn", "hrc_log": "giá thép cuộn cán nóng HRC", "iron_ore_log": "giá quặng sắt", "coal_log": "giá than",
    "oil_brent_log": "giá dầu Brent", "nat_gas_log": "giá khí tự nhiên", "gold_gc_log": "giá vàng", "roe": "tỷ suất lợi nhuận trên vốn chủ (ROE)", "roa": "tỷ suất lợi nhuận trên tổng tài sản (ROA)", "gross_margin": "biên lợi nhuận gộp",
    "net_margin": "biên lợi nhuận ròng", "total_assets_reported": "tổng tài sản", "equity": "vốn chủ sở hữu", "net_debt_to_equity_pct": "nợ ròng/vốn chủ sở hữu", "asset_growth_yoy": "tăng trưởng tài sản YoY",
    "revenue_yoy_pct": "tăng trưởng doanh thu YoY", "profit_yoy_pct": "tăng trưởng lợi nhuận YoY", "revenue_momentum_pct": "đà tăng trưởng doanh thu", "profit_momentum_pct": "đà tăng trưởng lợi nhuận", "vnindex_growth_yoy_pct": "tăng trưởng VN-Index YoY",
}
FEATURE_PARTS = (("nim", "biên lãi thuần"), ("interbank", "quy mô cho vay/đặt vốn liên ngân hàng"), ("fee", "thu nhập từ phí dịch vụ"), ("commission", "thu nhập từ phí dịch vụ"), ("other_income", "thu nhập ngoài lãi"), ("gdp", "bối cảnh kinh tế vĩ mô"), ("macro", "bối cảnh kinh tế vĩ mô"), ("profit", "mặt bằng lợi nhuận nền"), ("revenue", "mặt bằng doanh thu nền"), ("interest", "lãi suất"), ("vnindex", "chỉ số VN-Index"), ("spread", "biên chênh giá"))
OTHER_FEATURE = "một số chỉ tiêu tài chính nội tại khác"


def feature_label(name: Column | str) -> Column:
    key = F.lower(strip(F.coalesce(_c(name), F.lit(""))))
    exact = F.create_map(*(F.lit(x) for pair in FEATURE_LABELS.items() for x in pair))
    out = F.when(F.map_contains_key(exact, key), F.element_at(exact, key))
    for part, label in FEATURE_PARTS:
        out = out.when(key.contains(part), label)
    return out.otherwise(OTHER_FEATURE)


def impact_level(score: Column | str) -> Column:
    s = F.abs(F.coalesce(_c(score), F.lit(0.0)))
    return F.when(s >= 0.04, "mạnh").when(s >= 0.02, "vừa").otherwise("nhẹ")


# Phrases for readers in place of technical ones, and phrases that ask back.
_PLAINER = (("tác động ngược chiều", "tạo áp lực lên"), ("tác động cùng chiều", "hỗ trợ"), ("tác động trung tính", "ảnh hưởng chưa rõ"), ("tác động tiêu cực", "gây áp lực"), ("tác động tích cực", "hỗ trợ"))
_ASKING = ("bạn muốn", "bạn có thể cho", "vui lòng cho tôi biết", "mã cổ phiếu nào", "bạn đang hỏi về")
GENERIC_FEATURE = "một số chỉ tiêu tài chính"


def for_readers(message: Column | str) -> Column:
    """A message without feature names, technical phrases and Markdown marks; line breaks stay."""
    name = "\\b[a-zA-Z]+(?:_[a-zA-Z0-9]+)+\\b"
    label = lambda x: F.when(feature_label(x).contains("một số chỉ tiêu"), GENERIC_FEATURE).otherwise(feature_label(x))
    labels = F.transform(F.regexp_extract_all(_c(message), F.lit(name), 0), label)
    out = F.array_join(F.zip_with(F.split(_c(message), name), labels, lambda rest, found: F.concat(rest, F.coalesce(found, F.lit("")))), "")
    for phrase, plain in _PLAINER:
        out = F.regexp_replace(out, f"(?iu)(?U)\\b{phrase}\\b", plain)
    for marked in ("\\*\\*(.+?)\\*\\*", "\\*(.+?)\\*", "__(.+?)__", "(?U)(?<!\\w)_(.+?)_(?!\\w)"):
        out = F.regexp_replace(out, marked, "$1")
    out = F.regexp_replace(out, "(?m)^#{1,6}\\s+", "")
    out = F.regexp_replace(out, f"\\(\\s*{GENERIC_FEATURE}\\s*\\)", "")
    return strip(F.regexp_replace(out, "[ \\t]{2,}", " "))


def asks_back(message: Column | str) -> Column:
    """Whether a reply asks for more instead of answering."""
    m = strip(F.coalesce(_c(message), F.lit("")))
    return m.endswith("?") | F.lower(m).rlike("|".join(_ASKING))


def raw_input(x: Column | str, most: int = 4000) -> Column:
    """Text of a user without NUL and carriage returns, trimmed and cut."""
    return F.substring(strip(F.translate(_c(x), "\x00\r", "  ")), 1, most)


def safe_file_name(name: Column | str, fallback: Column | str) -> Column:
    """A PDF's file name of letters, digits, dots, dashes and single underscores."""
    plain = F.regexp_replace(F.try_url_decode(F.regexp_replace(F.coalesce(_c(name), F.lit("")), "\\+", "%2B")), "[?#].*$", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(plain), "[^A-Za-z0-9._-]+", "_"), "_+", "_"), "^[._]+|[._]+$", "")
    found = F.coalesce(F.nullif(plain, F.lit("")), _c(fallback))
    return F.when(F.lower(found).endswith(".pdf"), found).otherwise(F.concat(found, F.lit(".pdf")))


def file_name_of_url(url: Column | str, fallback: Column | str) -> Column:
    path = F.regexp_replace(F.regexp_replace(_c(url), "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return safe_file_name(F.regexp_extract(path, "([^/]*)/*$", 1), fallback)


def with_unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Of equal names in ``order``, the second and later ones get _1, _2 and so on before their suffix."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    numbered = F.concat(F.regexp_replace(name, "\\.[^.]*$", ""), F.lit("_"), F.col("__n").cast("string"), F.regexp_extract(name, "(\\.[^.]*)$", 1))
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") == 0, F.col(name)).otherwise(numbered)).drop("__n")
