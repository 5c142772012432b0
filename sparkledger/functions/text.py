"""Text, money and rate expressions. Everything here is a native Column, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "\\u4e00-\\u9fff"
MONEY_TYPE = "decimal(28,10)"

# Rate words that stand for "no tax", as written on invoices.
EXEMPT_WORDS = ("免税", "不征税", "免征增值税")
# Names too general to code a line by.
GENERIC_NAMES = ("服务费", "费用", "货款", "商品", "产品", "材料", "材料费", "货物")
WEAK_NAMES = ("代理服务", "服务", "服务费", "业务服务", "代理", "财税服务")
UNCODED_NAMES = ("代理服务", "服务", "服务费", "业务服务")
# Business words counted as tokens.
BUSINESS_WORDS = ("代理", "记账", "税务", "申报", "咨询", "服务", "财税", "办公", "纸", "文件", "医疗", "器械")
# Words marking a line that a person must look at.
LOW_CONFIDENCE_MARKERS = ("兜底", "异常", "需人工复核", "未命中", "OCR", "视觉", "样票", "历史")
REVIEW_MARKERS = LOW_CONFIDENCE_MARKERS + ("智能赋码调用失败", "智能赋码返回结果未命中")


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# The characters of Unicode's White_Space, which patterns call (?U)\\s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column | str) -> Column:
    """Trim any Unicode white space; null becomes ''. Only the ends are looked at, where a pattern tries every place."""
    return F.trim(F.coalesce(_c(value), F.lit("")), F.lit(WHITE))


def squeeze(value: Column | str) -> Column:
    """Drop every white-space character."""
    return F.regexp_replace(F.coalesce(_c(value), F.lit("")), f"[{WHITE}]+", "")


def plain_percent(text: Column) -> Column:
    """The wide percent sign as the plain one."""
    return F.replace(text, F.lit("％"), F.lit("%"))


def is_blank(value: Column | str) -> Column:
    return strip(value) == ""


def or_none(value: Column | str) -> Column:
    """Null where the text is blank."""
    return F.when(~is_blank(value), _c(value))


def first_filled(*values: Column | str, default: str = "") -> Column:
    """First non-blank text."""
    return F.coalesce(*[or_none(v) for v in values], F.lit(default))


def contains_any(value: Column | str, words) -> Column:
    text = _c(value)
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


# --- match keys -----------------------------------------------------------------------------

def alias_key(value: Column | str) -> Column:
    """Digits, Latin letters and Han characters only, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(_c(value), F.lit("")), f"[^0-9A-Za-z{HAN}]+", ""))


def search_key(value: Column | str) -> Column:
    return F.lower(F.regexp_replace(strip(value), "[ \\u3000]", ""))


def compact_key(value: Column | str) -> Column:
    return F.upper(F.replace(squeeze(value), F.lit("，"), F.lit(",")))


def candidate_key(value: Column | str) -> Column:
    """Letters and digits of any script, upper case."""
    return F.regexp_replace(F.upper(F.coalesce(_c(value), F.lit(""))), r"[^\p{L}\p{N}]", "")


def subject_key(value: Column | str) -> Column:
    """Company name without the part after '/', and without 15-20 character ids."""
    head = F.upper(F.element_at(F.split(F.coalesce(_c(value), F.lit("")), "/"), 1))
    return F.regexp_replace(F.regexp_replace(head, "[0-9A-Z]{15,20}", ""), r"[^\p{L}\p{N}]", "")


def bigrams(value: Column | str) -> Column:
    """Character pairs in order; the whole value where it is shorter than two."""
    text = _c(value)
    size = F.length(text)
    return (
        F.when(size >= 2, F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))
        .when(size == 1, F.array(text))
        .otherwise(F.array().cast("array<string>"))
    )


def business_tokens(value: Column | str) -> Column:
    """Distinct alphanumeric runs and known business words of a text."""
    text = compact_key(value)
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    words = F.filter(F.array(*[F.lit(w) for w in BUSINESS_WORDS]), lambda w: text.contains(w))
    return F.array_distinct(F.concat(runs, words))


# --- names ----------------------------------------------------------------------------------

def is_generic_name(value: Column | str) -> Column:
    return squeeze(value).isin(*GENERIC_NAMES)


def is_weak_name(value: Column | str) -> Column:
    return compact_key(value).isin(*WEAK_NAMES)


def is_uncoded_name(value: Column | str) -> Column:
    """Names never coded from the category tree on their own."""
    return squeeze(value).isin(*UNCODED_NAMES)


def is_low_confidence_name(value: Column | str) -> Column:
    text = strip(value)
    short_code = ~text.rlike(f"[{HAN}]") & (F.length(F.regexp_replace(text, "[^A-Za-z0-9]+", "")) <= 6)
    return (text == "") | text.rlike("[|/=:_]") | short_code


def allows_context_match(value: Column | str) -> Column:
    """A rule seen only in the surrounding text may code this line."""
    return is_blank(value) | is_generic_name(value) | is_low_confidence_name(value)


# --- money and rates ------------------------------------------------------------------------

def parse_money(value: Column | str) -> Column:
    """Decimal of a money text; null when it is not a number."""
    return F.regexp_replace(strip(value), "[,，￥¥]", "").try_cast(MONEY_TYPE)


def money_text(amount: Column, half_even: bool = False) -> Column:
    """Two decimals as text, '' for null."""
    rounded = F.bround(amount, 2) if half_even else F.round(amount, 2)
    return F.coalesce(rounded.cast("decimal(38,2)").cast("string"), F.lit(""))


def resolved_amount(amount: Column | str, quantity: Column | str, price: Column | str) -> Column:
    """Stated amount, else quantity x price, rounded half up; null when neither is known."""
    product = parse_money(quantity) * parse_money(price)
    return F.round(F.coalesce(parse_money(amount), product), 2).cast("decimal(18,2)")


def cut_zeros(text: Column) -> Column:
    """Drop trailing zeros behind a decimal point."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def percent_text(number: Column) -> Column:
    return F.concat(cut_zeros(F.round(number, 2).cast("decimal(38,2)").cast("string")), F.lit("%"))


def canonical_rate(value: Column | str, default: str = "3%") -> Column:
    """Rate as written on the invoice: '13%', '3%', or an exempt word."""
    text = plain_percent(strip(value))
    number = parse_money(text)
    return (
        F.when(text == "", F.lit(default))
        .when(text.isin(*EXEMPT_WORDS) | text.endswith("%") | number.isNull(), text)
        .otherwise(percent_text(F.when(number <= 1, number * 100).otherwise(number)))
    )


def rate_number(value: Column | str) -> Column:
    """Rate as a fraction; 0 for exempt words, null when unreadable."""
    text = plain_percent(strip(value))
    is_percent = text.endswith("%")
    number = F.when(is_percent, F.regexp_replace(text, "%$", "")).otherwise(text).try_cast(MONEY_TYPE)
    return (
        F.when(text.isin(*EXEMPT_WORDS), F.lit(0).cast("decimal(32,14)"))
        .when(is_percent | (number > 1), (number / 100).cast("decimal(32,14)"))
        .otherwise(number.cast("decimal(32,14)"))
    )


def sheet_rate(value: Column | str) -> Column:
    """Rate as an import sheet wants it: '0.13', '0', 13 decimals at most."""
    text = plain_percent(strip(value))
    number = F.regexp_replace(text, "%$", "").try_cast(MONEY_TYPE)
    return (
        F.when(text == "", F.lit(""))
        .when(text.isin(*EXEMPT_WORDS), F.lit("0"))
        .when(number.isNull(), F.regexp_replace(text, "%$", ""))
        .otherwise(cut_zeros(F.round(rate_number(text), 13).cast("decimal(32,13)").cast("string")))
    )


def rate_key(value: Column | str) -> Column:
    """Key by which two rate texts are the same rate ('1%' equals '0.01')."""
    text = plain_percent(strip(value))
    number = rate_number(text)
    return F.when(text.isin(*EXEMPT_WORDS) | number.isNull(), text).otherwise(
        cut_zeros((number * 100).cast("decimal(30,8)").cast("string"))
    )


# Wording that states a rate, first hit wins.
STATED_RATES = (
    ("免税", "(免税|免征增值税|不征税)"),
    ("1%", "(一个点|1个点|一%|1%|税率1|按1点|开1点)"),
    ("3%", "(三个点|3个点|三%|3%|税率3|按3点|开3点)"),
    ("6%", "(六个点|6个点|六%|6%|税率6|按6点|开6点)"),
    ("9%", "(九个点|9个点|九%|9%|税率9|按9点|开9点)"),
    ("13%", "(十三个点|13个点|十三%|13%|税率13|按13点|开13点)"),
)


def stated_rate(value: Column | str, compact: bool = False) -> Column:
    """Rate a request text states, '' when it states none; ``compact`` says the text is a compact key already."""
    text = _c(value) if compact else compact_key(value)
    out = F.when(~text.rlike("[%点税免]"), "")
    for rate, pattern in STATED_RATES:
        out = out.when(text.rlike(pattern), rate)
    return out.otherwise("")


def number_text(value: Column | str) -> Column:
    """Plain number without trailing zeros; other text is kept."""
    number = parse_money(value)
    return F.coalesce(cut_zeros(number.cast("string")), strip(value))


# --- sheet fields ---------------------------------------------------------------------------

# Texts that say yes and no, and the display options of the import sheet.
YES_WORDS = ("true", "yes", "y", "1", "on")
NO_WORDS = ("false", "no", "n", "0", "off")
SHOW_BOTH = "展示地址、电话、开户银行及银行账号"
SHOW_ADDRESS = "展示地址、电话"
SHOW_BANK = "展示开户银行、银行账号"
SHOW_NONE = ("否", "不展示", "无需展示", "无", "0")


def invoice_kind(value: Column | str) -> Column:
    return F.when(strip(value).rlike("专票|专用"), "增值税专用发票").otherwise("普通发票")


def yes_no(value: Column | str, default: str = "否") -> Column:
    text = strip(value)
    return (
        F.when(text.isin("是", "否"), text)
        .when(F.lower(text).isin(*YES_WORDS), "是")
        .when(F.lower(text).isin(*NO_WORDS), "否")
        .otherwise(default)
    )


def contact_display(value, address, phone, bank, account) -> Column:
    """Which contact fields the invoice shows."""
    text = strip(value)
    has_address = ~is_blank(address) | ~is_blank(phone)
    has_bank = ~is_blank(bank) | ~is_blank(account)
    return (
        F.when(text.isin(SHOW_BOTH, SHOW_ADDRESS, SHOW_BANK), text)
        .when(text.isin(*SHOW_NONE), "")
        .when(has_address & has_bank, SHOW_BOTH)
        .when(has_address, SHOW_ADDRESS)
        .when(has_bank, SHOW_BANK)
        .otherwise("")
    )


def tax_id_needs_review(value: Column | str) -> Column:
    text = F.regexp_replace(F.upper(F.coalesce(_c(value), F.lit(""))), "[^0-9A-Z]", "")
    return ~F.length(text).isin(15, 18, 20) | ((F.length(text) == 18) & text.rlike("[IOSVZ]"))


def tax_id_unreliable(value: Column | str) -> Column:
    text = F.upper(squeeze(value))
    few = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda ch: ch != ""))) <= 4
    return (F.length(text) != 18) | few | text.rlike("^(0{6}|1{6}|2{6}|3{6}|4{6}|5{6}|9{6})")


# --- aliases --------------------------------------------------------------------------------

def split_aliases(value: Column | str, pattern: str = r"[\\/、,，]+") -> Column:
    """Alias text to a distinct list in order, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(_c(value), F.lit("")), pattern), strip)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def buyer_aliases(name: Column | str) -> Column:
    """Ways a buyer is called: full name, core name, first four and last two to four characters."""
    full = _c(name)
    core = strip(F.regexp_replace(full, "(有限责任公司|股份有限公司|有限公司|公司)$", ""))
    size = F.length(core)
    parts = [full, F.when(size >= 1, core), F.when(size >= 4, F.substring(core, 1, 4))]
    for n in (4, 3, 2):
        parts.append(F.when(size >= n, F.right(core, F.lit(n))))
    return F.array_distinct(F.filter(F.array_compact(F.array(*parts)), lambda a: F.length(a) >= 2))


def merge_alias_list(left: Column | str, right: Column | str) -> Column:
    """Two alias texts as one list, first spelling of each key kept."""
    parts = split_aliases(F.concat_ws("、", _c(left), _c(right)))
    keys = F.transform(parts, alias_key)
    kept = F.filter(parts, lambda p, i: F.array_position(keys, alias_key(p)) == i + 1)
    return F.array_join(kept, "、")


def merge_name_list(left: Column | str, right: Column | str) -> Column:
    """Two name lists joined by '、' as one distinct list."""
    return F.array_join(split_aliases(F.concat_ws("、", _c(left), _c(right)), "[、,，]"), "、")


def append_source(left: Column | str, right: Column | str) -> Column:
    """Two ';' lists as one distinct list."""
    return F.array_join(split_aliases(F.concat_ws(";", _c(left), _c(right)), ";"), ";")


# --- Chinese numerals -----------------------------------------------------------------------

# Capital and small forms of the numerals, the values and the units.
NUMERAL_FROM = "两壹贰叁肆伍陆柒捌玖拾佰仟〇"
NUMERAL_TO = "二一二三四五六七八九十百千零"
DIGITS = "零一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 100000000}


def chinese_amount(value: Column | str) -> Column:
    """Chinese numerals to an integer text, '' when the text is none."""
    text = F.translate(strip(value), NUMERAL_FROM, NUMERAL_TO)
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    digit_of = F.create_map(*[F.lit(x) for i, d in enumerate(DIGITS) for x in (d, i)])
    unit_of = F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u, n)])

    def long(x):
        return F.lit(x).cast("bigint") if not isinstance(x, Column) else x.cast("bigint")

    start = F.struct(long(0).alias("total"), long(0).alias("section"), long(0).alias("number"), long(1).alias("unit"))

    def step(acc, ch):
        digit, unit = F.try_element_at(digit_of, ch), F.try_element_at(unit_of, ch)
        big = unit >= 10000
        one = F.when(acc["number"] == 0, long(1)).otherwise(acc["number"])
        return F.when(
            digit.isNotNull(),
            F.struct(acc["total"].alias("total"), acc["section"].alias("section"), long(digit).alias("number"), acc["unit"].alias("unit")),
        ).otherwise(
            F.struct(
                F.when(big, acc["total"] + (acc["section"] + acc["number"]) * unit).otherwise(acc["total"]).alias("total"),
                F.when(big, long(0)).otherwise(acc["section"] + one * unit).alias("section"),
                long(0).alias("number"),
                long(unit).alias("unit"),
            )
        )

    def finish(acc):
        tail = F.when(acc["unit"].isin(1000, 10000, 100000000), acc["number"] * F.floor(acc["unit"] / 10)).otherwise(acc["number"])
        return acc["total"] + acc["section"] + tail

    folded = F.aggregate(chars, start, step, finish)
    plain = F.translate(text, DIGITS, "0123456789").try_cast("bigint").cast("string")
    return (
        F.when(~text.rlike(f"^[{DIGITS}十百千万亿]+$"), "")
        .when(text.rlike(f"^[{DIGITS}]+$"), plain)
        .otherwise(F.when(folded > 0, folded.cast("string")).otherwise(""))
    )
