"""Text expressions. Every function takes and returns Columns; no Python runs on rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\u4e00-\u9fff]"
#: Patterns and word lists that results depend on.
RAW_RUNS = r"([\u4e00-\u9fff]+|[A-Za-z0-9_]+)"
KEYWORD_RUNS = r"([\u4e00-\u9fff]+|[A-Za-z0-9]+)"
FILE_TYPE = r"(?i)\.(pdf|docx?|odt|ods)$"
CITED_FILE_TYPE = r"(?i)\.(docx?|pdf|odt|ods|xlsx?)$"
FORM_TAG = "表單"
SCHEDULE_WORDS = ("課表", "課程表")
EMPTY_ANSWERS = (
    "很抱歉，我目前在資料庫中找不到相關資訊，無法回答您的問題。",
    "查無相關資訊。",
    "查無最新消息。",
    "未知工具或查無資訊。",
    "No relevant information found.",
)
BLANK_REPLY = "目前沒有查到明確答案，如果您提供更具體的名稱、年份、場地或公告關鍵字，我可以再幫您整理更接近的資訊。"
EMPTY_REPLY = "目前我沒有查到明確答案，不過如果您告訴我更具體的名稱、年份、場地、表單或公告關鍵字，我可以再幫您整理更接近的資訊。"
TROUBLE_PREFIX = "很抱歉，目前系統在處理這個問題時遇到了一點狀況"
TROUBLE_REPLY = "目前這個問題我暫時沒有整理出完整答案，但我可以再依照更具體的關鍵字幫您查詢相關資訊。"


def strip(text: Column) -> Column:
    """Removes white space of any script from both ends (``trim`` knows the space only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def raw_tokens(text: Column) -> Column:
    """Runs of CJK or of word characters as written: the asymmetric query form."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_RUNS), F.lit(1))


def index_tokens(text: Column) -> Column:
    """Word runs in lower case; CJK runs as character bigrams, a single character as itself."""

    def pieces(run: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^{CJK}"), bigrams).otherwise(F.array(F.lower(run)))

    # Texts without CJK, most of them in other scripts, need no pieces.
    plain = F.transform(raw_tokens(text), lambda run: F.lower(run))
    return F.when(has_cjk(text), F.flatten(F.transform(raw_tokens(text), pieces))).otherwise(plain)


def keyword_tokens(text: str) -> list[str]:
    return re.findall(KEYWORD_RUNS, text.lower())


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty *part*."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def total_occurrences(text: Column, tokens: Sequence[str]) -> Column:
    """Sum over *tokens*; a repeated token counts again."""
    return sum((occurrences(text, F.lit(t)) * n for t, n in Counter(tokens).items()), F.lit(0).cast("long"))


def to_day(date: Column) -> Column:
    """The day of a date kept as text (2024 / 3 / 05, 2024-03-05); null where there is none."""
    return F.try_to_timestamp(F.regexp_replace(strip(date), r"\s*[/-]\s*", "-"), F.lit("y-M-d")).cast("date")


def message_id() -> Column:
    """A new id for each row: 32 hex digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def title_key(title: Column) -> Column:
    """Title without one trailing file type and without any white space: the metadata join's key."""
    bare = F.regexp_replace(strip(title), FILE_TYPE, "")
    return F.regexp_replace(bare, r"(?U)\s+", "")


def citation_key(title: Column) -> Column:
    """Title without leading numbering and trailing file type, as answers cite it."""
    bare = F.regexp_replace(title, r"(?U)^[\d.、\s]+", "")
    return F.regexp_replace(bare, CITED_FILE_TYPE, "")


def clean_markup(text: Column) -> Column:
    """Text without tags, bold marks and link targets, trimmed."""
    bare = F.regexp_replace(text, r"<[^>]+>", "")
    bare = F.regexp_replace(bare, r"\*\*([^*]+)\*\*", "$1")
    bare = F.regexp_replace(bare, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return strip(bare)


def decode_url(text: Column) -> Column:
    """Percent-decoding that keeps plus signs and escapes that are none."""
    return F.url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def tag_kind(tags: Column) -> Column:
    """(category, type) of a tag list."""
    form = F.coalesce(F.contains(tags, F.lit(FORM_TAG)), F.lit(False))
    return F.struct(
        F.when(form, F.lit(FORM_TAG)).otherwise(F.lit("法規")).alias("category"),
        F.when(form, F.lit("form")).otherwise(F.lit("regulation")).alias("type"),
    )


def is_schedule(title: Column, body: Column) -> Column:
    tests = [F.contains(F.coalesce(c, F.lit("")), F.lit(w)) for c in (title, body) for w in SCHEDULE_WORDS]
    return tests[0] | tests[1] | tests[2] | tests[3]


def names_year(title: Column, body: Column, date: Column, year: int) -> Column:
    """Whether a text names a Gregorian year, in either calendar, or is dated in it."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    dated = F.coalesce(F.startswith(date, F.lit(str(year))), F.lit(False))
    return F.contains(text, F.lit(str(year))) | F.contains(text, F.lit(str(year - 1911))) | dated


def both_years(year: Column) -> Column:
    """(roc, ad) of a year in either calendar; nulls unless the text is all digits."""
    number = F.when(strip(year).rlike(r"^[0-9]+$"), strip(year).cast("long"))
    late = number > 1911
    return F.struct(F.when(late, number - 1911).otherwise(number).cast("string").alias("roc"), F.when(late, number).otherwise(number + 1911).cast("string").alias("ad"))


def rewrite_years(text: Column, compat: bool = False) -> Column:
    """ROC years as Gregorian ones, dropping the unit. ``compat`` also takes the last digits of longer numbers."""
    edge = "" if compat else r"(?<![0-9])"

    def pass_over(value: Column, unit: str) -> Column:
        pattern = rf"(?:民國)?(?U:\s*){edge}([0-9]{{2,3}})(?U:\s*){unit}"
        found = F.regexp_extract_all(value, F.lit(pattern), F.lit(1))
        between = F.split(value, pattern, -1)
        years = F.transform(found, lambda y: (y.cast("long") + 1911).cast("string"))
        return F.array_join(F.flatten(F.zip_with(between, years, lambda b, y: F.array(F.coalesce(b, F.lit("")), F.coalesce(y, F.lit(""))))), "")

    return pass_over(pass_over(text, "年"), "學年")


def academic_year(day: Column) -> Column:
    """ROC academic year, which begins in August."""
    return F.year(day) - 1911 - F.when(F.month(day) >= 8, 0).otherwise(1)


def soften(answer: Column) -> Column:
    """Friendlier words for answers that found nothing; others stay as they are."""
    bare = strip(answer)
    return (
        F.when(answer.isNull() | (bare == ""), F.lit(BLANK_REPLY))
        .when(bare.isin(*EMPTY_ANSWERS), F.lit(EMPTY_REPLY))
        .when(F.startswith(bare, F.lit(TROUBLE_PREFIX)), F.lit(TROUBLE_REPLY))
        .otherwise(answer)
    )


def mentions_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs, in any case; none of no phrases."""
    if not phrases:
        return F.lit(False)
    pattern = "(?iu)" + "|".join(rf"\Q{p}\E" for p in phrases)
    return F.coalesce(text.rlike(pattern), F.lit(False))


def bar(part: Column, whole: Column, width: int = 28) -> Column:
    """A bar of *width* cells filled in proportion."""
    filled = F.coalesce(F.try_divide(part * width, whole), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
