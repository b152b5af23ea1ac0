"""What pages show: labels, amounts, dates, bars, highlights and their orders."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Labels and icons of funder kinds, texts for what is missing, and limits.
KIND_LABELS = {"individual": "Individual", "company": "Company", "trade union": "Trade union"}
KIND_ICONS = {"individual": "person", "company": "building", "trade union": "group", "unclassified": "question"}
NO_AMOUNT, NO_TEXT, NO_SOURCE = "Amount unavailable", "Interest text unavailable", "Source unavailable"
LONGEST_TEXT, LONGEST_PREVIEW = 16_000, 112
SHOWN_AT_ONCE, SHOWN_RECIPIENTS = 10, 5
LEGAL_ENDINGS = r"(?:Limited|Ltd\.?|plc|Inc\.?|Corporation|Corp\.?|LLC|LLP|LP|S\.A\.|N\.V\.|SA|AG|NV|SE|GmbH)(?=$|[\s,;.])"
OWNERSHIP = r"(?:\d+(?:\.\d+)? per cent holding in |\d+(?:\.\d+)? per cent ownership with partner of |Sole shareholder, |Shareholding in )"
LINKING_WORDS = ["and", "of", "the", "for", "in", "de", "&", "-"]


def kind_label(kind: Column) -> Column:
    """The label of a funder's kind; null, blank and "not specified" are unclassified."""
    text = F.trim(kind)
    low = F.lower(text)
    out = F.when(kind.isNull() | (text == "") | (low == "not specified"), "Unclassified")
    for name, label in KIND_LABELS.items():
        out = out.when(low == name, label)
    return out.otherwise(text)


def kind_icon(kind: Column) -> Column:
    low = F.lower(kind_label(kind))
    out = None
    for name, icon in KIND_ICONS.items():
        out = F.when(low == name, icon) if out is None else out.when(low == name, icon)
    return out.otherwise("tag")


def period_total(period: str, historical: Column, term: Column, year: Column) -> Column:
    """The headline of one period; any other name is an error."""
    choices = {"historical": historical, "current-term": term, "current-year": year}
    if period not in choices:
        raise ValueError(f"unknown period: {period!r}")
    return choices[period]


def shown_amount(amount: Column) -> Column:
    """A plain decimal with commas between thousands and a minus sign; null has a text."""
    text = F.regexp_replace(amount, "^-", "")
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"\B(?=(\d{3})+(?!\d))", ",")
    rest = F.when(F.instr(text, ".") > 0, F.concat(F.lit("."), F.substring_index(text, ".", -1))).otherwise("")
    return F.when(amount.isNull(), NO_AMOUNT).otherwise(F.concat(F.when(amount.startswith("-"), "−").otherwise(""), whole, rest))


def shown_pounds(amount: Column) -> Column:
    """``shown_amount`` with a pound sign and two decimals at least."""
    text = F.regexp_replace(amount, "^-", "")
    fraction = F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise("")
    padded = F.concat(fraction, F.repeat(F.lit("0"), F.greatest(F.lit(0), 2 - F.length(fraction))))
    unsigned = F.concat(F.substring_index(text, ".", 1), F.lit("."), padded)
    shown = F.concat(F.when(amount.startswith("-"), "−").otherwise(""), F.lit("£"), shown_amount(unsigned))
    return F.when(amount.isNull(), NO_AMOUNT).otherwise(shown)


def shown_date(moment: Column) -> Column:
    """Day, short month and year in UTC, such as 9 Jul 2024."""
    return F.date_format(moment.cast("timestamp_ntz"), "d MMM yyyy")


# Fixed value: what a source's timestamp looks like; its offset may be absent.
STAMP = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$"


def is_source_timestamp(text: Column) -> Column:
    """Whether a text is a timestamp as sources spell it: a real date and time, with or without an offset."""
    real = F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return F.coalesce(text.rlike(STAMP) & real, F.lit(False))


def source_timestamp_label(text: Column) -> Column:
    """The calendar date as written, then the time as written: no time zone is assumed."""
    day = F.date_format(F.substring(text, 1, 10).cast("date"), "d MMM yyyy")
    return F.concat(day, F.lit(", "), F.substring(text, 12, 1000))


def bar_widths(rows: DataFrame, amount: str, by: list[str], basis: str) -> DataFrame:
    """``rows`` with width (per cent of the group's total or maximum of magnitudes, cut off) and negative.

    A missing amount is 0 wide.  ``by`` names the group; an empty list is one
    group of the bars of one page.
    """
    digits = {"total": 8, "maximum": 2}[basis]
    size = F.coalesce(F.abs(F.col(amount)), F.lit(0)).cast("decimal(26,4)")
    out = rows.withColumn("_size", size)
    out = out.withColumn("_whole", (F.sum("_size") if basis == "total" else F.max("_size")).over(Window.partitionBy(*by)))
    # An integral division: the quotient is exact before it is cut off.
    out = out.withColumn("_size", F.col("_size") * F.lit(100 * 10**digits).cast("decimal(11,0)"))
    width = F.when(F.col("_whole") == 0, F.lit(0.0)).otherwise(F.expr("_size div nullif(_whole, 0)") / 10**digits)
    negative = F.coalesce(F.col(amount) < 0, F.lit(False))
    return out.withColumn("width", width.cast("double")).withColumn("negative", negative).drop("_size", "_whole")


def update_order(latest: Column, name: Column, key: Column, newest: bool = True) -> list[Column]:
    """Updates by time, then by name without case and accents, by name and by key."""
    return [latest.desc_nulls_last() if newest else latest.asc_nulls_last(), F.collate(name, "UNICODE_CI_AI").asc(), name.asc(), key.asc()]


def source_order(amount: Column, name: Column, key: Column) -> list[Column]:
    """Money sources: largest first, unknown amounts last, then by name and key; a source without a name has a text."""
    return [amount.desc_nulls_last(), F.collate(F.coalesce(name, F.lit(NO_SOURCE)), "UNICODE").asc(), F.coalesce(key.cast("string"), F.lit("")).asc()]


def placed(rows: DataFrame, order: list[Column], within: list[str], first: int | None = None) -> DataFrame:
    """``rows`` with their place in ``order`` within a group, the first ``first`` of them if given."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    return out if first is None else out.filter(F.col("place") <= first)


def batch_of(rows: DataFrame, order: list[Column], batches: int = 1, size: int = SHOWN_AT_ONCE) -> DataFrame:
    """What "show more" shows after ``batches`` batches: that many of the first rows, one at least."""
    return rows.orderBy(*order).limit(max(1, batches) * size)


def page_of(total: int, page: int, size: int = SHOWN_AT_ONCE) -> int:
    """``page`` clamped to the pages there are; no rows have one page."""
    return min(max(1, page), max(1, -(-total // size)))


def highlights(name: str, term: str) -> list[tuple[str, bool]]:
    """The name in pieces, and which of them match a word of the term, longer words first."""
    tokens = sorted(dict.fromkeys(term.split()), key=len, reverse=True)
    if not tokens:
        return [(name, False)]
    pieces = re.split("(" + "|".join(map(re.escape, tokens)) + ")", name, flags=re.IGNORECASE)
    return [(piece, bool(i % 2)) for i, piece in enumerate(pieces) if piece]


def highlighted(name: Column, term: str) -> Column:
    """``highlights`` as an array of (text, matched); null for null."""

    @F.pandas_udf("array<struct<text:string,matched:boolean>>")
    def cut(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else [{"text": t, "matched": m} for t, m in highlights(n, term)])

    return cut(name)


_ENDING = re.compile(LEGAL_ENDINGS, re.IGNORECASE)
_OWNERSHIP = re.compile("^" + OWNERSHIP)
_SEPARATOR = re.compile(r"(?:,\s*(?:and\s+)?|;\s*|\r?\n\s*|and\s+)")
_INNER = re.compile(r"[’'&.+:/%-]")


def _closing(text: str, at: int) -> int | None:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for found in re.finditer(r"[()]", text[at:]):
        depth += 1 if found.group() == "(" else -1
        if not depth:
            return at + found.end()
    return None


def _is_name_word(word: str) -> bool:
    """A capitalised word, a number, a word with a capital inside, or a linking word."""
    if word in LINKING_WORDS:
        return True
    bare = _INNER.sub("", word[1:])
    if word[:1].isupper() or word[:1].isnumeric():
        return all(c.isalpha() or c.isnumeric() for c in bare)
    return word[:1].islower() and all(c.isalpha() or c.isnumeric() for c in word) and any(c.isupper() for c in word[1:])


def holding_names(text: str) -> list[str] | None:
    """The companies that a text lists and nothing else, or None if it says more.

    Each is a run of name words up to a legal ending; remarks in brackets may
    follow it, then a separator and the next.
    """
    if len(text) > LONGEST_TEXT:
        return None
    names, start = [], 0
    while start < len(text):
        at, stop = start, None
        while at < len(text) and stop is None:
            if text[at] == "(":
                if (at := _closing(text, at)) is None:
                    return None
                continue
            if text[at] in ")\n;":
                return None
            found = _ENDING.match(text, at) if at > start and (text[at - 1].isspace() or text[at - 1] == ",") else None
            if found:
                parts = re.sub(r"[()]", " ", re.sub(r",\s*$", "", text[start:at])).split()
                if parts and all(map(_is_name_word, parts)):
                    stop = found.end()
                    break
            at += 1
        if stop is None:
            return None
        names.append(text[start:stop].strip())
        at = stop
        while True:
            at += len(text[at:]) - len(text[at:].lstrip("\t "))
            if text[at : at + 1] != "(":
                break
            if (at := _closing(text, at)) is None:
                return None
        if re.fullmatch(r"\.?\s*", text[at:]):
            return names
        gap = _SEPARATOR.match(text, at)
        if not gap or gap.end() == len(text):
            return None
        start = gap.end()
    return None


def shareholding(text: str | None) -> tuple[str, str]:
    """(kind, text) of a shareholding: its companies, a preview of the text, or that there is none."""
    source = (text or "").strip()
    if not source:
        return "missing", NO_TEXT
    names = holding_names(_OWNERSHIP.sub("", source))
    if names:
        return "labels", "; ".join(names)
    preview = re.sub(r"\s+", " ", source)
    if len(preview) <= LONGEST_PREVIEW:
        return "source-preview", preview
    return "source-preview", re.sub(r"\s+\S*$", "", preview[:LONGEST_PREVIEW]).rstrip() + "…"


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))
def shareholding_summary(texts: pd.Series) -> pd.DataFrame:
    """``shareholding`` of each text; distinct texts of a batch are read once."""
    known = {t: shareholding(t) for t in texts.dropna().unique()}
    return pd.DataFrame([known[t] if t in known else shareholding(None) for t in texts], columns=["kind", "text"])
