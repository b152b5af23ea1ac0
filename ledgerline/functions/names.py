"""Name features of funders: spellings, tokens, persons, organisations, aliases.

Spark has no Unicode normalisation, so these are plain functions on strings,
applied to whole Arrow batches by ``name_features``.  Distinct names are far
fewer than rows; the batch function computes each once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Fixed values.
WITHHELD = ["confidential", "withheld", "name withheld", "anonymous", "not disclosed"]
TITLES = ["mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame", "lord", "baron", "lady", "rev", "reverend", "rt", "hon"]
PEERAGE_TITLES = ["lord", "baron"]
LEGAL_SUFFIXES = ["public limited company", "community interest company", "limited liability partnership", "limited partnership", "limited", "ltd", "plc", "llp", "lp", "cic"]
CONNECTIVES = ["a", "an", "and", "for", "in", "of", "on", "the", "to"]
NOT_NAMES = ["and", "or", "trading", "as", "trustee", "ceo", "director", "representative", "representing", "behalf"]
ADDRESS_PLACEHOLDERS = ["withheld", "confidential", "private", "private address", "address private", "home address withheld", "confidential address", "not provided", "not-provided", "not disclosed", "address withheld", "not applicable", "n/a"]
STREET_WORDS = ["road", "rd", "street", "st", "avenue", "ave", "lane", "drive", "way", "place", "close", "terrace", "court", "crescent", "square", "gardens", "park", "mews", "boulevard", "row"]
ALIAS_MARKERS = ["trading as", "t/a"]
APOSTROPHES = "'’‘ʼ"
# White space as Unicode has it; str.split would also split at U+001C to U+001F.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

_SPACES = re.compile(f"[{SPACE}]+")
_MARKER = re.compile("|".join(rf"(?:^|(?<=[ (,]))(?:{m})(?=[{SPACE}])" for m in ALIAS_MARKERS), re.ASCII | re.IGNORECASE)
_LEGAL = re.compile(r"(?:^|\s)(?:" + "|".join(LEGAL_SUFFIXES) + r")$")


def words(text: str) -> list[str]:
    return [w for w in _SPACES.split(text) if w]


def is_mark(c: str) -> bool:
    return unicodedata.category(c).startswith("M")


def normal(raw: str) -> str:
    """NFKC, lower case letter by letter, white space collapsed."""
    return " ".join(words("".join(c.lower() for c in unicodedata.normalize("NFKC", raw))))


def unaccented(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name) if not is_mark(c))


def _is_dotted(word: str) -> bool:
    """An acronym of single letters with dots between them."""
    inner = re.sub(r"^[^\w.]+|[^\w.]+$", "", word.replace("_", " ").strip())
    return "." in inner and all(len(p) == 1 and p.isalpha() for p in inner.rstrip(".").split("."))


def tokens(name: str) -> str:
    """Words without punctuation: & is "and", apostrophes and acronyms' dots go."""
    out = []
    for word in words(name):
        if _is_dotted(word):
            word = word.replace(".", "")
        for mark in APOSTROPHES:
            word = word.replace(mark, "")
        word = word.replace("&", " and ")
        out.append("".join(c if c.isalnum() or is_mark(c) else " " for c in word))
    return " ".join(words(" ".join(out)))


def organisation_core(name: str) -> str:
    """Tokens without one legal suffix, the first listed that fits."""
    return _LEGAL.sub("", name).strip()


def initials(name: str, all_words: bool = True) -> str:
    return "".join(w[0] for w in words(name) if all_words or w not in CONNECTIVES)


def brackets(raw: str) -> tuple[list[str], bool]:
    """Texts in outermost brackets, and whether brackets are unbalanced.

    An open bracket holds the rest of the name.
    """
    out, depth, start, odd = [], 0, 0, False
    for found in re.finditer(r"[()]", raw):
        at = found.start()
        if found.group() == "(":
            start = at + 1 if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(raw[start:at])
        else:
            odd = True
    return (out + [raw[start:]], True) if depth else (out, odd)


def _marker(text: str, outside: bool) -> tuple[int, int] | None:
    """The first alias marker; ``outside`` asks for one outside of brackets."""
    for found in _MARKER.finditer(text):
        before = text[: found.start()]
        if not outside or before.count("(") == before.count(")"):
            return found.span()
    return None


def aliases(raw: str) -> list[str]:
    """Names after a "trading as": those in brackets first, then outside."""
    out: list[str] = []
    for text, outside in [*((t, False) for t in brackets(raw)[0]), (raw, True)]:
        if span := _marker(text, outside):
            alias = text[span[1] :].strip(SPACE)
            if alias and alias not in out:
                out.append(alias)
    return out


def primary_name(raw: str) -> str:
    """The name without "trading as" and what follows, in brackets or not."""
    out, at = "", 0
    depth, start = 0, 0
    for found in re.finditer(r"[()]", raw):
        if found.group() == "(":
            start = found.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth and _marker(raw[start + 1 : found.start()], False):
                out, at = out + raw[at:start] + " ", found.end()
    out += raw[at:]
    if span := _marker(out, True):
        out = out[: span[0]]
    return out.strip(SPACE).rstrip(",").strip(SPACE)


def acronym(raw: str) -> tuple[str, str] | None:
    """An acronym and its expansion, one of which is in brackets."""
    before = raw.split("(")[0].strip(SPACE)
    for inside in brackets(raw)[0]:
        for short, full in ((before, inside), (inside, before)):
            letters = "".join(c for c in short if c != "." and c not in SPACE)
            if re.fullmatch("[A-Z]{2,10}", letters) and letters.lower() == initials(tokens(normal(full)), False):
                return letters.lower(), normal(full)
    return None


def name_like(text: str) -> bool:
    """Only words of letters (with hyphens or apostrophes inside) that name someone."""
    parts = words(text)
    return bool(parts) and all(
        w not in NOT_NAMES and w[0].isalpha() and w[-1].isalpha() and all(c.isalpha() or is_mark(c) or c in "-" + APOSTROPHES for c in w) for w in parts
    )


def person(name: str) -> tuple[list[str], str | None, str]:
    """Leading titles, the rest of a normalised name, and its core tokens.

    After a title, "(given) surname" loses its brackets if both are names.
    """
    parts = words(name)
    titles = []
    for w in parts:
        bare = w[:-1] if w.endswith(".") else w
        if bare not in TITLES:
            break
        titles.append(bare)
    rest = " ".join(parts[len(titles) :])
    if titles and (found := re.fullmatch(rf"\((.*?)\)(?=[{SPACE}])(.*)", rest, re.S)):
        given, surname = (g.strip(SPACE) for g in found.groups())
        if name_like(given) and name_like(surname):
            rest = f"{given} {surname}"
    core = tokens(name).split()
    while core and core[0] in TITLES:
        core.pop(0)
    return titles, rest or None, " ".join(core)


def peerage(raw: str | None) -> dict | None:
    """The spelling of a person's name, and what a peer's "style of place (person)" joins.

    Null for what is no plain name and no complete bridge: one peerage title, a
    personal name of two full words at least that ends with the style's own.
    """
    if raw is None:
        return None
    titles, rest, _ = person(normal(raw))
    peer = len(titles) == 1 and titles[0] in PEERAGE_TITLES
    if not rest or (" of " in rest and not peer):
        return None
    none = dict.fromkeys(("style", "full_style", "personal"))
    if name_like(rest):
        return {"spelling": rest, **none}
    found = re.fullmatch(r"(?P<stem>.+?) of (?P<place>[^(]+?) \((?P<personal>[^()]+)\)", rest)
    if not peer or not found:
        return None
    stem, place, whole = (found[k].strip(SPACE) for k in ("stem", "place", "personal"))
    given = words(whole)
    if not all(map(name_like, (stem, place, whole))) or len(given) < 2 or min(map(len, given)) < 2 or not whole.endswith(f" {stem}"):
        return None
    return {"spelling": f"{stem} of {place} ({whole})", "style": f"{stem} of {place}", "full_style": f"{whole} of {place}", "personal": whole}


_PEERAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("spelling", "style", "full_style", "personal")])


@F.pandas_udf(_PEERAGE)
def _peerage_batch(raw: pd.Series) -> pd.DataFrame:
    known = {name: peerage(name) for name in raw.dropna().unique()}
    empty = dict.fromkeys(_PEERAGE.fieldNames())
    return pd.DataFrame([known.get(name) or empty for name in raw], columns=list(empty), dtype=object)


def peerage_name(raw):
    """``peerage`` as a struct column, null where it is (Column)."""
    found = _peerage_batch(raw)
    return F.when(found["spelling"].isNotNull(), found)


def features(raw: str | None) -> dict:
    """All features of one name; what needs a usable name is null without one."""
    name = None if raw is None else normal(raw)
    status = "missing" if not name else "withheld" if name in WITHHELD else "present"
    inside, odd = brackets(raw or "")
    out: dict = dict.fromkeys(f.split()[0] for f in SCHEMA.split(", "))
    out |= {"name_raw": raw, "name_status": status, "brackets": inside, "unbalanced_brackets": odd, "has_and": False, "aliases": [], "alias_normalized": [], "titles": []}
    if status != "present":
        return out
    plain = tokens(name)
    core = organisation_core(tokens(normal(primary_name(raw))))
    titles, person_name, person_core = person(name)
    short = acronym(raw)
    also = aliases(raw)
    return out | {
        "name_normalized": name, "name_accent_folded": unaccented(name), "name_tokens": plain, "token_key": " ".join(sorted(plain.split())),
        "has_and": "and" in plain.split(), "primary_name": normal(primary_name(raw)), "organisation_core": core, "organisation_initials": initials(core, False),
        "titles": titles, "person_name": person_name, "person_core": person_core, "person_initials": initials(person_core),
        "acronym": short and short[0], "acronym_expansion": short and short[1], "aliases": also, "alias_normalized": [normal(a) for a in also],
    }


SCHEMA = (
    "name_raw string, name_status string, name_normalized string, name_accent_folded string, name_tokens string, token_key string, has_and boolean, "
    "primary_name string, organisation_core string, organisation_initials string, titles array<string>, person_name string, person_core string, "
    "person_initials string, acronym string, acronym_expansion string, aliases array<string>, alias_normalized array<string>, brackets array<string>, "
    "unbalanced_brackets boolean"
)


def name_features(df: DataFrame, column: str = "name") -> DataFrame:
    """``df`` with the features of a name column; null and repeated names are fine."""
    schema = T.StructType(list(df.schema.fields))
    for field in SCHEMA.split(", "):
        name, kind = field.split()
        schema = schema.add(name, {"string": "string", "boolean": "boolean"}.get(kind) or T.ArrayType(T.StringType()))

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known = {raw: features(raw) for raw in set(part[column].dropna())}
            missing = features(None)
            rows = [known.get(raw, missing) if isinstance(raw, str) else missing for raw in part[column]]
            extra = pd.DataFrame(rows, index=part.index, columns=[f.split()[0] for f in SCHEMA.split(", ")], dtype=object)
            yield pd.concat([part, extra], axis=1)

    return df.mapInPandas(batch, schema)


def address_normal(raw: str | None) -> str | None:
    """A comparable address, or null for none and for placeholders."""
    if raw is None:
        return None
    text = " ".join(words(unicodedata.normalize("NFKC", raw).lower()))
    return None if not text or text in ADDRESS_PLACEHOLDERS else text


def address_quality(normalized):
    """"numbered_street" if it has a house number and a street word (Column)."""
    bare = F.transform(F.split(normalized, " "), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    number = F.exists(bare, lambda t: t.rlike("^[0-9](?=[0-9]*[A-Za-z]?[0-9]*$)"))
    street = F.exists(bare, lambda t: t.isin(STREET_WORDS))
    return F.when(normalized.isNull(), "unavailable").when(number & street, "numbered_street").otherwise("partial")


def address_key(normalized):
    """Letters and digits alone, one space between (Column)."""
    return F.trim(F.regexp_replace(F.lower(normalized), r"[^\p{L}\p{N}]+", " "))


def company_number(kind, number):
    """Eight letters and digits with a digit; only for companies or unknown kinds (Column)."""
    code = F.upper(F.btrim(number, F.lit(" \t\n\x0c\r")))
    fits = code.rlike("^(?=.*[0-9])[A-Z0-9]{8}$") & (kind.isNull() | (F.lower(F.trim(kind)) == "company"))
    return F.when(fits, code)
