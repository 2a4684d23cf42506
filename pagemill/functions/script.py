"""Column functions on the script of tokens: Latin, Cyrillic, and letters that look alike in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import char_class, contains_any, count_of, digits, letters, symbols

#: Fixed pairs of letters that look the same (Unicode confusables), Latin and Cyrillic in the same places.
LATIN_LOOKS = "ABCEHKMOPTXYaceopxyk"
CYRILLIC_LOOKS = "АВСЕНКМОРТХУасеорхук"
#: Further pairs that are alike only in poor images.
LATIN_ROUGH, CYRILLIC_ROUGH = "NURu", "ИЦЯи"
#: Those that are alike in capitals, Latin and Cyrillic: what fusion counts.
FUSION_LOOKS = (LATIN_LOOKS[:12], CYRILLIC_LOOKS[:12])
LATIN, CYRILLIC = r"\p{IsLatin}", r"\p{IsCyrillic}"
#: Parts of addresses and paths: tokens that hold one are never rewritten.
PROTECTED = ["://", "www.", "@", "\\", ".com", ".org", ".net", ".exe", ".dll", ".zip", ".json"]


def script_counts(t: Column, latin_looks: str = LATIN_LOOKS, cyrillic_looks: str = CYRILLIC_LOOKS) -> dict[str, Column]:
    """Letters of each script, those of them that look alike in the other, and digits; fusion counts fewer look-alikes (FUSION_LOOKS)."""
    return {
        "latin": count_of(t, LATIN),
        "cyrillic": count_of(t, CYRILLIC),
        "latin_alike": count_of(t, char_class(latin_looks)),
        "cyrillic_alike": count_of(t, char_class(cyrillic_looks)),
        "digit": digits(t),
    }


def with_counts(df: DataFrame, token: str = "norm_text", prefix: str = "_", codes: bool = True) -> DataFrame:
    """``df`` with the counts as columns, so that what is built on them does not count again; codes: whether short codes are protected."""
    return df.withColumns({f"{prefix}{k}": v for k, v in script_counts(F.col(token)).items()} | {f"{prefix}protected": is_protected(F.col(token), codes=codes)})


def counts_in(prefix: str = "_") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("latin", "cyrillic", "latin_alike", "cyrillic_alike", "digit", "protected")}


def _counts(t: Column) -> dict[str, Column]:
    return script_counts(t) | {"protected": is_protected(t)}


def analysis_counts(t: Column) -> dict[str, Column]:
    """What analysis counts in a token: all look-alikes, and no short codes among the protected."""
    return script_counts(t) | {"protected": is_protected(t, codes=False)}


def is_protected(t: Column, terms: list[str] | None = None, codes: bool = True, names: list[str] | None = None) -> Column:
    """An address, a path, a mail name, or a short code in capitals and digits.

    terms: what such a token holds instead of PROTECTED; codes: whether short codes count, as in correction, or not, as
    in analysis and fusion; names: tokens that count if they equal one, whatever the case.
    """
    named = F.lower(t).isin(*[n.lower() for n in names]) if names else F.lit(False)
    if not codes:
        return contains_any(t, PROTECTED if terms is None else terms) | named
    code = (F.length(t) <= 4) & t.rlike(r"^[A-Z0-9]*[0-9][A-Z0-9]*$")
    return contains_any(t, PROTECTED if terms is None else terms) | named | code


def is_mixed(t: Column) -> Column:
    """Both scripts in one token."""
    return t.rlike(LATIN) & t.rlike(CYRILLIC)


def is_corrupted(t: Column, least: int = 4, c: dict[str, Column] | None = None, stray: bool = False) -> Column:
    """Both scripts in a token that is long enough to tell and no address or path; with ``stray`` a short one counts too if it holds a symbol."""
    c = c or _counts(t)
    long = F.length(t) >= least
    return (c["latin"] > 0) & (c["cyrillic"] > 0) & (long | (symbols(t) > 0) if stray else long) & ~c["protected"]


def is_corrupted_reading(t: Column, least: int = 4, stray: bool = False) -> Column:
    """``is_corrupted`` as fusion has it, with no short codes among the protected; it asks for scripts and counts none."""
    long = F.length(t) >= least
    return t.rlike(CYRILLIC) & t.rlike(LATIN) & (long | (symbols(t) > 0) if stray else long) & ~is_protected(t, codes=False)


def is_clean(t: Column, script: str = CYRILLIC, other: str = LATIN) -> Column:
    return t.rlike(script) & ~t.rlike(other)


def looks_cyrillic(t: Column, c: dict[str, Column] | None = None) -> Column:
    """All letters Latin, yet all of them look-alikes, three at least: perhaps misread Cyrillic."""
    c = c or _counts(t)
    return (c["latin"] >= 3) & (c["cyrillic"] == 0) & (c["latin"] == c["latin_alike"]) & ~c["protected"]


def looks_latin(t: Column, c: dict[str, Column] | None = None) -> Column:
    c = c or _counts(t)
    return (c["cyrillic"] >= 3) & (c["latin"] == 0) & (c["cyrillic"] == c["cyrillic_alike"]) & ~c["protected"]


def character_class(c: Column) -> Column:
    """Of a single character: which of seven classes it is in."""
    return (
        F.when(c.rlike(char_class(LATIN_LOOKS)), "latin_alike")
        .when(c.rlike(LATIN), "latin")
        .when(c.rlike(char_class(CYRILLIC_LOOKS)), "cyrillic_alike")
        .when(c.rlike(CYRILLIC), "cyrillic")
        .when(c.rlike(r"\p{L}"), "letter")
        .when(c.rlike(r"\p{Nd}"), "digit")
        .otherwise("other")
    )


def token_script(t: Column) -> Column:
    """latin, cyrillic or none by the majority of letters; a tie is mixed."""
    a, b = count_of(t, LATIN), count_of(t, CYRILLIC)
    return F.when((a == 0) & (b == 0), "none").when(a > b, "latin").when(b > a, "cyrillic").otherwise("mixed")


def compatible(a: Column, b: Column) -> Column:
    """Scripts that may stand in one word."""
    return (a == "none") | (b == "none") | (a == b)


def to_cyrillic(t: Column, rough: bool = False) -> Column:
    """Look-alikes into Cyrillic, and a zero between Cyrillic letters into the letter O."""
    out = F.translate(t, LATIN_LOOKS + (LATIN_ROUGH if rough else ""), CYRILLIC_LOOKS + (CYRILLIC_ROUGH if rough else ""))
    return F.regexp_replace(out, rf"(?<={CYRILLIC})0(?={CYRILLIC})", "О")


def to_latin(t: Column, rough: bool = False) -> Column:
    return F.translate(t, CYRILLIC_LOOKS + (CYRILLIC_ROUGH if rough else ""), LATIN_LOOKS + (LATIN_ROUGH if rough else ""))


def cleaned(t: Column, c: dict[str, Column] | None = None) -> Column:
    """A mixed token in the script of its telling letters, if only one script has any; else as it is."""
    c = c or script_counts(t)
    telling_latin, telling_cyrillic = c["latin"] - c["latin_alike"], c["cyrillic"] - c["cyrillic_alike"]
    mixed = (c["latin"] > 0) & (c["cyrillic"] > 0)
    return F.when(~mixed, t).when((telling_cyrillic > 0) & (telling_latin == 0), to_cyrillic(t)).when((telling_latin > 0) & (telling_cyrillic == 0), to_latin(t)).otherwise(t)


def technical_latin(t: Column) -> Column:
    """Look-alikes into Latin where a digit, dot, slash or dash stands beside them: versions and file names."""
    return F.when(t.rlike(r"[\d./\\_-]") & t.rlike(CYRILLIC) & ~t.rlike(rf"[{CYRILLIC}&&[^{CYRILLIC_LOOKS}]]"), to_latin(t)).otherwise(t)


def skeleton(t: Column) -> Column:
    """Lower-case Latin skeleton: look-alikes and digits as the letters they resemble, other characters dropped."""
    return F.regexp_replace(F.translate(F.lower(to_latin(t)), "0135", "olss"), "[^a-z]", "")


def may_turn(t: Column) -> Column:
    """Holds a Cyrillic letter, or Latin ones that are all look-alikes: no other token has a script that is in doubt."""
    return t.rlike(CYRILLIC) | (t.rlike(char_class(LATIN_LOOKS)) & ~t.rlike(rf"[{LATIN}&&[^{LATIN_LOOKS}]]"))


def own_script(t: Column, c: dict[str, Column] | None = None) -> Column:
    """What a token itself says of the script it should have: the one of its telling letters, ``open`` where a doubtful token has none, null: leave it."""
    c = c or _counts(t)
    telling_latin, telling_cyrillic = c["latin"] - c["latin_alike"], c["cyrillic"] - c["cyrillic_alike"]
    doubtful = ((c["latin"] > 0) & (c["cyrillic"] > 0)) | looks_cyrillic(t, c) | looks_latin(t, c)
    return (
        F.when(~doubtful, None)
        .when((telling_cyrillic > 0) & (telling_latin == 0), "cyrillic")
        .when((telling_latin > 0) & (telling_cyrillic == 0), "latin")
        .when((telling_latin == 0) & (telling_cyrillic == 0), "open")
    )


def context_script(line: Column, document: Column, margin: float = 1.5) -> Column:
    """The script that prevails in a line, or else in its document, by ``margin``; line, document: structs with latin and cyrillic weights."""
    favours = lambda w, a, b: w[a] > w[b] * margin
    return (
        F.when(favours(line, "cyrillic", "latin"), "cyrillic")
        .when(favours(line, "latin", "cyrillic"), "latin")
        .when(favours(document, "cyrillic", "latin"), "cyrillic")
        .when(favours(document, "latin", "cyrillic"), "latin")
    )


def dominance(latin: Column, cyrillic: Column, ratio: float = 1.6) -> Column:
    """Of character counts: none, the one that prevails by ``ratio``, else mixed."""
    return (
        F.when((latin == 0) & (cyrillic == 0), "none")
        .when(cyrillic >= latin * ratio, "cyrillic")
        .when(latin >= cyrillic * ratio, "latin")
        .otherwise("mixed")
    )


def has_letters(t: Column) -> Column:
    return letters(t) > 0
