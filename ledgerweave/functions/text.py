"""Text as the sources write it: amounts, names, law numbers, dates and truth values."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for kinds of corporation that a normalised name leaves out, eras and numerals of law numbers.
CORPORATE_WORDS = ("株式会社", "有限会社", "合同会社", "合名会社", "合資会社", "(株)", "(有)", "(合)")
ERAS = "令和|平成|昭和|大正|明治"
NUMERALS = "[〇一二三四五六七八九十百千元]+"
ORGAN_ENDINGS = "省|府|庁|院|委員会"
ORGAN_WORDS = ("人事院", "閣")
#: Fixed values too: what a law number begins with, the form of an ordinance's number, and of a rule's once its date is gone.
DATED = f"^(?:{ERAS}){NUMERALS}年"
ORDINANCE = f"{DATED}(.+?)令第.+号(?:の{NUMERALS})*$"
RULE = "^(.+?)規則"

_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def half_width_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def amount(c: Column) -> Column:
    """Yen. Empty is null, not zero; commas, full-width digits and one trailing .0 are understood, all else raises."""
    s = F.regexp_replace(F.regexp_replace(half_width_digits(strip(c)), "[,，]", ""), r"\.0$", "")
    wrong = F.raise_error(F.concat(F.lit("not an amount: "), c)).cast("bigint")
    return F.when(c.isNull() | (strip(c) == ""), F.lit(None).cast("bigint")).when(s.rlike(r"^[+-]?[0-9]+$"), s.cast("bigint")).otherwise(wrong)


def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility composition, which Spark SQL lacks: an Arrow UDF."""
    return F.pandas_udf(_nfkc, "string")(c)


def without_corporate_words(c: Column) -> Column:
    """An already composed name without spaces and kinds of corporation, taken out one after another."""
    bare = F.regexp_replace(c, "[ 　]", "")
    return reduce(lambda name, word: F.replace(name, F.lit(word), F.lit("")), CORPORATE_WORDS, bare)


def corporate_name(c: Column) -> Column:
    return without_corporate_words(nfkc(c))


def without_wide_note(c: Column) -> Column:
    """A title without a trailing full-width parenthesis."""
    return strip(F.regexp_replace(c, f"（[^（）]*）(?:{_SPACE})?$", ""))


def without_note(c: Column) -> Column:
    """A name without a trailing parenthesis of either width."""
    return strip(F.regexp_replace(c, rf"(?:（[^（）]*）|\([^()]*\))(?:{_SPACE})?$", ""))


def looks_like_organ(c: Column) -> Column:
    """Whether a name has the form of a government organ."""
    return c.rlike(f"^.+(?:{ORGAN_ENDINGS})$") | c.isin(*ORGAN_WORDS)


def ministries_of(law_num: Column) -> Column:
    """struct(status, names) from a law number: found, none (no ministry's ordinance or rule) or failed (of that form, but without a name)."""
    names = F.split(F.regexp_extract(law_num, ORDINANCE, 1), "・")
    rest = F.regexp_replace(law_num, DATED, "")
    rule = F.regexp_extract(rest, RULE, 1)
    made = lambda status, value: F.struct(F.lit(status).alias("status"), value.alias("names"))
    no_names = F.lit(None).cast("array<string>")
    single = (F.size(names) == 1) & (F.length(names[0]) == 1)
    of_ordinance = F.when(F.forall(names, looks_like_organ), made("found", names)).when(single, made("none", no_names)).otherwise(made("failed", no_names))
    of_rule = F.when(rest.rlike(RULE), made("found", F.split(rule, "・"))).when(rest.startswith("規則"), made("failed", no_names)).otherwise(made("none", no_names))
    return F.when(law_num.rlike(ORDINANCE), of_ordinance).otherwise(of_rule)


def truth(c: Column) -> Column:
    """A lexical boolean: true, 1, false, 0; anything else raises."""
    return F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(c, F.lit("null")))).cast("boolean"))


def is_corporate_number(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{13}$"), F.lit(False))


def is_bundled(flag: Column, name: Column) -> Column:
    """A row that stands for several payees: flagged, or named as others."""
    return (F.upper(strip(flag)) == "TRUE") | (strip(name) == "その他")


def content_digest(c: Column) -> Column:
    """SHA-256 with line ends taken as LF."""
    return F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


def compact_date(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def summary(kind: Column, law_num: Column, prefecture: Column, city: Column, fiscal_year: Column, ministry: Column) -> Column:
    """What a search hit says about itself: the law's number, the place, or year and ministry."""
    present = lambda c: F.when(c != "", c)
    place, year = F.concat_ws("", prefecture, city), F.concat(fiscal_year.cast("string"), F.lit("年度"))
    project = F.concat_ws("・", year, present(ministry))
    return F.when(kind == "Law", law_num).when(kind.isin("Organization", "GovernmentOrgan", "Ministry", "AbolishedGovernmentOrgan"), present(place)).when(kind == "BudgetProject", present(project))


def _grouped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")


def _whole(c: Column, unit: int) -> Column:
    """c / unit for c >= 0 as a whole number, halves upwards."""
    return F.call_function("div", c + unit // 2, F.lit(unit))


def rounded_amount(c: Column) -> Column:
    """Yen in the unit of its size: 兆 and 億 with one decimal, whole 億 from 1,000億, whole 万, or yen."""
    n, sign = F.abs(c), F.when(c < 0, "-").otherwise("")

    def tenths(unit: int) -> Column:
        t = _whole(n, unit // 10)
        return F.concat(F.call_function("div", t, F.lit(10)).cast("string"), F.lit("."), (t % 10).cast("string"))

    text = F.when(n >= 10**12, F.concat(tenths(10**12), F.lit("兆円"))).when(n >= 10**11, F.concat(_grouped(_whole(n, 10**8)), F.lit("億円"))).when(n >= 10**8, F.concat(tenths(10**8), F.lit("億円")))
    return F.concat(sign, text.when(n >= 10**4, F.concat(_whole(n, 10**4).cast("string"), F.lit("万円"))).otherwise(F.concat(_grouped(n), F.lit("円"))))


def full_amount(c: Column) -> Column:
    """Yen with thousands separated."""
    return F.concat(_grouped(c), F.lit("円"))
