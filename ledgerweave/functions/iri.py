"""Addresses of entities and graphs. BASE is a parameter of every builder's module; parts are percent-encoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "https://example.org/kg"


def quote(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and _.-~ (url_encode writes three characters otherwise)."""
    written = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        written = F.replace(written, F.lit(found), F.lit(wanted))
    return written


def _under(path: str, *parts: Column) -> Column:
    """The address of path and parts; an empty or missing part raises."""
    checked = [F.when(F.coalesce(p.cast("string"), F.lit("")) == "", F.raise_error(F.lit(f"an empty part of {path}")).cast("string")).otherwise(quote(p.cast("string"))) for p in parts]
    return F.concat_ws("/", F.lit(f"{BASE}{path}"), *checked)


def organization(corp_no: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("not a corporate number: "), F.coalesce(corp_no, F.lit("null")))).cast("string")
    return F.when(F.coalesce(corp_no.rlike("^[0-9]{13}$"), F.lit(False)), F.concat(F.lit(f"{BASE}/id/org/"), corp_no)).otherwise(wrong)


def abolished_organ(name: Column) -> Column:
    return _under("/id/org/abolished", name)


def law(law_id: Column) -> Column:
    return _under("/id/law", law_id)


def law_revision(law_id: Column, date: Column, amendment: Column) -> Column:
    """The date alone names a revision only if no amending law is known: two may come into force on one day."""
    tail = F.when(F.coalesce(amendment, F.lit("")) != "", F.concat(F.lit("_"), quote(amendment))).otherwise("")
    return F.concat(law(law_id), F.lit("/"), F.date_format(date, "yyyyMMdd"), tail)


def project(fiscal_year: Column, project_id: Column) -> Column:
    return _under("/id/budget", fiscal_year, project_id)


def expenditure(fiscal_year: Column, project_id: Column, seq: Column) -> Column:
    return F.concat(project(fiscal_year, project_id), F.lit("/"), F.when(seq >= 0, seq).otherwise(F.raise_error(F.lit("a negative number")).cast("int")).cast("string"))


def block(fiscal_year: Column, project_id: Column, block_id: Column) -> Column:
    return F.concat(project(fiscal_year, project_id), F.lit("/block/"), quote(block_id))


def annual_budget(fiscal_year: Column, project_id: Column, budget_year: Column) -> Column:
    return F.concat(project(fiscal_year, project_id), F.lit("/annual/"), quote(budget_year.cast("string")))


def indirect_cost(fiscal_year: Column, project_id: Column, item: Column) -> Column:
    return F.concat(project(fiscal_year, project_id), F.lit("/indirect-cost/"), quote(item))


def unresolved_jurisdiction(law_id: Column, name: Column) -> Column:
    """One for each law and name, so that counting them counts misses, not names."""
    return _under("/id/unresolved/jurisdiction", law_id, name)


def unresolved_ministry(name: Column) -> Column:
    return _under("/id/unresolved/ministry", name)


def unresolved_project_ministry(fiscal_year: Column, project_id: Column, name: Column) -> Column:
    return _under("/id/unresolved/budget-ministry", fiscal_year, project_id, name)


def unresolved_basis_law(fiscal_year: Column, project_id: Column, key: Column) -> Column:
    return _under("/id/unresolved/budget-basis-law", fiscal_year, project_id, key)


def unresolved_recipient(fiscal_year: Column, project_id: Column, seq: Column, key: Column) -> Column:
    return F.concat(expenditure(fiscal_year, project_id, seq), F.lit("/unresolved/"), quote(key))


def graph(source: Column, fetched_on: Column) -> Column:
    return F.concat(_under("/graph", source), F.lit("/"), F.date_format(fetched_on, "yyyy-MM-dd"))


def term(module: str, name: str) -> str:
    return f"{BASE}/def/{module}#{name}"


def local_name(c: Column) -> Column:
    """What follows the last #, or else the last slash."""
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(F.substring_index(c, "/", -1))


def id_path(c: Column) -> Column:
    """The part of an entity's address after /id/; null for addresses elsewhere."""
    head = f"{BASE}/id/"
    return F.when(c.startswith(head), F.substring(c, len(head) + 1, 1 << 30))
