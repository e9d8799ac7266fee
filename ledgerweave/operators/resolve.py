"""Entity resolution with three outcomes: resolved, ambiguous, or unresolved with a reason.

Every ladder is a chain of left joins to indexes with one row for each name and the number of its candidates, so a
name never multiplies rows. Reference lists of ministries are small by nature and are broadcast only below LOCAL_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import SENTINELS
from .lineage import cut

LOCAL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has no more than LOCAL_ROWS rows; it is counted up to that number only."""
    return F.broadcast(df) if df.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS else df


def index(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(name, candidates, value): the number of rows of each name, and its value if there is only one."""
    found = rows.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("candidates"), F.min(value).alias("_v"))
    return found.select(name, "candidates", F.when(F.col("candidates") == 1, F.col("_v")).alias(value))


def by_unique_name(rows: DataFrame, name: str, names: DataFrame, key: str, value: str) -> DataFrame:
    """rows with resolved (value of the one candidate) and reason (AMBIGUOUS, NO_CANDIDATE or null)."""
    found = index(names, key, value).select(F.col(key).alias("_name"), F.col("candidates").alias("_n"), F.col(value).alias("resolved"))
    joined = rows.join(found, rows[name] == F.col("_name"), "left")
    return joined.withColumn("reason", F.when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("_n").isNull(), "NO_CANDIDATE")).drop("_name", "_n")


def laws_by_title(laws: DataFrame) -> DataFrame:
    """(title, candidates, law_id) over titles and abbreviations; a law counts once for each of its names."""
    titles = laws.select("law_id", F.explode(F.concat(F.array("law_title"), F.coalesce("abbrev", F.array().cast("array<string>")))).alias("title"))
    return index(titles, "title", "law_id")


def basis_laws(citations: DataFrame, laws: DataFrame) -> DataFrame:
    """citations(law_id, law_title, ...) with resolved, method and reason, key.

    A law_id decides alone: one that is unknown is NO_CANDIDATE and its title isn't tried. Otherwise the title, then the title without
    a trailing full-width note. Citations with neither are out of scope: resolved, method and reason are null.
    """
    known = laws.select(F.col("law_id").alias("_known")).distinct()
    titles = laws_by_title(laws)
    at = lambda p: titles.select(F.col("title").alias(f"{p}_title"), F.col("candidates").alias(f"{p}_n"), F.col("law_id").alias(f"{p}_law"))
    given, title = F.coalesce("law_id", F.lit("")), F.coalesce("law_title", F.lit(""))
    rows = citations.withColumns({"_given": given, "_title": title, "_bare": T.without_wide_note(title)})
    rows = rows.join(known, F.col("_given") == F.col("_known"), "left")
    rows = rows.join(at("_a"), (F.col("_title") == F.col("_a_title")) & (F.col("_given") == ""), "left")
    rows = rows.join(at("_b"), (F.col("_bare") == F.col("_b_title")) & (F.col("_given") == "") & (F.col("_bare") != F.col("_title")), "left")
    by_id, a, b = F.col("_given") != "", F.col("_a_n"), F.col("_b_n")
    none = (F.col("_given") == "") & (F.col("_title") == "")
    method = F.when(by_id & F.col("_known").isNotNull(), "law_id").when(~by_id & (a == 1), "title_raw").when(~by_id & a.isNull() & (b == 1), "title_stripped")
    reason = F.when(none | method.isNotNull(), F.lit(None)).when(by_id, "NO_CANDIDATE").when((a > 1) | (a.isNull() & (b > 1)), "AMBIGUOUS").otherwise("NO_CANDIDATE")
    resolved = F.when(method == "law_id", F.col("_known")).when(method == "title_raw", F.col("_a_law")).when(method == "title_stripped", F.col("_b_law"))
    key = F.when(reason.isNotNull(), F.when(by_id, F.col("_given")).when(a.isNull() & (b > 1), F.col("_bare")).otherwise(F.col("_title")))
    return rows.select(*[F.col(f"`{c}`") for c in citations.columns], resolved.alias("resolved"), method.alias("method"), reason.alias("reason"), key.alias("key"))


def recipients(lines: DataFrame, numbers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """lines(payee, corp_no, is_bundled, ...) with recipient, method, reason and category.

    In this order: bundled rows aren't tried; a sentinel number is no corporation; a number that numbers(corp_no) lacks doesn't exist; a
    known number resolves; without a number the normalised name must have one candidate in names(name_key, corp_no).
    """
    known = numbers.select(F.col("corp_no").alias("_known")).distinct()
    rows = lines.withColumn("_number", F.when(~F.col("is_bundled") & (F.coalesce("corp_no", F.lit("")) != ""), F.col("corp_no")))
    rows = rows.join(known, F.col("_number") == F.col("_known"), "left")
    if names is None:
        rows = rows.withColumns({"_n": F.lit(None).cast("bigint"), "_named": F.lit(None).cast("string")})
    else:
        found = index(names, "name_key", "corp_no").select(F.col("name_key").alias("_key"), F.col("candidates").alias("_n"), F.col("corp_no").alias("_named"))
        rows = rows.withColumn("_own", F.when(F.col("_number").isNull() & ~F.col("is_bundled"), T.without_corporate_words(F.col("payee")))).join(found, F.col("_own") == F.col("_key"), "left")
    sentinel = F.col("_number").isin(*SENTINELS)
    untried = F.col("is_bundled") | F.coalesce(sentinel, F.lit(False)) | (F.col("_number").isNotNull() & F.col("_known").isNull())
    method = F.when(untried, F.lit(None)).when(F.col("_number").isNotNull(), "houjin_bangou").when(F.col("_n") == 1, "name")
    reason = F.when(untried | method.isNotNull(), F.lit(None)).when(F.col("_n") > 1, "AMBIGUOUS").otherwise("NO_CANDIDATE")
    category = F.when(F.col("is_bundled"), "bundled").when(untried, "sentinel_or_nonexistent_houjin_bangou").when(method.isNotNull(), "resolved").otherwise("unresolved")
    recipient = F.when(method == "houjin_bangou", F.col("_number")).when(method == "name", F.col("_named"))
    return rows.select(*[F.col(f"`{c}`") for c in lines.columns], recipient.alias("recipient"), method.alias("method"), reason.alias("reason"), category.alias("category"))


def jurisdictions(laws: DataFrame, ministries: DataFrame, old: DataFrame, abolished: DataFrame) -> DataFrame:
    """(law_id, name, outcome, resolved) for each ministry that a law's number names.

    outcome: resolved (one current ministry), AMBIGUOUS, resolved_abolished, OLD_MINISTRY, OBSOLETE_ORGANIZATION (the form of an organ), NO_CANDIDATE, or
    EXTRACTION_FAILED for a number that should hold a name. Laws whose numbers hold none give no row.
    """
    named = laws.select("law_id", T.ministries_of(F.col("law_num")).alias("m")).where("m.status <> 'none'")
    named = named.select("law_id", F.col("m.status").alias("status"), F.explode_outer("m.names").alias("name"))
    current = small(index(ministries, "name", "corp_no").withColumnsRenamed({"name": "_current", "candidates": "_n"}))
    rows = named.join(current, F.col("name") == F.col("_current"), "left")
    rows = rows.join(small(old.select(F.col("name").alias("_old")).distinct()), F.col("name") == F.col("_old"), "left").join(small(abolished.select(F.col("name").alias("_abolished")).distinct()), F.col("name") == F.col("_abolished"), "left")
    outcome = F.when(F.col("status") == "failed", "EXTRACTION_FAILED").when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("_abolished").isNotNull(), "resolved_abolished").when(F.col("_old").isNotNull(), "OLD_MINISTRY")
    outcome = outcome.when(T.looks_like_organ(F.col("name")), "OBSOLETE_ORGANIZATION").otherwise("NO_CANDIDATE")
    return rows.select("law_id", "name", outcome.alias("outcome"), F.when(outcome == "resolved", F.col("corp_no")).when(outcome == "resolved_abolished", F.col("name")).alias("resolved"))


def _unique(condition: Column, message: str, *parts: Column) -> Column:
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit(message), *parts)).cast("boolean"))


def old_ministries(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, row_index, mechanism) for rows(row_index, old_name) and targets(name): equal, or a target after another target as prefix.

    A join on the remainder after each possible prefix length, not on all pairs. Two rows for a target or two targets for a row raise.
    """
    names = targets.select("name").distinct()
    exact = rows.join(names, F.col("old_name") == F.col("name")).select(F.col("name").alias("target"), "row_index", F.lit("exact").alias("mechanism"))
    rest = rows.join(exact.select("row_index"), "row_index", "left_anti").where(F.length("old_name") > 1)
    cut = rest.select("row_index", "old_name", F.explode(F.sequence(F.lit(1), F.length("old_name") - 1)).alias("k")).select("row_index", F.expr("left(old_name, k)").alias("prefix"), F.expr("substring(old_name, k + 1)").alias("target"))
    parts = cut.join(names.withColumnRenamed("name", "prefix"), "prefix").join(names.withColumnRenamed("name", "target"), "target")
    found = exact.unionByName(parts.select("target", "row_index", F.concat(F.lit("prefix-decomposition("), "prefix", F.lit(")")).alias("mechanism")))
    by_target = found.groupBy("target").agg(F.count("*").alias("n"), F.first("row_index").alias("row_index"), F.first("mechanism").alias("mechanism"))
    by_target = by_target.where(_unique(F.col("n") == 1, "several rows for", F.col("target")))
    by_row = by_target.groupBy("row_index").agg(F.count("*").alias("n"), F.first("target").alias("target"), F.first("mechanism").alias("mechanism"))
    return by_row.where(_unique(F.col("n") == 1, "several names for row", F.col("row_index").cast("string"))).select("target", "row_index", "mechanism")


def successors(names: DataFrame, references: DataFrame, most: int | None = None) -> DataFrame:
    """(name, successor, mechanism) for names(name): equal to a reference, or what is left after taking references off its head, again and again.

    A loop of joins, one for each part, until no name is open (each round shortens the rest, and every third is kept as a table); names still open after most rounds raise, and so do
    several possible heads. Names that aren't resolved are left out.
    """
    known = references.select(F.col("name").alias("ref")).distinct()
    left = names.select("name", F.col("name").alias("rest"), F.array().cast("array<string>").alias("heads"))
    done, rounds = None, 0
    while done is None or not left.isEmpty():
        if rounds == most:
            raise ValueError(f"names are open after {most} rounds")
        rounds += 1
        hit = left.join(known, F.col("rest") == F.col("ref"))
        mechanism = F.when(F.size("heads") == 0, "exact").otherwise(F.concat(F.lit("suffix-decomposition("), F.array_join("heads", "+"), F.lit(")")))
        now = hit.select("name", F.col("rest").alias("successor"), mechanism.alias("mechanism"))
        done = now if done is None else done.unionByName(now)
        open_ = left.join(known, F.col("rest") == F.col("ref"), "left_anti").where(F.length("rest") > 1)
        heads = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("rest") - 1))).withColumn("ref", F.expr("left(rest, k)")).join(known, "ref")
        one = heads.groupBy("name", "rest").agg(F.count("*").alias("n"), F.first("ref").alias("ref"), F.first("heads").alias("heads"))
        one = one.where(_unique(F.col("n") == 1, "several heads of", F.col("rest")))
        left = one.select("name", F.expr("substring(rest, length(ref) + 1)").alias("rest"), F.concat("heads", F.array("ref")).alias("heads"))
        left = cut(left) if rounds % 3 == 0 else left
    return done
