"""How sources of a language differ in the words they use: distances of all pairs of sources, and the words each has more of than its language.

Terms are counted by language and source; those in `least` documents of their language are kept, and each (language, source) gives each of them
a smoothed share p, a whole number. The distance of two sources is the sum of |p - p'| over all kept terms, which are split in two:

  * heavy terms, those of more than LIGHT sources, fill dense numpy tiles of TERMS terms by twice GROUPS sources;
  * light terms are few to a source. If none were shared, all would follow from how often each source has each count, as a term that a
    source lacks has one share there (`zero`): |p - zero'| for a source's own terms, |zero - zero'| for the others. What is wrong about
    that for terms that two sources share is added up over pairs of postings of one term, LIGHT * (LIGHT - 1) / 2 at most.

Both sums are whole numbers, so adding them gives the distance exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, map_batches, whole_text

LEAST_DOCS, FIRST_TERMS, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Sources of a light term at most; sources and terms of a tile.
LIGHT, GROUPS, TERMS = 8, 128, 2048
#: Bytes of a text that are split at once, distinct terms that a worker holds before it sends their counts.
BYTES, HELD = 1 << 22, 1 << 19
#: A-Z to a-z; bytes of no term to spaces.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "lang string, source string, term string, number long, docs long"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    text, at = text.translate(_FOLDED), 0
    while at < len(text):
        end = len(text) if len(text) - at <= BYTES or (cut := text.find(b" ", at + BYTES)) < 0 else cut
        yield text[at:end].split()
        at = end


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, number, docs): how often a group has a term, and in how many documents. Null texts, languages and sources are empty ones."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        number: dict[tuple, Counter] = {}
        there: dict[tuple, Counter] = {}
        size = 0
        for text, *group in zip(*(c.to_pylist() if k else c for k, c in enumerate(batch.columns))):
            own, found = number.setdefault(group := tuple(group), Counter()), set()
            for terms in _pieces(text.as_py().encode()):
                own.update(terms)
                found.update(terms)
            there.setdefault(group, Counter()).update(found)
            size += len(found)
            if size > HELD:
                yield made(number, there)
                number, there, size = {}, {}, 0
        yield made(number, there)

    def made(number: dict[tuple, Counter], there: dict[tuple, Counter]) -> dict:
        groups = [g for g, x in number.items() for _ in range(len(x))]
        terms = pa.array([t for x in number.values() for t in x], pa.binary()).cast(pa.string())
        return {"lang": [g[0] for g in groups], "source": [g[1] for g in groups], "term": terms, "number": [n for x in number.values() for n in x.values()], "docs": [there[g][t] for g, x in number.items() for t in x]}

    rows = map_batches(docs.select(whole_text(text_col), whole_text(lang_col), whole_text(source_col)), each, _COUNTED)
    return rows.groupBy("lang", "source", "term").agg(F.sum("number").alias("number"), F.sum("docs").alias("docs"))


def share(number: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (number + SMOOTH) / (total + SMOOTH * terms)) in decimals, so nothing overflows or is rounded; null without terms."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10)) * CAST({number} + {SMOOTH} AS DECIMAL(20)) div nullif(CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20)), 0)")


def _tile_rows(posted: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of tiles (lang, block, i, j): block -1 has light terms, i and j are blocks of sources. A row is a source with its zero (kind 0),
    a posting (kind 1) or how many light terms of a source have a share (kind 2); it goes to all tiles that its source is in."""
    sized = lambda x: x.join(sizes, "lang")
    columns = "lang", "block", "kind", "at", "term", "p", "times"
    own = sized(groups).select("lang", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "at", F.lit("").alias("term"), F.col("zero").alias("p"), F.col("light").alias("times"), "sources")
    heavy = sized(posted.where(F.col("spread") > LIGHT)).select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"), "at", "term", "p", F.lit(0).cast("long").alias("times"), "sources")
    light = sized(posted.where(F.col("spread") <= LIGHT).groupBy("lang", "at", "p").agg(F.count("*").alias("times"))).select("lang", F.lit(-1).cast("long").alias("block"), F.lit(2).alias("kind"), "at", F.lit("").alias("term"), "p", "times", "sources")
    rows = own.unionByName(heavy).unionByName(light)
    block = F.floor(F.col("at") / GROUPS)
    rows = rows.select(*columns, block.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / GROUPS))).alias("other"))
    return rows.select(*columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _tile(table: pa.Table) -> pa.Table:
    """Distances of the sources a < b of one tile by its terms."""
    kind, at, p, times = (table[c].to_numpy() for c in ("kind", "at", "p", "times"))
    i, j, block, lang = (table[c][0].as_py() for c in ("i", "j", "block", "lang"))
    known = {int(a): k for k, a in enumerate(np.unique(at[kind == 0]))}
    place = np.array([known[int(a)] for a in at], np.int64)
    zero = np.zeros(len(known), np.int64)
    zero[place[kind == 0]] = p[kind == 0]
    names = np.array(sorted(known), np.int64)
    first, second = np.flatnonzero(names // GROUPS == i), np.flatnonzero(names // GROUPS == j)
    if block >= 0:
        terms = np.unique(table["term"].filter(pa.array(kind == 1)).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)[1]
        full = np.repeat(zero[None, :], terms.max() + 1 if len(terms) else 0, axis=0)
        full[terms, place[kind == 1]] = p[kind == 1]
        apart = [np.abs(full[:, second] - full[:, [a]]).sum(axis=0) for a in first]
    else:
        light = int(times[kind == 0][0])
        one = np.abs(zero[:, None] - zero[None, :])
        more = np.zeros_like(one)
        for a, x, n in zip(place[kind == 2], p[kind == 2], times[kind == 2]):
            more[a] += n * (np.abs(x - zero) - one[a])
        apart = (light * one + more + more.T)[np.ix_(first, second)]
    a, b = (x.ravel() for x in np.meshgrid(names[first], names[second], indexing="ij"))
    value = np.concatenate([np.zeros(0, np.int64), *apart]) if len(first) else np.zeros(0, np.int64)
    once = a < b
    return pa.table({"lang": pa.array([lang] * int(once.sum()), pa.string()), "a": a[once], "b": b[once], "value": value[once]})


def _shared_light(posted: DataFrame) -> DataFrame:
    """What pairs of postings of one light term add."""
    held = posted.where((F.col("spread") <= LIGHT) & (F.col("spread") > 1)).groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "zero")).alias("x"))
    pairs = "flatten(transform(x, a -> transform(filter(x, b -> b.at > a.at), b -> struct(a.at AS a, b.at AS b, abs(a.p - b.p) - abs(a.p - b.zero) - abs(b.p - a.zero) + abs(a.zero - b.zero) AS value))))"
    return held.select("lang", F.explode(F.expr(pairs)).alias("x")).groupBy("lang", "x.a", "x.b").agg(F.sum("x.value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, first_terms: int = FIRST_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: item is another source of the language, value the distance. Part `term`: item is
    a kept term that the source has and with a greater share than its language, value by how much; the first first_terms of a source. Ranks by value, falling, then item by its bytes.

    Null texts, languages and sources are empty ones. Every (lang, source) that occurs has its pairs, without terms too; in a language without
    kept terms all distances are 0. Repeated rows count as often as they come. No documents give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    last = Scratch(spark, lasting=True)
    of = Window.partitionBy("lang", "term")
    with Scratch(spark) as work:
        numbers = counted(docs, text_col, lang_col, source_col).withColumns({"of_lang": F.sum("docs").over(of), "lang_number": F.sum("number").over(of), "spread": F.count("*").over(of), "leads": F.col("source") == F.min("source").over(of)})
        kept = work.keep("kept", numbers.where(F.col("of_lang") >= least_docs).drop("of_lang", "docs"))
        totals = kept.groupBy("lang", "source").agg(F.sum("number").alias("n"))
        is_light, lead = F.col("spread") <= LIGHT, F.col("leads").cast("long")
        langs = kept.groupBy("lang").agg(F.sum("number").alias("lang_n"), F.sum(lead).alias("v"), F.sum(F.when(is_light, lead).otherwise(0)).alias("light"))
        there = docs.select(whole_text(lang_col).alias("lang"), whole_text(source_col).alias("source")).distinct()
        groups = there.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
        groups = groups.withColumn("zero", F.coalesce(share("0", "n", "v"), F.lit(0))).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        groups = work.keep("groups", groups)
        posted = kept.join(groups.select("lang", "source", "n", "v", "lang_n", "zero", "at"), ["lang", "source"]).withColumns({"p": share("number", "n", "v"), "q": share("lang_number", "lang_n", "v")})
        posted = work.keep("posted", posted.select("lang", "source", "term", "spread", "zero", "at", "p", "q"))
        sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("light").alias("light"), F.ceil(F.max(F.col("v") - F.col("light")) / TERMS).alias("blocks"))
        tiles = _tile_rows(posted, groups.drop("light"), sizes).groupBy("lang", "block", "i", "j").applyInArrow(_tile, "lang string, a long, b long, value long")
        apart = work.keep("apart", tiles.unionByName(_shared_light(posted)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
        both = apart.unionByName(apart.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        one, two = (groups.select("lang", F.col("at").alias(at), F.col("source").alias(name)) for at, name in (("a", "source"), ("b", "item")))
        pairs = both.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        terms = posted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return last.keep("audit", pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= first_terms)))
