"""Source divergence: how far the word use of each source is from every other source of its language, and which words set it apart.

A source's estimate of a term is p = 1 + floor(scale (count + 5) / (N + 5 V)), an integer; the distance of two sources is the sum of |p - q| over the V kept terms of
the language. Terms that many sources have are compared in dense tiles of numpy, the others by their postings alone: a term that a source hasn't got has the
same estimate everywhere, its base, so a pair's sum is V |base - base'| plus corrections for terms that one of them has. Both partial sums are exact integers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import checked_broadcast, durable, small_batches

#: Terms, over UTF-8 whose A to Z are lower-cased: all that isn't ASCII, and letters.
TERM = rb"[a-z\x80-\xff]+"
#: Terms that a task counts together before it passes them on.
HELD = 200_000
#: Rows of a tile's terms; sources of a side of a tile, on average; sources of all languages that are broadcast at most.
TILE, SIDE, SMALL = 100_000, 400, 100_000


@dataclass(frozen=True)
class Audit:
    """least_docs: terms in fewer documents of the language aren't kept. scale, prior: of the estimate. ranks: of the terms that set a source apart.
    heavy: a term is dense if more than one in so many of the language's sources has it."""

    least_docs: int = 30
    scale: int = 1_000_000_000
    prior: int = 5
    ranks: int = 50
    heavy: int = 8


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, count, docs) in parts, several rows for a term: occurrences, and documents that have it."""

    def counted(batches):
        from collections import Counter, defaultdict

        import pandas as pd

        find, held, n = re.compile(TERM).findall, defaultdict(dict), 0

        def rows():
            return pd.DataFrame([(lang, source, term.decode(), count, docs) for (lang, source), terms in held.items() for term, (count, docs) in terms.items()], columns=["lang", "source", "term", "count", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch["l"], batch["s"], batch["t"]):
                own = held[lang, source]
                n -= len(own)
                for term, count in Counter(find(text.encode().lower())).items():
                    known = own.get(term)
                    if known is None:
                        own[term] = [count, 1]
                    else:
                        known[0] += count
                        known[1] += 1
                n += len(own)
                if n > HELD:
                    yield rows()
                    held.clear()
                    n = 0
        yield rows()

    small_batches(docs.sparkSession)
    told = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "l"), (source, "s"), (text, "t"))])
    return told.mapInPandas(counted, "lang string, source string, term string, count long, docs long")


def kept_terms(counts: DataFrame, spec: Audit = Audit()) -> DataFrame:
    """(lang, source, term, count, sources, total, first) of the terms that enough documents of the language have: sources that have it, its occurrences in the language,
    and one row a term that is the first. One shuffle; what a term gathers is a row for each source and task."""
    term = W.partitionBy("lang", "term")
    cells = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    cells = cells.select("lang", "source", "term", "count", F.sum("docs").over(term).alias("docs"), F.count("*").over(term).alias("sources"), F.sum("count").over(term).alias("total"), (F.col("source") == F.min("source").over(term)).alias("first"))
    return cells.where(F.col("docs") >= spec.least_docs).drop("docs")


def estimate(count: Column, n: Column, v: Column, spec: Audit) -> Column:
    """Of a term; in decimals, as scale times count may be beyond 64 bits. Null without kept terms."""
    over = n.cast("decimal(20,0)") + v * spec.prior
    up = (count.cast("decimal(20,0)") + spec.prior) * F.lit(spec.scale).cast("decimal(12,0)")
    return F.call_function("div", up, F.when(over != 0, over)) + 1


def _tile(key, rows):
    """The pairs of a tile's sources and their sums over its terms, less what all terms would give by the bases; tile 0 adds that for every term."""
    import numpy as np
    import pandas as pd

    lang, part, left, right = key
    mark = rows["term"].isna()
    of = rows[mark].sort_values("source")
    names, base, block = of["source"].to_numpy(), of["p"].to_numpy(dtype="int64"), of["block"].to_numpy()
    cells = rows[~mark]
    group, p = pd.Index(names).get_indexer(cells["source"]), cells["p"].to_numpy(dtype="int64")
    term, dense = pd.factorize(cells["term"])[0], cells["heavy"].to_numpy(dtype=bool)
    apart = np.abs(base[:, None] - base[None, :])
    out = apart * (int(of["v"].iloc[0]) if part == 0 else 0)
    if dense.any():
        ids, column = np.unique(term[dense], return_inverse=True)
        table = np.repeat(base[:, None], len(ids), axis=1)
        table[group[dense], column] = p[dense]
        for i in range(len(names)):
            out[i] += np.abs(table - table[i]).sum(axis=1) - len(ids) * apart[i]
    group, p, term = group[~dense], p[~dense], term[~dense]
    order = np.lexsort((p, group))
    at = np.searchsorted(group[order], np.arange(len(names) + 1))
    alone = np.zeros_like(out)  # of the terms of i, as if no other source had them
    for i in range(len(names)):
        own = p[order[at[i] : at[i + 1]]]
        if n := len(own):
            sums = np.concatenate(([0], np.cumsum(own)))
            below = np.searchsorted(own, base)
            alone[i] = base * below - sums[below] + (sums[n] - sums[below]) - base * (n - below) - n * apart[i]
    out += alone + alone.T
    order = np.argsort(term, kind="stable")
    group, p, term = group[order], p[order], term[order]
    for step in range(1, len(term)):
        both = np.flatnonzero(term[step:] == term[:-step])
        if not len(both):
            break
        a, b, x, y = group[both], group[both + step], p[both], p[both + step]
        more = np.abs(x - y) - np.abs(x - base[b]) - np.abs(y - base[a]) + apart[a, b]
        np.add.at(out, (a, b), more)
        np.add.at(out, (b, a), more)
    i, j = np.triu_indices(len(names), 1)
    mine = np.sort(np.stack((block[i], block[j])), axis=0)
    mine = (mine[0] == left) & (mine[1] == right)
    i, j = i[mine], j[mine]
    return pd.DataFrame({"lang": lang, "a": names[i], "b": names[j], "value": out[i, j]})


def pair_sums(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair a < b of a language's sources, once: the tiles' sums.

    cells: lang, source, term, p, heavy, block, blocks, parts. sources: every (lang, source) with p, its base, v, block, blocks, parts. A language's terms are dealt into
    parts by hash, its sources into blocks; a tile is a part of the terms with a pair of blocks, so it has some TILE rows for each side whatever the language's share.
    """
    sides = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pair = [F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")]
    own = cells.select("lang", F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"), "source", "term", "p", F.lit(0).cast("long").alias("v"), "heavy", "block", sides)
    marks = sources.select("lang", "source", "p", "v", "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    marks = marks.select("lang", "part", "source", F.lit(None).cast("string").alias("term"), "p", "v", F.lit(False).alias("heavy"), "block", sides)
    rows = own.union(marks).select("lang", "part", "source", "term", "p", "v", "heavy", "block", *pair)
    sums = rows.groupBy("lang", "part", "left", "right").applyInPandas(_tile, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, spec: Audit = Audit(), lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: every other source of the language and its distance. Part term: terms that a source has and uses more than
    the language does, by how much, the first ranks alone. Ranks by value, the largest first, then item by UTF-8.

    Nulls are empty texts; a language without kept terms has distances 0; a source alone in its language has no pairs; an empty table gives no rows. Ties of value go by item,
    repeated rows count each for itself; texts may be of any length; other columns are not read.
    """
    kept = durable(kept_terms(term_counts(docs, lang, source, text), spec))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum(F.when(F.col("first"), F.col("total"))).alias("all"), F.count("*").alias("cells"))
    every = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    seen = every.groupBy("lang").agg(F.count("*").alias("s")).join(langs, "lang", "left").select("lang", "s", F.coalesce("v", F.lit(0)).alias("v"), "all", F.ceil(F.coalesce("cells", F.lit(0)) / TILE).alias("parts"))
    n = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    blocks = F.ceil(F.col("s") / SIDE)
    of = every.join(seen, "lang").join(n, ["lang", "source"], "left").select("lang", "source", "s", "v", "all", F.coalesce("n", F.lit(0)).alias("n"), F.greatest("parts", F.lit(1)).alias("parts"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block"))
    of = durable(of.withColumn("base", F.coalesce(estimate(F.lit(0), F.col("n"), F.col("v"), spec), F.lit(0))))
    cells = kept.join(checked_broadcast(of, SMALL), ["lang", "source"]).withColumn("p", estimate(F.col("count"), F.col("n"), F.col("v"), spec))
    dense = cells.select("lang", "source", "term", "p", (F.col("sources") * spec.heavy > F.col("s")).alias("heavy"), "block", "blocks", "parts")
    pairs = pair_sums(dense, of.select("lang", "source", F.col("base").alias("p"), "v", "block", "blocks", "parts"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = pairs.select("lang", ends, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    over = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - estimate(F.col("total"), F.col("all"), F.col("v"), spec)).alias("value")).where("value > 0")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(over.withColumn("rank", rank).where(F.col("rank") <= spec.ranks))
