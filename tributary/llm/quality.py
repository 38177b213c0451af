"""Quality rules whose thresholds are controlled for risk.

Labelled documents are split in two by a hash. On one half, a stratum proposes rules and cutoffs, one rule after another. That makes a chain of ever
stricter sets of rules: each rule's cutoffs from the lenient end to the proposed one, beside all rules before it. On the other half, exact binomial
tests go along the chain: each must show that the whole set, not a rule alone, rejects at most ``alpha`` of the stratum's good documents. The last set
before the first that fails is the stratum's. A chain that is fixed beforehand and left at its first failure needs no correction within; across strata the level is
divided (Bonferroni). So the chance that any stratum loses more than ``alpha`` of its good documents is at most ``delta``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import checked_broadcast, durable, small_batches

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

#: Rules: a document is rejected if the measure is at least the cutoff, or at most where the cutoffs fall below the usual. Lenient ones first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": (">=", (4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeat_share": (">=", (0.3, 0.275, 0.25, 0.225, 0.2, 0.15, 0.1)),
    "dup_lines_per_word": (">=", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": (">=", (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.0)),
    "short_words": ("<=", (1.0, 1.5, 2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0, 4.25)),
}


@dataclass(frozen=True)
class Risk:
    """alpha: part of a stratum's good documents that its rules together may reject. delta: chance that any stratum breaks that. price: bad
    documents that rejecting a good one must bring. worth: part of the stratum's bad documents that a rule must bring. seed: of the hash that splits the labels. strata: so many strata may be broadcast."""

    alpha: float = 0.02
    delta: float = 0.05
    price: int = 50
    worth: float = 0.05
    seed: int = 17
    strata: int = 5000


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    gaps = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= WINDOW:
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *[e + 1 for e in ends[:-1]]]
        windows = [joined[a:b] for a, b in zip(starts, ends[WINDOW - 1 :])]
        if len(set(windows)) < len(windows):
            seen, covered = Counter(windows), 0
            for i, x in enumerate(windows):
                if seen[x] > 1:
                    repeated += i + WINDOW - max(i, covered)
                    covered = i + WINDOW
    return n, len(text) - gaps, symbols, len(lines) - len(set(lines)), repeated


def with_base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, row (the text's hash), and the base counts of each row. A null text has no words; a null stratum is one of its own, apart from the empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([base_counts(t) for t in batch["text"].tolist()], columns=[x.split()[0] for x in BASE.split(", ")], dtype="int64")
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            made.insert(1, "stratum", batch["stratum"])
            made.insert(2, "row", batch["row"])
            yield made

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), stratum_of(stratum).alias("stratum"), F.xxhash64(text).alias("row"), F.col(text).alias("text")).mapInPandas(run, f"doc_id long, stratum string, row long, {BASE}")


def stratum_of(stratum: str) -> Column:
    return F.col(stratum).cast("string")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    length = F.col("word_chars") / n
    return {"symbols_per_word": F.col("n_symbols") / n, "long_words": length, "short_words": length, "dup_lines_per_word": F.col("n_dup_lines") / n, "repeat_share": F.col("n_repeat_words") / n}


def rejects(rule: str, measure: Column, cutoff: Column | float) -> Column:
    return measure >= cutoff if RULES[rule][0] == ">=" else measure <= cutoff


def certified(rejected: int, good: int, alpha: float, delta: float) -> bool:
    """Whether rejected of good documents show, at level delta, that at most alpha of all are: the exact one-sided binomial test,
    that is, whether the upper Clopper-Pearson bound is at most alpha. Terms are added from the largest down until they no longer matter."""
    if good <= 0 or rejected >= alpha * good:
        return False
    log_first = math.lgamma(good + 1) - math.lgamma(rejected + 1) - math.lgamma(good - rejected + 1) + rejected * math.log(alpha) + (good - rejected) * math.log1p(-alpha)
    term = total = 1.0
    for k in range(rejected, 0, -1):
        term *= k * (1 - alpha) / ((good - k + 1) * alpha)
        total += term
        if term < 1e-17 * total:
            break
    return log_first + math.log(total) <= math.log(delta)


#: A step of a chain: a rule and the places of its cutoffs that are in it.
PLACES = [(rule, i) for rule, (_, cutoffs) in RULES.items() for i in range(len(cutoffs))]


def propose(counts: list[tuple[int, int]], chosen: dict[str, int], bad: int, risk: Risk) -> tuple[str, int] | None:
    """The rule, of those not chosen yet, and the place of the cutoff that gains most on the proposing half; None if none is worth it.

    counts: of each of PLACES, the bad and the good documents that it rejects and no chosen rule does. Of what gains alike, the first.
    """
    best, found = risk.worth * bad, None
    for (rule, i), (caught, wrong) in zip(PLACES, counts):
        if rule not in chosen and (gain := caught - risk.price * wrong) > best:
            best, found = gain, (rule, i)
    return found


def walk(chain: list[tuple[str, int]], rejected: dict[tuple[str, int], int], good: int, risk: Risk, strata: int) -> dict[str, int]:
    """What is left of a chain of (rule, place of its last cutoff): rules and places up to the first test that fails. rejected: of each of PLACES, good documents of the testing half that it or a rule earlier in the chain rejects."""
    kept: dict[str, int] = {}
    for rule, last in chain:
        for i in range(last + 1):
            if not certified(rejected[rule, i], good, risk.alpha, risk.delta / strata):
                return kept
            kept[rule] = i
    return kept


def _state(rows: DataFrame) -> DataFrame:
    """Of a table of strata, the columns that a join with cases brings: stratum, each rule's cutoff and its place in the chain."""
    return rows.select(F.col("stratum").alias("_s"), *[F.nanvl(F.col(f"c_{r}"), F.lit(None).cast("double")).alias(f"c_{r}") for r in RULES], *[F.col(f"o_{r}").alias(f"o_{r}") for r in RULES])


def _hit(rule: str, cutoff: Column | float) -> Column:
    return F.coalesce(rejects(rule, F.col(rule), cutoff), F.lit(False))


def thresholds(based: DataFrame, labels: DataFrame, risk: Risk = Risk(), doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """A row for each stratum that has labels: stratum and each rule's cutoff, null where it has none.

    Rules are proposed one after another, so none is there for documents that another rejects anyway. Labels of null quality or id don't count;
    a document that is labelled twice counts twice. Documents that fail the base rules are no cases. All counts are taken over all cases.
    """
    test = F.pmod(F.xxhash64(F.lit(risk.seed), "doc_id"), F.lit(2)) == 1
    cases = based.where(~base_failed()).join(labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).alias("_q")).where("_q is not null"), "doc_id")
    cases = durable(cases.select("stratum", (F.col("_q") == 1).alias("good"), test.alias("test"), *[m.alias(r) for r, m in measures().items()]))
    n_of = lambda cond: F.sum(cond.cast("long"))
    out = cases.groupBy("stratum").agg(n_of(F.col("good") & F.col("test")).alias("n_good"), n_of(~F.col("good") & ~F.col("test")).alias("n_bad"))
    out = durable(out.select("stratum", "n_good", "n_bad", *[F.lit(None).cast("double").alias(f"c_{r}") for r in RULES], *[F.lit(0).alias(f"o_{r}") for r in RULES]))
    strata = max(1, out.count())
    kinds = "stratum string, n_good long, n_bad long, " + ", ".join([f"c_{r} double" for r in RULES] + [f"o_{r} int" for r in RULES])

    def counted(cases: DataFrame, each: list[Column]) -> DataFrame:
        return out.join(cases.groupBy(F.col("stratum").alias("_s")).agg(F.array(*each).alias("counts")), F.col("stratum").eqNullSafe(F.col("_s"))).drop("_s")

    def joined(half: Column) -> DataFrame:
        return cases.where(half).join(checked_broadcast(_state(out), risk.strata), F.col("stratum").eqNullSafe(F.col("_s"))).drop("_s")

    def proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, row in batch.iterrows():
                chosen = {r: 0 for r in RULES if row[f"o_{r}"]}
                counts = list(map(int, row["counts"]))
                if found := propose(list(zip(counts[::2], counts[1::2])), chosen, int(row["n_bad"]), risk):
                    batch.at[i, f"c_{found[0]}"] = RULES[found[0]][1][found[1]]
                    batch.at[i, f"o_{found[0]}"] = len(chosen) + 1
            yield batch.drop(columns="counts")

    for step in range(len(RULES)):
        open_ = ~F.lit(False)
        for r in RULES:
            open_ = open_ & ~_hit(r, F.col(f"c_{r}"))
        each = [n_of(_hit(r, F.lit(RULES[r][1][i])) & kind) for r, i in PLACES for kind in (~F.col("good"), F.col("good"))]
        out = durable(counted(joined(~F.col("test")).where(open_), each).mapInPandas(proposed, kinds))
        if not out.where(" or ".join(f"o_{r} = {step + 1}" for r in RULES)).limit(1).count():
            break

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, row in batch.iterrows():
                rejected = dict(zip(PLACES, map(int, row["counts"])))
                order = sorted((r for r in RULES if row[f"o_{r}"]), key=lambda r: row[f"o_{r}"])
                kept = walk([(r, RULES[r][1].index(row[f"c_{r}"])) for r in order], rejected, int(row["n_good"]), risk, strata)
                for r in RULES:
                    batch.at[i, f"c_{r}"] = RULES[r][1][kept[r]] if r in kept else None
            yield batch.drop(columns="counts")

    each = []
    for r, i in PLACES:
        hit = _hit(r, F.lit(RULES[r][1][i]))
        for q in RULES:
            hit = hit | ((F.col(f"o_{q}") > 0) & (F.col(f"o_{q}") < F.col(f"o_{r}")) & _hit(q, F.col(f"c_{q}")))
        each.append(n_of(hit & F.col("good")))
    out = durable(counted(joined(F.col("test")), each).mapInPandas(tested, kinds))
    return out.select("stratum", *[F.nanvl(F.col(f"c_{r}"), F.lit(None).cast("double")).alias(r) for r in RULES])


def verdicts(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """judge() with each row's text hash."""
    based = durable(with_base(docs, doc_id, text, stratum))
    cutoffs = durable(thresholds(based, labels, risk)).select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_{r}") for r in RULES])
    out = based.join(checked_broadcast(cutoffs, risk.strata), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    bad = F.lit(False)
    for rule, measure in measures().items():
        cutoff = F.col(f"_{rule}")
        bad = bad | F.coalesce(rejects(rule, measure, cutoff), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and kept of each row of docs; then stratum.

    A stratum without enough labels to certify anything rejects by the base rules alone. Equal rows get equal verdicts, measures that tie with a cutoff are rejected.
    Null texts, empty ones and short ones fail the base rules; a text of any length is read whole. Rows of null id are judged as any other. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    return verdicts(docs, labels, risk, doc_id, text, stratum).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def keep_rows(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """docs without the rows that judge() rejects, each by its own verdict: a row is known by id, text and stratum, whether its id is null or shared by others. Other columns stay, whatever their names."""
    kept = verdicts(docs, labels, risk, doc_id, text, stratum).where("kept").select(F.col("doc_id").alias("id"), F.col("row").alias("hash"), F.col("stratum").alias("of")).distinct()
    mine = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("mine"), F.col(doc_id).cast("long").alias("my_id"), F.xxhash64(text).alias("my_hash"), stratum_of(stratum).alias("my_of"))
    same = F.col("my_id").eqNullSafe(F.col("id")) & (F.col("my_hash") == F.col("hash")) & F.col("my_of").eqNullSafe(F.col("of"))
    return mine.join(kept, same, "left_semi").select(*[F.col("mine")[c].alias(c) for c in docs.columns])
