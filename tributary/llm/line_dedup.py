"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations alone.

A line is cut into threshold + 1 segments; the threshold grows with the line's length. A line within the threshold of it has at least one of them
unchanged, at a place that the edits before and after it can explain. So each line is indexed by (length, number, segment) and probes the indexes of its own
length and of those up to threshold shorter with the substrings at such places; what meets, and counts of letters don't rule out, is verified by
banded bit-parallel edit distance. Lengths and edits are of characters. Lines in one component of links are one class; its first line, by document and place, stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import checked_broadcast, components, durable


@dataclass(frozen=True)
class Lines:
    """edits, per: lines are near if at most one edit for each so many characters of the shorter one tells them apart, and at most so many in all.
    least: shorter lines, white space around them aside, say too little to be repetitions and stay. block: lines of one key that are compared with as many others at once.
    lookups: so many line ids are broadcast at most."""

    edits: int = 2
    per: int = 20
    least: int = 20
    block: int = 1024
    lookups: int = 300_000

    def allowed(self, length: Column) -> Column:
        return F.least(F.floor(length / self.per).cast("int"), F.lit(self.edits))


def let(value: Column, body) -> Column:
    """body(x), with x computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def start(length: Column, i: int, parts: int) -> Column:
    """Where segment i of a line of that length begins, from 0."""
    return F.floor(length * i / F.lit(parts)).cast("int")


def places(edits: int) -> list[tuple[int, int, int]]:
    """(segment, shorter by, shift) of all substrings that a line probes with: what multi-match-aware selection leaves."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            after = edits - i
            out += [(i, less, shift) for shift in range(max(-i, less - after), min(i, less + after) + 1)]
    return out


def _key(line: Column, length: Column, i: int, shift: int, parts: int) -> Column:
    a, b = start(length, i, parts), start(length, i + 1, parts)
    return F.xxhash64(length, F.lit(i), F.substring(line, a + 1 + shift, b - a))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of a and b, a not longer, both longer than edits, is at most edits: a bit for each cell of the band, a column at a time."""
    w = 2 * edits + 2
    full = F.lit((1 << w) - 1).cast("long")
    one = lambda x: F.when(x, F.lit(1)).otherwise(F.lit(0)).cast("long")
    inv = lambda x: x.bitwiseXOR(full)
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), 0)

    def run(p: Column, t: Column) -> Column:
        m = F.size(p)

        def column(state: Column, j: Column) -> Column:
            # The highest bit is the row that is edits below the diagonal, the lowest one edits + 1 above it.
            row = lambda d: j + (edits - (w - 1) + d)
            match = F.lit(0).cast("long")
            for d in range(w):
                inside = (row(d) >= 0) & (row(d) < m) & (F.get(p, F.greatest(row(d), F.lit(0))) == F.get(t, j))
                match = match.bitwiseOR(F.when(inside, F.lit(1 << d)).otherwise(F.lit(0)).cast("long"))
            vp, vn = state["vp"], state["vn"]

            def after(x: Column) -> Column:
                d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full)
                return let(d0, step)

            def step(d0: Column) -> Column:
                return let(F.struct(vn.bitwiseOR(inv(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn")), lambda h: done(d0, h))

            def done(d0: Column, h: Column) -> Column:
                # Down the lowest diagonal of the band first, then along the last row.
                down = j < m - edits
                last = F.greatest(F.lit(w - 2) - (j - (m - edits)), F.lit(0)).cast("int")
                bit = lambda x, k: F.call_function("shiftright", x, k).bitwiseAND(F.lit(1).cast("long"))
                grown = F.when(down, one(bit(d0, F.lit(w - 1)) == 0)).otherwise(bit(h["hp"], last) - bit(h["hn"], last))
                half = F.shiftright(d0, 1)
                return F.struct(h["hn"].bitwiseOR(inv(half.bitwiseOR(h["hp"]))).alias("vp"), half.bitwiseAND(h["hp"]).alias("vn"), (state["d"] + grown).alias("d"))

            return let(match, after)

        first = F.struct(F.lit(((1 << (edits + 1)) - 1) << (w - edits - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).cast("long").alias("d"))
        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), first, column, lambda s: s["d"] <= edits)

    return let(F.struct(chars(a).alias("p"), chars(b).alias("t")), lambda x: run(x["p"], x["t"]))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


#: Letters that are counted: any give right results, frequent ones leave few pairs to verify.
LETTERS = ("etaoinsh", "rdlucmfw", "ypvbgkqx")


def letter_counts(line: Column, letters: str) -> Column:
    """How often each of eight letters occurs, up to 255, in a byte each of a long."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        n = F.least(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))), F.lit(255)).cast("long")
        out = out.bitwiseOR(F.shiftleft(n, 8 * i))
    return out


def alike(pairs: list[tuple[Column, Column]], edits: Column) -> Column:
    """Whether letter counts allow for so few edits: an edit changes two counts at most, each by one."""
    byte = lambda x, i: F.shiftright(x, 8 * i).bitwiseAND(F.lit(255).cast("long"))
    total = F.lit(0).cast("long")
    for a, b in pairs:
        for i in range(8):
            total = total + F.abs(byte(a, i) - byte(b, i))
    return total <= edits * 2


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, lines: Lines, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, pos, id, sign) of each line that may be removed: row is the text's hash, id and sign are two of the line's. Texts themselves don't travel."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    rows = rows.withColumn("line", trimmed(F.col("line"))).where(F.length("line") >= F.lit(max(lines.least, 1)))
    return rows.select("doc_id", "row", "pos", F.xxhash64("line").alias("id"), sign().alias("sign"))


def sign() -> Column:
    """A second hash of a line: two lines are taken for one only if both agree."""
    return F.xxhash64(F.lit("sign"), "line")


def keys_of(line: Column, n: Column, lines: Lines) -> tuple[list[Column], int]:
    """The keys of a line, null where its length has no such, and how many of them are its index; the others are its probes."""
    index, probes = [], []
    for t in range(1, lines.edits + 1):
        own = lines.allowed(n) == t
        index += [F.when(own, _key(line, n, i, 0, t + 1)) for i in range(t + 1)]
        for i, less, shift in places(t):
            if less or shift:
                probes.append(F.when(lines.allowed(n - less) == t, _key(line, n - less, i, shift, t + 1)))
    return index + probes, len(index)


def meetings(docs: DataFrame, lines: Lines, text: str) -> DataFrame:
    """(id, key, probes, cuts): the keys at which a line meets a different one, by its index, which probes as well, or by its other probes.

    Copies of a line combine before the shuffle; what travels of a line is its keys, not its text. What a key has comes from an aggregation that combines
    before its shuffle, so its lines need not be in one task. cuts: parts of the key's index.
    """
    read = docs.select(F.explode(F.transform(split_lines(F.col(text)), trimmed)).alias("line"))
    read = read.select("line", F.length("line").alias("n"), F.xxhash64("line").alias("id")).where(F.col("n") >= F.lit(max(lines.least, lines.per)))
    keys, own = keys_of(F.col("line"), F.col("n"), lines)
    one = read.select("id", F.array(*keys).alias("keys")).groupBy("id").agg(F.first("keys").alias("keys"))
    rows = durable(one.select("id", F.posexplode("keys").alias("pos", "key")).where("key is not null").select("id", "key", (F.col("pos") >= own).alias("probes")))
    indexed = F.when(~F.col("probes"), F.col("id"))
    ends = rows.groupBy(F.col("key").alias("_key")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min(indexed).alias("index_low"), F.max(indexed).alias("index_high"), F.count(indexed).alias("n"))
    ends = durable(ends.where("low <> high and n > 0").withColumn("cuts", F.ceil(F.col("n") / lines.block).cast("int")))
    other = lambda low, high: (F.col(low) != F.col("id")) | (F.col(high) != F.col("id"))
    met = rows.join(checked_broadcast(ends, lines.lookups), F.col("key") == F.col("_key"))
    return met.where(F.when(F.col("probes"), other("index_low", "index_high")).otherwise(other("low", "high"))).select("id", "key", "probes", "cuts")


def linked(docs: DataFrame, met: DataFrame, lines: Lines, text: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ids of different lines within the threshold, of meetings, durable; and (id, sign) of all lines that meet.

    The index of a key that many lines share is cut into parts by hash; every line that meets them is compared with all of them, part by part.
    """
    ids = durable(met.select(F.col("id").alias("want")).distinct())
    read = docs.select(F.explode(F.transform(split_lines(F.col(text)), trimmed)).alias("line")).where(F.length("line") >= F.lit(max(lines.least, lines.per)))
    read = read.select("line", F.xxhash64("line").alias("id"))
    found = read.join(checked_broadcast(ids, lines.lookups), F.col("id") == F.col("want"), "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    found = durable(found.select("id", "line", sign().alias("sign"), F.length("line").alias("n"), *[letter_counts(F.col("line"), x).alias(f"l{i}") for i, x in enumerate(LETTERS)]))
    counts = ["n", *[f"l{i}" for i in range(len(LETTERS))]]
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts").cast("long")).cast("int")
    side = lambda rows, name, part: rows.withColumn("part", part).join(found.drop("line", "sign"), "id").select("key", "part", F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in counts])
    within_counts = alike([(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in counts[1:]], lines.allowed(F.least("a_n", "b_n")))
    pairs = side(met.where("not probes"), "a", own).join(side(met, "b", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))), ["key", "part"]).where((F.col("a") != F.col("b")) & within_counts)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("n").alias("x_n")), "a").join(found.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("n").alias("y_n")), "b")
    swap = F.col("x_n") > F.col("y_n")
    both = both.select("a", "b", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("p"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("t"), F.least("x_n", "y_n").alias("short"), F.greatest("x_n", "y_n").alias("long"))
    near = F.lit(False)
    for t in range(1, lines.edits + 1):
        near = F.when((lines.allowed(F.col("short")) == t) & (F.col("long") - F.col("short") <= t), within(F.col("p"), F.col("t"), t)).otherwise(near)
    return durable(both.where(near).select("a", "b")), found.select("id", "sign")


def line_classes(docs: DataFrame, lines: Lines = Lines(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, pos, id, sign, head, near, n_links) of each line that may be removed.

    head: (doc_id, row, pos) of the first line of its class, which stays. near: the line differs from the head. n_links: how many different lines are within the threshold.
    Lines are the same if two 64 bit hashes of them are.
    """
    rows = durable(line_rows(docs, lines, doc_id, text))
    distinct = durable(rows.groupBy("id", "sign").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first")))
    met = durable(meetings(docs, lines, text))
    links, signs = linked(docs, met, lines, text)
    count = links.select(F.col("a").alias("_id")).union(links.select("b")).groupBy("_id").agg(F.count("*").alias("n"))
    tied = components(links, native=True).join(count, F.col("node") == F.col("_id")).join(signs, F.col("node") == F.col("id")).select(F.col("node").alias("_node"), F.col("sign").alias("_sign"), "root", "n")
    known = distinct.join(tied, (F.col("id") == F.col("_node")) & (F.col("sign") == F.col("_sign")), "left")
    known = known.select("id", "sign", "first", F.coalesce("root", "id").alias("class"), F.when(F.col("root").isNull(), F.col("sign")).alias("alone"), F.coalesce("n", F.lit(0)).alias("n_links"))
    heads = known.groupBy(F.col("class").alias("_class"), F.col("alone").alias("_alone")).agg(F.min(F.struct("first", "id", "sign")).alias("h"))
    known = known.join(heads, (F.col("class") == F.col("_class")) & F.col("alone").eqNullSafe(F.col("_alone")))
    differs = (F.col("id") != F.col("h.id")) | (F.col("sign") != F.col("h.sign"))
    known = known.select(F.col("id").alias("_id"), F.col("sign").alias("_sign"), F.col("h.first").alias("head"), differs.alias("near"), "n_links")
    return rows.join(known, (F.col("id") == F.col("_id")) & (F.col("sign") == F.col("_sign"))).drop("_id", "_sign")


def line_report(docs: DataFrame, lines: Lines = Lines(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs: doc_id, n_lines, n_exact and n_near (lines removed as copies, as near copies), n_links (the most that one of its lines has to different lines), copied_from (sorted ids of the documents that keep those lines).

    Rows that are equal in id and text are one document and share its lines' places. A null text has one empty line; blank lines are never removed. A text of any length is cut into all
    its lines, a line of any length compared whole. Of lines at one place of equal documents none comes first. No rows, no result. Other columns are not read, whatever their names.
    """
    found = line_classes(docs, lines, doc_id, text)
    gone = F.struct("doc_id", "row", "pos") != F.col("head")
    places_of = lambda cond: F.size(F.collect_set(F.when(cond, F.col("pos")))).cast("long")
    per = found.groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(places_of(gone & ~F.col("near")).alias("n_exact"), places_of(gone & F.col("near")).alias("n_near"), F.max("n_links").alias("n_links"), F.array_sort(F.collect_set(F.when(gone, F.col("head.doc_id")))).alias("copied_from"))
    each = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("_row"), F.size(split_lines(F.col(text))).cast("long").alias("n_lines"))
    out = each.join(per, each["doc_id"].eqNullSafe(per["_d"]) & (each["_row"] == per["_r"]), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_lines", F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("copied_from", F.array().cast("array<bigint>")).alias("copied_from"))


def without_repeats(docs: DataFrame, lines: Lines = Lines(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines removed that repeat, or nearly repeat, an earlier line. Documents of which nothing is left go; those that had no line to remove stay as they are, null texts too.

    Rows, lines and lengths are as line_report() has them; a line is looked for among those removed by hash, however many there are. Other columns stay, whatever their names.
    """
    found = line_classes(docs, lines, doc_id, text).where(F.struct("doc_id", "row", "pos") != F.col("head"))
    gone = found.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set("pos").alias("gone"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rest = packed.join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("r")), "left")
    cut = split_lines(F.col("text"))
    kept = let(cut, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    rest = rest.select("all", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.col("gone").isNull().alias("whole"))
    rest = rest.where(F.col("whole") | (trimmed(F.col("text")) != ""))
    return rest.select(*[F.col("text").alias(c) if c == text else F.col("all")[c].alias(c) for c in docs.columns])
