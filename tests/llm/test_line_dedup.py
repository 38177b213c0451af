import random
from dataclasses import replace

from pyspark.sql import functions as F

from tributary.llm.line_dedup import Lines, line_report, places, within, without_repeats


LETTERS = "abcé 字😀😁"


def distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(r, s, k):
    s = list(s)
    for _ in range(k):
        i, what = r.randrange(len(s)), r.randrange(3)
        if what == 0:
            s.insert(i, r.choice(LETTERS))
        elif what == 1:
            s.pop(i)
        else:
            s[i] = r.choice(LETTERS)
    return "".join(s)


def brute(docs, lines):
    """doc_id -> (lines removed as copies, as near copies, kept text, links, documents copied from), by comparing all lines."""
    texts = {(d, p): x.strip(" \t\n\v\f\r") for d, t in docs for p, x in enumerate((t or "").split("\n"))}
    at = {k: x for k, x in texts.items() if len(x) >= lines.least}
    different = sorted(set(at.values()))
    root, links = {x: x for x in different}, dict.fromkeys(different, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(different):
        for b in different[:i]:
            if distance(a, b) <= min(lines.edits, min(len(a), len(b)) // lines.per):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    head = {}
    for k in sorted(at):
        head.setdefault(find(at[k]), k)
    out = {}
    for d, t in docs:
        gone = {p: at[d, p] != at[head[find(at[d, p])]] for p in range(len((t or "").split("\n"))) if (d, p) in at and head[find(at[d, p])] != (d, p)}
        left = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone)
        most = max((links[at[k]] for k in at if k[0] == d), default=0)
        out[d] = (sum(not n for n in gone.values()), sum(gone.values()), left if gone else t, most, sorted({head[find(at[d, p])][0] for p in gone}))
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice(LETTERS) for _ in range(r.randrange(15, 90))) for _ in range(40)]
    docs = [(i, "\n".join(changed(r, r.choice(base), r.choice([0, 0, 1, 2, 3, 4])) if r.random() < 0.8 else "x" * r.randrange(60) for _ in range(r.randrange(1, 7)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n\n"), (n + 3, docs[0][1])]


LINES = Lines(least=10, per=12)


def test_against_all_pairs(spark):
    docs = corpus()
    want = brute(docs, LINES)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("clash")).repartition(5)
    for lines in (LINES, replace(LINES, block=2)):  # as they are, and keys cut into many parts
        got = {r.doc_id: (r.n_exact, r.n_near, r.n_links, r.copied_from) for r in line_report(df, lines).collect()}
        assert got == {d: (*w[:2], *w[3:]) for d, w in want.items()} and sum(w[1] for w in want.values()) > 10
    rest = {r.doc_id: r.text for r in without_repeats(df, LINES).select("doc_id", "text", "line").collect()}
    assert rest == {d: w[2] for d, w in want.items() if w[:2] == (0, 0) or w[2].strip()}


def test_other_scripts(spark):
    line = "这一行文字很长足够用来比较两行之间的差别到底有多少个字符不同"
    df = spark.createDataFrame([(1, line), (2, line.replace("差", "异")), (3, line[:10] + "🙂" + line[11:]), (4, line.replace("一行文字", "两句话啊"))], "doc_id long, text string")
    assert {r.doc_id: (r.n_near, r.n_links) for r in line_report(df).collect()} == {1: (0, 2), 2: (1, 1), 3: (1, 1), 4: (0, 0)}


def test_one_key_of_many_lines(spark):
    """20,000 lines that begin alike, of one length: each with one partner."""
    r = random.Random(3)
    tails = ["".join(r.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(10_000)]
    rows = [(2 * i + k, "all of these lines begin in the very same way " + t[:29] + "yz"[k]) for i, t in enumerate(tails) for k in (0, 1)]
    got = line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.n_links == 1 and (x.n_near, x.copied_from) == ((1, [x.doc_id - 1]) if x.doc_id % 2 else (0, [])) for x in got)


def test_a_very_long_text(spark):
    text = "\n".join(f"line number {i % 30_000} of a text of very many lines" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "x" * 100_000), (3, "x" * 99_999 + "y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in line_report(df, Lines(edits=0)).collect()}
    assert got == {1: (60_000, 30_000, 0), 2: (1, 0, 0), 3: (1, 0, 0)}
    assert without_repeats(df, Lines(edits=0)).where("doc_id = 1").first()["text"] == "\n".join(text.split("\n")[:30_000])
    assert {r.doc_id: r.n_near for r in line_report(df.where("doc_id > 1")).collect()} == {2: 0, 3: 1}


def test_copied_from(spark):
    line = "this very line is found again and again, all over the place"
    df = spark.createDataFrame([(3, line), (1, f"own text here\n{line}"), (2, f"{line}!\n{line}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.n_links, r.copied_from) for r in line_report(df).collect()}
    assert got == {1: (2, 0, 0, 1, []), 2: (2, 1, 1, 1, [1]), 3: (1, 1, 0, 1, [1])}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a line that is long enough to count"), (1, "a line that is long enough to count"), (None, "a line that is long enough to count")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_exact) for r in line_report(df).collect()) == [(-1, 0), (1, 1), (1, 1)]
    assert line_report(df.limit(0)).count() == 0 and without_repeats(df.limit(0)).count() == 0


def test_probes():
    assert len(places(1)) == 4 and len(places(2)) == 12


def test_distance(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randrange(6, 24)))
        pairs.append(tuple(sorted((a, changed(r, a, r.randrange(5))), key=len)))
    df = spark.createDataFrame([p for p in pairs if len(p[0]) > 3], "a string, b string")
    for k in (1, 2, 3):
        rows = df.where(F.length("b") - F.length("a") <= k).select("a", "b", within(F.col("a"), F.col("b"), k).alias("w")).collect()
        assert all(x.w == (distance(x.a, x.b) <= k) for x in rows)


def test_columns_of_any_name_stay(spark):
    names = ("_line_gone", "_line_doc", "all", "doc", "hash", "gone", "whole", "a.b", "line", "lines", "id", "pos", "row", "key", "class", "head", "size", "_gone", "_d", "_r", "n_links")
    df = spark.createDataFrame(corpus()[:20], "doc_id long, text string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = without_repeats(df, LINES)
    assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(names)))}
    assert line_report(df, LINES).count() == 20
