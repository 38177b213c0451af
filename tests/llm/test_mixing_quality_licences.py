import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tributary.llm import licences, mixing, quality
from tributary.llm.mixing import Mix, mix_sources, mixed_rows, targets


def sources(seed=2, n=300):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "a", "b", "b", "b", "z", "É", "Z"]), " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    return rows + [(n, "empty", None), (n + 1, "empty", ""), (None, "a", "no id here"), (4, rows[4][1], rows[4][2])]


def water(sizes, weights, budget):
    """Targets by sharing out again and again what is beyond the caps."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), budget * sum(sizes.values())
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: share * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full
    return out


def test_mix(spark):
    rows = sources()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumns({c: F.lit(1) for c in ("_mix_s", "_k", "_q", "_off", "_cum", "range", "v", "sum", "n")}).withColumn("lang", F.lit("en")).repartition(4)
    out = mix_sources(df).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes, (3, 1, 2), 1.5)
    assert len(out) == len(rows) and {r.source: r.source_size for r in out} == dict(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in out) and all(r.taken in (0, r.size, 2 * r.size) for r in out)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = Counter(r.doc_id for r in mixed_rows(df).collect())
    copies = Counter()
    for r in out:
        copies[r.doc_id] += r.copies
    assert mixed == +copies and mixed_rows(df).columns == df.columns
    assert mix_sources(df.limit(0)).count() == 0 and mix_sources(df.where("text is null")).count() == 1


def test_mix_in_many_ranges(spark, monkeypatch):
    rows = sources() + [(5000 + i, "blank", " ") for i in range(300)] + [(9000, "b", "w " * 30_000), (None, "a", "another"), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(str, mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "RANGE", 40)
    assert sorted(map(str, mix_sources(df).collect())) == want and "_cum" not in mix_sources(df).columns
    monkeypatch.setattr(mixing, "RANGES", 3)  # the range of the cut is sorted into ranges again
    monkeypatch.setattr(mixing, "RANGE", 5)
    assert sorted(map(str, mix_sources(df).collect())) == want
    assert [mixing.digits(n) for n in (0, 10**8, 10**10, 10**12)] == [3, 3, 5, 6]


def test_order_is_by_virtual_time(spark):
    rows = [r for r in sources(7) if r[0] is not None and r[2]][:200]
    out = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    copies, total = [], 0
    for s in {r[1] for r in rows}:
        cum = 0
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (md5(str(r[0]).encode()).hexdigest(), r[0]))
        for d, _, t in mine:
            cum += len(t.split())
            copies += [((cum + e * out[d].source_size) / out[d].target, s is None, s or "", md5(str(d).encode()).hexdigest(), d, len(t.split())) for e in (0, 1)]
            total += len(t.split())
    want, run = Counter(), 0
    for c in sorted(copies):
        run += c[-1]
        if run > 1.5 * total:
            break
        want[c[-2]] += 1
    assert {d: r.copies for d, r in out.items() if r.copies} == dict(want)


def test_targets_hold_their_sum(spark):
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000), (None, 5)], "_s string, size long")
    got = {r["_s"]: r.target for r in targets(df, Mix()).collect()}
    assert abs(sum(got.values()) - 1.5 * 1016) < 1e-6 and all(got[s] <= 2 * z for s, z in (("a", 1), ("b", 10), ("c", 1000), (None, 5)))


def slow_counts(t):
    t = t or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "a b c d e f g h", "x\ny\nx\n x\n\n\n", "é# ü|\x85  ", "w " * 9, "a\vb\fc\rd", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 x", "z" * 100_000]


@pytest.mark.parametrize("t", TEXTS, ids=range(len(TEXTS)))
def test_base_counts(t):
    assert quality.base_counts(t) == slow_counts(t)


def test_base_counts_of_random_texts():
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["a ", "b ", "c\n", "a b a b a b a b ", "#", " "]) for _ in range(r.randrange(60)))
        assert quality.base_counts(t) == slow_counts(t)


@pytest.mark.parametrize("good", [50, 200, 1000])
def test_bound_is_exact(good):
    """certified() against the sum of the binomial's terms."""
    from math import comb

    for alpha, delta in ((0.02, 0.05), (0.1, 0.001)):
        for k in range(0, 12):
            p = sum(comb(good, i) * alpha**i * (1 - alpha) ** (good - i) for i in range(k + 1))
            assert quality.certified(k, good, alpha, delta) == (p <= delta)


def labelled(spark, n=9000, seed=5):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        words = ["".join(r.choice("abcdef") for _ in range(r.randrange(3, 8))) + ("%%%" if bad and r.random() < 0.9 else "") for _ in range(r.randrange(30, 60))]
        docs.append((i, " ".join(words), r.choice(["en", "en", "en", "de", None])))
        if i % 2:
            labels.append((i, 0 if bad else 1))
    return docs + [(n, None, "xx"), (n + 1, "", None), (n + 2, "a " * 300, "en"), (None, docs[0][1], "en"), docs[1]], labels


def test_verdicts(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("stratum", F.lit("clash")).withColumn("quality", F.lit(7)).repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    out = quality.judge(docs, marks).collect()
    assert len(out) == len(rows)
    text = {d: t for d, t, _ in rows}
    for x in out:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == slow_counts(text[x.doc_id])
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words) and not (x.base_failed and x.kept)
    junk = {d for d, t, _ in rows if t and t.count("%") > 20}
    clean = {d for d, t, _ in rows if t and "%" not in t and not slow_counts(t)[4]}
    kept = {x.doc_id for x in out if x.kept}
    assert clean <= kept and not junk & kept
    good = quality.keep_rows(docs, marks)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept and None in kept


def slow_cutoffs(cases, risk):
    """(stratum, good, testing half, measures) of each case -> the cutoffs of each stratum, by going through all cases again and again."""
    from math import comb

    out, strata = {}, {c[0] for c in cases}
    hit = lambda c, r, x: c[3][r] >= x if quality.RULES[r][0] == ">=" else c[3][r] <= x
    for s in strata:
        own = [c for c in cases if c[0] == s]
        first, second = [c for c in own if not c[2]], [c for c in own if c[2]]
        bad, chain = sum(not c[1] for c in first), []
        while True:
            left = [c for c in first if not any(hit(c, r, x) for r, x in chain)]
            best = None
            for r, (_, cutoffs) in quality.RULES.items():
                for x in cutoffs:
                    gain = sum(not c[1] for c in left if hit(c, r, x)) - risk.price * sum(c[1] for c in left if hit(c, r, x))
                    if r not in dict(chain) and gain > (best[0] if best else risk.worth * bad):
                        best = gain, r, x
            if best is None:
                break
            chain.append(best[1:])
        good, kept = [c for c in second if c[1]], {}

        def fine(rules):
            k = sum(any(hit(c, r, x) for r, x in rules) for c in good)
            return sum(comb(len(good), i) * risk.alpha**i * (1 - risk.alpha) ** (len(good) - i) for i in range(k + 1)) <= risk.delta / len(strata)

        done = False
        for j, (r, last) in enumerate(chain):
            cutoffs = quality.RULES[r][1]
            for x in cutoffs[: cutoffs.index(last) + 1]:
                done = done or not fine([*chain[:j], (r, x)])
                if not done:
                    kept[r] = x
        out[s] = kept
    return out


def test_cutoffs_against_brute_force(spark):
    r, docs, labels = random.Random(21), [], []
    for i in range(8000):
        bad, kind, lang = r.random() < 0.4, r.randrange(3), r.choice(["en", "en", "en", "de", None, ""])
        share = (0.0 if r.random() < 0.985 else 0.8) if not bad else r.choice([0.2, 0.6, 1.0]) if kind == 0 else 0.0
        words = ["".join(r.choice("abcdef") for _ in range(r.randrange(3, 8) + 9 * (bad and kind == 1))) + "%" * (r.random() < share) for _ in range(r.randrange(30, 50))]
        text = " ".join(words) + ("\nab" * 20 if bad and kind == 2 else "")
        docs.append((i, text, lang))
        labels.append((i, int(not bad)))
    risk = quality.Risk(alpha=0.05, price=3)
    based = quality.with_base(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)).cache()
    good = dict(labels)
    rows = based.select("doc_id", "stratum", "n_words", "n_repeat_words", (F.pmod(F.xxhash64(F.lit(risk.seed), "doc_id"), F.lit(2)) == 1).alias("test"), *[m.alias(k) for k, m in quality.measures().items()]).collect()
    cases = [(x.stratum, bool(good[x.doc_id]), x.test, {k: x[k] for k in quality.RULES}) for x in rows if x.n_words >= 20 and 100 * x.n_repeat_words <= 30 * x.n_words]
    want = slow_cutoffs(cases, risk)
    got = {x.stratum: {k: x[k] for k in quality.RULES if x[k] is not None} for x in quality.thresholds(based, spark.createDataFrame(labels, "doc_id long, quality int"), risk).collect()}
    assert got == want and set(got) == {"en", "de", None, ""} and len(want["en"]) >= 2
    based.unpersist()


def test_rows_are_kept_by_their_own_verdict(spark):
    """The pipeline's stage, where ids are null or shared."""
    rows, labels = labelled(spark)
    rows += [(None, f"{i} " + rows[0][1], "en") for i in range(50)] + [(None, "too short", "en"), (0, "too short too", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit("clash")).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    want = Counter(r.doc_id for r in quality.judge(docs, marks).collect() if r.kept)
    good = quality.keep_rows(docs, marks)
    got = good.collect()
    assert good.columns == docs.columns and Counter(r.doc_id for r in got) == want and want[None] >= 51 and want[0] == 1
    assert not [r for r in got if r.text.startswith("too short")]


def test_no_labels_no_thresholds(spark):
    rows, labels = labelled(spark, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    for m in (marks.limit(0), marks.limit(20)):
        assert all(x.kept != x.base_failed for x in quality.judge(docs, m).collect())
    assert quality.judge(docs.limit(0), marks).count() == 0


def test_false_rejections_are_bounded():
    """Where a rule rejects good documents at a rate beyond alpha, it is rarely certified."""
    r, wrong = random.Random(8), 0
    for _ in range(400):
        good = 400
        wrong += quality.certified(sum(r.random() < 0.03 for _ in range(good)), good, 0.02, 0.05)
    assert wrong <= 400 * 0.05


def other_version(said, template):
    numbers = {g for g in template if g.split()[1].isdigit() and (g.split()[0] in licences.NUMBERED or g.split()[0].isdigit())}
    return any(v not in said and any(g.split()[0] == v.split()[0] and g.split()[1].isdigit() for g in said) for v in numbers)


def slow_scan(text):
    found = []
    units = [text or "", *(text or "").split("\n")]
    for k, u in enumerate(units):
        a = set(licences.bigrams_of(u))
        hits = [(2 * len(a & set(g)) / (len(a) + len(g)), name) for name, g in licences.templates() if a and not other_version(a, g)]
        if hits and max(hits)[0] >= 0.8:
            found.append((k, *max(hits)))
    top = max((x[1] for x in found), default=0.0)
    return sum(k > 0 for k, _, _ in found), ",".join(sorted({n for _, _, n in found})), min((n for _, d, n in found if d == top), default=None), top


def test_licences(spark):
    mit = licences.TEMPLATES["MIT"][-1]
    texts = [None, "", " ", "no licence", "Released under the MIT License.", "words\nLICENSED under the apache license -- version 2.0\nmore", mit, mit.replace(". ", ".\n"), mit + " " + "and much more text " * 60, "released under the MIT license\nLicensed under CC BY-NC 4.0.", "Released under the BSD License.", "Released under the BSD 3-Clause License.", "code\n// SPDX-License-Identifier: MIT\n\n/* SPDX-License-Identifier: GPL-3.0 */", "x " * 30_000, licences.TEMPLATES["GPL-3.0"][-1].replace("WARRANTY", "guarantee")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("units", F.lit(1))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_notices, r.licences, r.best, r.dice) for r in licences.scan(df).collect())
    assert got == sorted(((d is not None, d or 0), *slow_scan(t)) for d, t in rows)
    assert licences.scan(df.limit(0)).count() == 0
    assert slow_scan(mit)[2] == "MIT" and slow_scan(texts[7])[2] == "MIT" and slow_scan(texts[5])[2] == "Apache-2.0"


def test_licences_named_rightly(spark):
    """Versions that contradict a template, tags, and names of licences at the end of a notice."""
    said = {
        "Licensed under the GNU General Public License, version 2.": "GPL-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the GNU General Public License, version 4.": "", "Licensed under CC BY-NC 3.0.": "",
        "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Released under the BSD 3-Clause License.": "BSD-3-Clause", "Licensed under CC0 1.0 Universal.": "CC0-1.0", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0": "GPL-2.0",
        "This file is released under the MIT License, see LICENSE for details.": "MIT", licences.TEMPLATES["GPL-3.0"][-1].replace("version 3", "version 2"): "GPL-2.0", "SPDX-License-Identifier: CC-BY-NC-4.0": "CC-BY-NC-4.0",
    }
    rows = [(i, "Some words before.\n\n" + t + "\n\nSome words after it, of the work.") for i, t in enumerate(said)]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(said.values()))


def test_texts_without_telling_words_match_nothing():
    words = set(licences.telling_words(licences.templates(), 0.8))
    for name, grams in licences.templates():
        rest = [g for g in grams if not set(g.split()) & words]
        assert 2 * len(rest) / (len(rest) + len(grams)) < 0.8, name


def test_licences_wrapped_in_longer_texts(spark):
    """Each template as a comment of lines above other content."""
    import textwrap

    code = "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(60))
    all_ = [(name, t) for name, texts in licences.TEMPLATES.items() for t in texts if len(t) > 70]
    rows = [(i, "\n".join("# " + x for x in textwrap.wrap(t, 76 if len(t) > 200 else 40)) + "\n\n" + code) for i, (_, t) in enumerate(all_)]
    rows += [(100, code), (101, "Licensed under CC BY-NC 4.0.\n" + code), (102, rows[0][1] + rows[1][1])]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: n for i, (n, _) in enumerate(all_)} | {100: "", 101: "CC-BY-NC-4.0", 102: ",".join(sorted({all_[0][0], all_[1][0]}))}
