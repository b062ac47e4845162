"""Operators on texts against brute force over small tables: nulls, empty texts, repeated rows, ties, extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quadrille.llm import classifier, decontaminate, line_dedup, mixing, neardup, quality_rules, substring_dedup, tokens
from quadrille.llm.components import components
from quadrille.llm.shingles import sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean"):
    full = [tuple(r) + ("en", f"s{i % 3}" if i % 4 else None, 1, 7, True) if "lang" in schema else tuple(r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [a + b for a in "bcdfghklmnprst" for b in ("a", "eo", "in", "u")]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    base = make(80)
    out = [None, "", "  \n\t", "one", "One", "two words", "Two  WORDS"]
    out += [" ".join(base)] * 3 + [" ".join(base).upper()]
    for k in range(25):
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [" ".join(make(rng.randint(1, 120))) for _ in range(25)]
    out.append(" ".join(make(5000)))
    return out


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def linked(texts, width):
    ss, parent = shingle_sets(texts, width), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ss)), 2):
        shared = len(ss[a] & ss[b])
        if ss[a] and ss[b] and 100 * shared >= 80 * (len(ss[a]) + len(ss[b]) - shared):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in ss]


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_is_brute_force(spark, texts, width):
    got = {r.doc_id: r for r in neardup.link(frame(spark, enumerate(texts)), width).collect()}
    component, sizes = linked(texts, width)
    assert [got[i].component_id for i in range(len(texts))] == component
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (component[i] == i) for i in got)


def test_near_dedup_of_large_groups(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(2, 9)):
            w[rng.randrange(60)] = rng.choice(["the", "of", f"x{rng.randint(0, 400)}"])
        out.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in neardup.link(frame(spark, enumerate(out)), 2).collect()}
    assert [got[i] for i in range(len(out))] == linked(out, 2)[0]


def test_near_dedup_makes_the_shingles_outside_a_centre_once(spark):
    """_consensus against a count in Python; rows of extra shingles are made once, whatever reads them."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    docs = [(i, i % 2, 50, 40, rng.sample(range(30), 3) + [100 + i] + [90] * (i % 3 > 0)) for i in range(120)]
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<long>")
    def same(extra):
        made.add(len(extra))
        return extra

    apart = spark.createDataFrame(docs, "doc_id long, centre long, cn long, ci long, extra array<long>").repartition(3).withColumn("extra", same.asNondeterministic()("extra"))
    inside, outside = neardup._consensus(apart)
    count = defaultdict(int)
    for _, c, _, _, extra in docs:
        for e in extra:
            count[c, e] += 1
    shared = {k for k, n in count.items() if n > 20 and n * 20 > 60}
    assert shared == {(0, 90), (1, 90)}
    assert {(r.doc_id, r.centre, r.cn, r.ci) for r in inside.collect()} == {(i, c, n, k + sum((c, e) in shared for e in extra)) for i, c, n, k, extra in docs}
    assert {(r.doc_id, r.centre, r.e) for r in outside.collect()} == {(i, c, e) for i, c, _, _, extra in docs for e in extra if (c, e) not in shared}
    assert made.value == sum(len(x[-1]) for x in docs)


def test_near_dedup_of_odd_rows(spark):
    docs = frame(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "g h i j k l"), (7, "a b c d e f"), (9, "g h i j k l")])
    got = {(r.doc_id, r.component_id) for r in neardup.link(docs, 2).collect()}
    assert got == {(None, None), (5, 5), (7, 5), (9, 5)}
    assert sorted((r.doc_id is None, r.doc_id) for r in neardup.keep_one(docs).collect()) == [(False, 5), (True, None)]
    assert neardup.keep_one(docs).columns == docs.columns
    assert neardup.link(docs.limit(0), 2).count() == 0


def test_shingles_do_not_depend_on_chunks(texts):
    alone = [len(next(sets([t], 2))) for t in texts]
    assert [len(s) for s in sets(texts, 2)] == alone == [len(s) for s in shingle_sets(texts, 2)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(60)] + [(200, i) for i in range(201, 240)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_mixing(spark, texts):
    docs = frame(spark, enumerate(texts))
    got = mixing.plan_mix(docs).collect()
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["src"]].append(r)
        assert r["src"] == r["row"]["source"] and r["row"]["size"] == 7
        assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and r["taken"] <= 2 * r["size"]
    weight = dict(zip(sorted(x for x in by if x is not None) + [None], itertools.cycle((3, 1, 2))))
    want, free, left = {}, set(by), 1.5 * total
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * by[s][0]["source_size"]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * by[s][0]["source_size"]
            left -= want[s]
        free -= over
        if not free:
            break
    want |= {s: level * weight[s] for s in free}
    for s, rows in by.items():
        assert abs(rows[0]["target"] - want[s]) < 1e-6
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"])
    mixed = mixing.mix(docs).collect()
    assert mixed[0].__fields__ == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed) == sum(r["taken"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    again = {(r["row"]["doc_id"], r["taken"]) for r in mixing.plan_mix(docs.repartition(5)).collect()}
    assert again == {(r["row"]["doc_id"], r["taken"]) for r in got}


def test_decontamination(spark, texts):
    rng = random.Random(6)
    items = [" ".join(WORD.findall(t)[3:20]) for t in texts if t and len(t.split()) > 30][:8] + ["one", "two words", None, "", "not in any document at all here"]
    long_ = texts[-1].split()
    texts = texts + [" ".join(long_[:2000] + items[0].upper().split() + long_[2000:]), " ".join(w if i != 8 else "zz" for i, w in enumerate(items[0].split()))]
    docs, bench = frame(spark, [*enumerate(texts), (0, None)]), frame(spark, list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.leaks(docs, bench).collect()}
    want = set()
    for j, item in enumerate(items):
        w = WORD.findall((item or "").translate(LOWER))
        if not w:
            continue
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, t in enumerate(texts):
            d = WORD.findall((t or "").translate(LOWER))
            shared = len(own & {tuple(d[x : x + k]) for x in range(len(d) - k + 1)})
            if shared * 100 >= len(own) * 80:
                want.add((i, j, len(own), shared))
    assert got == want and want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, *_ in want}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), bench).count()
    del rng


def test_tokens_round_trip(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    odd = ["it's don't ½² naïve", "😀 ok … “q”", "ΣΑΣ İ", "é", "a~b ~", "x y", "\x00\x1f", "q" * 3000]
    every = texts + odd
    docs = frame(spark, [(len(every) - i, t) for i, t in enumerate(every)])
    path = tokens.write(docs, str(tmp_path / "t"))
    got = {r.doc_id: r for r in tokens.load(spark, path).collect()}
    t = Tokenizer.from_file(tokens.default_tokenizer())
    start = 0
    for i in sorted(got):
        ids = np.array([*t.encode(every[len(every) - i] or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert tokens.encode_and_load(docs.limit(0)).count() == 0


def test_variable_length_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 999):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (tokens.unpack(*tokens.pack(x), n) == x).all()


def brute_lines(rows, min_words):
    places = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    by = defaultdict(list)
    for i, k, x in places:
        by[i].append((k, x))
    first, gone = {}, defaultdict(set)
    windows = []
    for i in sorted(by):
        for a in range(len(by[i])):
            for b in range(a, len(by[i])):
                if sum(len(WORD.findall(x)) for _, x in by[i][a : b + 1]) >= min_words:
                    windows.append((i, by[i][a][0], by[i][b][0], tuple(x for _, x in by[i][a : b + 1])))
    for i, a, b, w in windows:
        if (i, a) < first.setdefault(w, (i, a)):
            first[w] = (i, a)
    for i, a, b, w in windows:
        if first[w] < (i, a):
            gone[i] |= set(range(a, b + 1))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t is not None and gone[i] else t for i, t in rows}


@pytest.mark.parametrize("min_words", [1, 3, 7])
def test_line_dedup(spark, min_words):
    rng = random.Random(min_words)
    lines = ["a b", "c", "d e f", "", "g", "h i j k", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(90, None), (91, "a b\nc\nd e f\ng\nh i j k"), (92, "a b\nc\nd e f\ng\nh i j k")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows), min_words).collect()}
    assert got == brute_lines(rows, min_words)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0), min_words).count() == 0


def test_line_dedup_of_odd_rows(spark):
    """Null ids come first, rows of one id and text are treated alike, columns of any name stay."""
    run = "a b\nc d e\nf"
    rows = [(None, run, 1, 2), (1, "x y z\n" + run, 3, 4), (1, "x y z\n" + run, 3, 4), (2, run + "\nw", 5, 6), (3, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, gone long")
    got = sorted(line_dedup.dedup_lines(docs, 5).collect(), key=str)
    assert got == sorted([(None, run, 1, 2), (1, "x y z", 3, 4), (1, "x y z", 3, 4), (2, "w", 5, 6), (3, None, 7, 8)], key=str)


def brute_spans(texts, span):
    seen, raw = defaultdict(list), [(t or "").encode() for t in texts]
    for i, b in enumerate(raw):
        for s in range(len(b) - span + 1):
            seen[b[s : s + span]].append((i, s))
    mark = [np.zeros(len(b), bool) for b in raw]
    for v in seen.values():
        for i, s in v if len(v) > 1 else ():
            mark[i][s : s + span] = True
    return [(len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()) for b, m in zip(raw, mark)]


@pytest.mark.parametrize("hot", [10**6, 3, 1])
def test_substring_dedup(spark, hot):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    base = noise(300)
    texts = ["", None, "a" * 100, "ab" * 30, base, base[:150] + noise(50) + base[150:], noise(40) + base[20:75], noise(30) + base[20:70] + noise(10), base, noise(55), "x" * 41]
    texts += [base[i * 7 : i * 7 + 45] + noise(20) for i in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark, enumerate(texts)), 40, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 40)
    assert substring_dedup.dedup_substrings(frame(spark, enumerate(texts)).limit(0), 40).count() == 0
    twins = frame(spark, [(None, base), (None, base), (1, base[:60])])
    assert sorted(r.n_removed for r in substring_dedup.dedup_substrings(twins, 40).collect()) == sorted(x[1] for x in brute_spans([base, base, base[:60]], 40))


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {k for v in grams.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts):
    more = texts + ["a b c d e f g h " * 9, "x\nx\n\nx\ny#$%", "a " * 30, "w " * 8 + "z " + "w " * 8]
    docs = frame(spark, enumerate(more))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.verdicts(docs, labels).collect()}
    for i, t in enumerate(more):
        n, chars, symbols, dup, rep = want = brute_statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and r.kept == (not r.base_failed)  # too few labels to prove a cutoff
    assert quality_rules.verdicts(docs.limit(0), labels).count() == 0


def test_proven_cutoffs(spark):
    from math import comb

    n, risk = 400, 0.05
    docs = spark.createDataFrame([(i, "en", 30, 100, 60 if i % 100 == 0 else 0, 1, 0, 0, 0) for i in range(n)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_upper long, n_repeat_words long")
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    cut = quality_rules.cutoffs(quality_rules.rule_values(docs), labels, risk=risk, grid={"symbol_ratio": (0.1, 0.7)}).first()
    tail = sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(5))
    assert tail <= 0.05 / 2 and cut.cut_symbol_ratio == 0.1  # 4 of 400 rejected is proven under 5%
    strict = quality_rules.cutoffs(quality_rules.rule_values(docs), labels, risk=0.012, grid={"symbol_ratio": (0.1, 0.7)}).first()
    assert strict.cut_symbol_ratio is None or strict.cut_symbol_ratio == 0.7


def test_binomial_tail(spark):
    """Against sums of logs of factorials, at small and large counts alike."""
    from math import exp, fsum, lgamma, log

    from pyspark.sql import functions as F

    cases = [(10, 0), (200, 1), (5000, 12), (100_000, 999), (100_000, 1001), (100_000, 1150), (1_000_000, 11_900), (0, 0), (50, 40)]
    p = 0.0125
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), F.lit(p)).alias("t")).collect()
    for r in got:
        if r.k >= r.n * p:
            assert r.t == 1
            continue
        want = fsum(exp(lgamma(r.n + 1) - lgamma(i + 1) - lgamma(r.n - i + 1) + i * log(p) + (r.n - i) * log(1 - p)) for i in range(r.k + 1))
        assert abs(r.t / want - 1) < 1e-7, (r, want)


def test_classifier(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["tree", "river", "stone", "and", "of", "the", "walks", "green"]) for _ in range(rng.randint(30, 90))) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW"]) + rng.choice(["!!", "$$$", "###"]) for _ in range(rng.randint(20, 60)))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (None, "x")]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = classifier.classify(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    # flipping held-out labels changes no score
    flipped = spark.createDataFrame([(i, int(i % 3 > 0) if zlib.crc32(str(i).encode()) % 4 != 2 else int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in classifier.classify(docs, flipped).collect()} == {r.doc_id: r.score for r in got}
    assert all(r.score == 0.5 for r in classifier.classify(docs, labels.limit(0)).collect())
    kept = classifier.accept(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


@pytest.mark.parametrize("bits", [8, 1 << 24])
def test_training_moves_no_text(spark, monkeypatch, bits):
    """No exchange or join before the statistics, even where labels are too many to broadcast; the model is that of all statistics."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Tree", "of", "9", "a!#", "green."]) for _ in range(rng.randint(3, 40)))) for i in range(200)] + [(5, "an id again"), (None, "x"), (7, None)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(4, 1), (6, None), (None, 1)], "doc_id long, quality int")
    fit, plans = classifier.fit, []

    def watched(stats, known):
        plans.append(stats._jdf.queryExecution().optimizedPlan().toString())
        return fit(stats, known)

    want = fit(docs.select("doc_id", classifier._statistics("text").alias("x")), labels)
    monkeypatch.setattr(classifier, "BITS", bits, raising=False)
    monkeypatch.setattr(classifier, "fit", watched)
    for known in (labels, labels.withColumn("doc_id", labels["doc_id"].cast("string"))):
        got = classifier.train(docs, known)
        assert all(np.allclose(got.mean[c], want.mean[c]) and np.allclose(got.factor[c], want.factor[c]) and np.isclose(got.offset[c], want.offset[c]) for c in (0, 1))
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_decontamination_keeps_clean_rows_of_a_shared_id(spark):
    from quadrille.llm import decontaminate

    item = " ".join(f"w{i}" for i in range(24))
    halves = [" ".join(f"w{i}" for i in range(14)), " ".join(f"w{i}" for i in range(10, 24))]
    data = [(None, f"a b {item} c d"), (None, "clean words of a row without any id"), (None, None), (7, item), (7, "other clean words under the same id"), *((None, h) for h in halves), *((8, h) for h in halves)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    want = [r for r in data if item not in (r[1] or "")]
    got = [tuple(r) for r in decontaminate.clean(docs, items).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(tuple(r) for r in decontaminate.clean(docs, items.limit(0)).fillna("").fillna(-1).collect()) == sorted((-1 if a is None else a, b or "") for a, b in data)


def test_discriminant_is_the_log_density_difference(spark):
    """Scores against sums over the rows themselves, inverses and determinants without Cholesky; repeated rows count twice."""
    rng = random.Random(4)
    make = lambda bad: " ".join(rng.choice(["tree", "River", "stone,", "of", "the", "9", "café"]) + ("!#" if bad and rng.random() < 0.6 else "") for _ in range(rng.randint(5, 60)))
    rows = [(i, make(i % 3 == 0)) for i in range(120)] + [(5, "again the same id"), (7, None), (500, ""), (501, "word " * 20000)]
    rows += rows[:4]
    labels = [(i, int(i % 3 > 0)) for i in range(120)] + [(3, None), (4, 9), (1, 1)]
    x = {0: [], 1: []}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for j, q in labels:
                if i == j and q in (0, 1):
                    x[q].append(classifier.document_statistics(t))
    n = {c: len(v) for c, v in x.items()}
    mean = {c: np.mean(v, axis=0) for c, v in x.items()}
    cov = {c: np.mean([np.outer(r - mean[c], r - mean[c]) for r in np.array(v)], axis=0) for c, v in x.items()}
    pooled = sum(cov[c] * n[c] for c in n) / sum(n.values())

    def density(c, r):
        own = (1 - classifier.POOL) * n[c] / (n[c] + 10 * len(r))
        m = own * cov[c] + (1 - own) * pooled
        m = (1 - classifier.DIAGONAL) * m + classifier.DIAGONAL * np.diag(np.diag(m)) + 1e-3 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        return np.log(n[c] / sum(n.values())) - 0.5 * np.linalg.slogdet(m)[1] - 0.5 * (r - mean[c]) @ np.linalg.inv(m) @ (r - mean[c])

    want = []
    for i, t in rows:
        r = np.array(classifier.document_statistics(t))
        want.append((i, 1 / (1 + np.exp(-np.clip(density(1, r) - density(0, r), -700, 700)))))
    schema = "doc_id long, quality int"
    got = sorted((r.doc_id, r.score) for r in classifier.classify(frame(spark, rows), spark.createDataFrame(labels, schema)).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(want)], atol=1e-5)
    assert classifier.classify(frame(spark, rows).limit(0), spark.createDataFrame(labels, schema)).count() == 0
