import re

import numpy as np
import pytest

from sumlattice.llm import classifier, pii, quality_rules, stats, toxicity


def test_plain_patterns():
    base, every = pii.find("mail a.b@c.org, 10.0.0.1 1.2.3.400, 4111 1111-1111 1111 or +1 (456) 555-2186")
    assert [k for k, _, _ in base] == ["email", "ip", "card", "phone"] and base == every
    assert pii.find_plain("a@b.c@d.e") == [("email", 0, 5)] and pii.find_plain("1.2.3.4.5") == [("ip", 0, 7)] and pii.find_plain("") == []
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = np.random.default_rng(1)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "@", "b.c", ".", "1", "25", " ", "-", "+", "300"], rng.integers(0, 14)))
        assert [x[1:] for x in pii.find_plain(t) if x[0] == "email"] == [m.span() for m in email.finditer(t)]


@pytest.mark.parametrize("text,kind,span", [
    ("to john (at) example (dot) com now", "email", "john (at) example (dot) com"), ("jane dot doe at mail dot example dot org", "email", "jane dot doe at mail dot example dot org"),
    ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"), ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
    ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"), ("j​ohn@ex.com", "email", "j​ohn@ex.com"),
    ("maria punto lopez arroba ejemplo punto com.", "email", "maria punto lopez arroba ejemplo punto com"), ("hans at beispiel punkt de", "email", "hans at beispiel punkt de"),
    ("à jean arobase exemple point fr demain", "email", "jean arobase exemple point fr"), ("hans klammeraffe beispiel.de", "email", "hans klammeraffe beispiel.de"), ("von ԁan@ex.com an", "email", "ԁan@ex.com"),
    ("call +49 151 two three four five six", "phone", "+49 151 two three four five six"), ("más tres cuatro nueve uno dos tres cuatro cinco seis", "phone", "más tres cuatro nueve uno dos tres cuatro cinco seis"),
    ("4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"), ("10 dot zero dot 0 punkt eins", "ip", "10 dot zero dot 0 punkt eins"), ("jane＠ex。com", "email", "jane＠ex。com"),
])
def test_disguises(text, kind, span):
    assert (kind, span) in [(k, text[a:b]) for k, a, b in pii.find(text)[1]]
    assert f"<{kind.upper()}>" in pii.redact(text, pii.find(text)[1])


def test_clean_texts_stay():
    for t in ("meet me at noon. The dot at home", "look at one two three", "at the end (at last) dots", "Привет мир", "x" * 100_000, "look at any point of this", "at this point in time at home dot",
              "un point de vue", "ein Punkt um null Uhr", "cinco punto dos", "x " * 50_000 + "dot " * 50_000, "one " * 7):
        assert pii.find(t) == ([], [])


def test_base_spans_are_not_lengthened_by_prose():
    for t, k in (("écrivez à a@b.fr point final", "email"), ("tel +1 (848) 555-1373 Un homme", "phone"), ("un 10.0.0.1", "ip"), ("a@b.com dot the", "email")):
        base, every = pii.find(t)
        assert base == every and [x[0] for x in base] == [k]


def test_random_disguises_map_back_to_their_source():
    rng = np.random.default_rng(8)
    pick = lambda *x: str(x[rng.integers(0, len(x))])
    names, ends = ("maria", "jan9", "a_b", "x-y"), ("com", "org", "de", "fr", "es")
    signs = {"@": (" at ", " (at) ", "[AT]", " arroba ", " arobase ", "@"), ".": (" dot ", "(dot)", " punto ", " PUNKT ", " point ", " [.] ")}
    number = {d: [w for w, x in pii._DIGIT_WORDS.items() if x == d] for d in "0123456789"}
    for _ in range(1500):
        if rng.random() < 0.6:
            kind, plain = "email", f"{pick(*names)}.{pick(*names)}@{pick('mail', 'ex-1')}.{pick(*ends)}"
            source = "".join(pick(*signs[c]) if c in signs else c for c in plain)
        else:
            kind, plain = "phone", "+" + "".join(pick(*"123456789") for _ in range(rng.integers(9, 16)))
            source = " ".join("plus" if c == "+" else pick(*number[c]) for c in plain)
        before, after = pick("", "so: ", "Привет, ", "é | "), pick("", ", ja", " | x", "; é")
        text = before + source + after
        m = pii.Mapped(text)
        for step in pii.CHAIN:
            m = step(m)
        base, every = pii.find(text)
        assert plain in m.text, text
        assert (kind, len(before), len(before) + len(source)) in every, text


def test_offset_tape_is_in_order():
    rng = np.random.default_rng(9)
    parts = ["one", "two", " ", " ", "dot", "at", "(at)", "@", ".", "5", "a", "б", "е", "\u200b", "arroba", "point", "com", "+", "plus", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 16)))
        m = pii.Mapped(text)
        for step in pii.CHAIN:
            m = step(m)
        if m.lo:
            assert len(m.lo) == len(m.hi) == len(m.made) == len(m.text) and m.lo == sorted(m.lo) and m.hi == sorted(m.hi)
            assert all(made or (text[a:b] == c) for c, a, b, made in zip(m.text, m.lo, m.hi, m.made))
        base, every = pii.find(text)
        assert set(base) <= set(every) and all(0 <= a < b <= len(text) for _, a, b in every)


def test_pii_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "é a@b.co", 0), (2, "é a@b.co", 0)], "doc_id long, text string, spans int")
    got = {(r["doc_id"], r["n_email"], r["spans"], r["redacted"]) for r in pii.detect(df).collect()}
    assert got == {(1, 0, "", None), (None, 0, "", None), (2, 1, "email:2:8", "é <EMAIL>")}
    assert pii.redact_column(df).columns == df.columns and pii.redact_column(df).where("text LIKE '%<EMAIL>'").count() == 2
    assert pii.detect(df.limit(0)).count() == 0


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_against_distances():
    terms = {"stupid": 3.0, "idiot": 4.0, "scum": 5.0, "idiots": 2.0}
    auto, rng = toxicity.Automaton(terms, {"loweia": 6.0}, frozenset(terms) - {"scum"}), np.random.default_rng(2)
    loose = toxicity.Automaton(terms, {"loweia": 6.0})
    tried = {"scun", "idiot", "loweiabc", "loweib", "", "stpid"}
    for w in terms:
        for _ in range(400):
            x = [*w]
            for _ in range(rng.integers(0, 3)):
                i = rng.integers(0, len(x) + 1)
                x[i : i + rng.integers(0, 2)] = [*rng.choice([*"abstuidom"], rng.integers(0, 2))]
            tried.add("".join(x))
    for x in tried:
        exact = x in terms or x.startswith("loweia")
        near = any(within_one(x, w) for w in terms if w != "scum")
        got = auto.match(x)
        assert (got is not None) == (exact or near), x
        assert got is None or (got[1] == 0) == exact
        assert sorted(loose.near(x)) == ([] if exact else sorted(w for w in terms if within_one(x, w)))
    assert auto.match("idiot") == (4.0, 0) and auto.match("idoot") == (4.0, 1)


def test_features_against_plain_distances():
    terms, stems, fuzzy = {"scum": 3.0, "idiot": 4.0, "idiots": 2.5}, {"blar": 5.0}, frozenset({"idiot", "idiots"})
    scanner = toxicity.Scanner(toxicity.Model(terms, stems, fuzzy, np.zeros(toxicity.N_FEATURES)))
    rng, parts = np.random.default_rng(10), ["scum", "Idiot", "idoot", "idiotts", "scun", "blargh", "blar", "you", "said", '"', ",", "river", "the", "day", "«", "»", "x1y"]

    def plain(text):
        low = text.lower()
        found = [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", low)]
        out = [0.0] * toxicity.N_FEATURES
        n = exact = 0
        for i, (at, w) in enumerate(found):
            own = [v for t, v in terms.items() if t == w] + [v for s, v in stems.items() if w.startswith(s)]
            close = [terms[t] for t in fuzzy if within_one(w, t)]
            if not own and not close:
                continue
            n, exact, edits, v = n + 1, exact + bool(own), int(not own), max(own or close)
            near = {x for _, x in found[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]}
            quoted = sum(c in '"“”„«»' for c in low[:at]) % 2 == 1 or bool(near & toxicity._REPORT)
            out[(3 if quoted else 1) + edits] += v
            out[5] += v * bool(near & toxicity._ADDRESS)
            out[6 + edits] = max(out[6 + edits], v)
        out[8], out[9] = exact, 100 * n / max(len(found), 1)
        return [1.0, *np.log1p(out[1:])]

    for _ in range(1500):
        text = " ".join(rng.choice(parts, rng.integers(0, 40)))
        assert np.allclose(scanner.features(text), plain(text)), text
    assert np.allclose(scanner.features("river " * 200_000 + "scum"), plain("river " * 200_000 + "scum"))


def test_terms_and_collisions_against_plain_counts(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i % 3 == 0), " ".join(rng.choice(["idiot", "idiom", "idio", "scum", "skum", "river", "a", "scam", "rivers"], rng.integers(0, 9)))) for i in range(90)] + [(0, None), (1, "")]
    counted = spark.createDataFrame(rows, "y int, text string").repartition(4).mapInArrow(toxicity._counts, "term string, n1 long, n0 long").groupBy("term").agg({"n1": "sum", "n0": "sum"}).toDF("term", "a", "b").selectExpr("term", "`a` AS x", "`b` AS z")
    got = {r[0]: {r[1], r[2]} for r in counted.collect()}
    sets = [(y, toxicity._terms_of(t or "")) for y, t in rows]
    n1, n0 = ({t: sum(t in s for z, s in sets if z == y) for t in set().union(*(s for _, s in sets))} for y in (1, 0))
    assert got == {t: {n1[t], n0[t]} for t in n1}
    terms = {"idiot": 3.0, "scum": 3.0}
    clean = spark.createDataFrame([(t, 0, n) for t, n in n0.items()], "term string, n1 long, n0 long")
    met = toxicity._collisions(spark, clean, toxicity.Model(terms, {"riv": 1.0}, frozenset(), np.zeros(1)))
    assert met == {t: sum(n for w, n in n0.items() if w[-1] != "*" and w not in terms and within_one(w, t)) for t in terms}


def test_words_near_clean_ones_may_not_be_misspelled(spark):
    rng = np.random.default_rng(12)
    docs = []
    for i in range(600):
        w = [f"{rng.choice([*'bcdfg'])}{rng.choice([*'aeiou'])}lm{rng.choice([*'aeiou'])}r" for _ in range(20)]
        w += ["grubnak" if i % 8 else "snark"] if i % 4 == 0 else ["shark"] * (i % 3 == 0)
        docs.append((i, int(i % 4 == 0), " ".join(rng.permutation(w))))
    model = toxicity.learn(spark, spark.createDataFrame(docs, "id long, y int, text string"))
    assert {"grubnak", "snark"} <= set(model.terms) and "grubnak" in model.fuzzy and "snark" not in model.fuzzy


def test_toxicity_learns(spark):
    rng = np.random.default_rng(3)
    docs = []
    for i in range(400):
        w = [f"word{rng.integers(0, 300)}" for _ in range(30)]
        if i % 4 == 0:
            w[rng.integers(0, 30)] = ["blargh", "snoofle", "grubnak"][rng.integers(0, 3)]
        docs.append((i, " ".join(w), int(i % 4 == 0)))
    own = spark.createDataFrame([(i, y, t) for i, t, y in docs], "id long, y int, text string")
    model = toxicity.learn(spark, own)
    assert {"blargh", "snoofle", "grubnak"} <= set(model.terms)
    new = spark.createDataFrame([(1, "you are a blargh today", 0.0), (2, "you are a snooffle today", 0.0), (3, "word1 word2 word3", 0.0), (4, None, 0.0), (None, "", 0.0)], "doc_id long, text string, score double")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(spark, new, model).collect()}
    assert s[1] > 0.7 > s[3] and s[4] == s[None] < 0.3 and s[2] > s[3]
    assert toxicity.learn(spark, own.where("y = 0")) == 0.0 == toxicity.learn(spark, own.limit(0))
    assert toxicity.score(spark, new.limit(0), model).count() == 0 and {r["score"] for r in toxicity.score(spark, new, 0.25).collect()} == {0.25}


def test_viterbi_against_all_labelings():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(40):
        n = rng.integers(1, 7, 3)
        score, step = rng.standard_normal((3, n.max())), rng.standard_normal((2, 2))
        got = quality_rules.viterbi(score, n, step)
        value = lambda k, y: sum(score[k, t] * y[t] for t in range(len(y))) + sum(step[y[t - 1], y[t]] for t in range(1, len(y)))
        for k in range(3):
            assert value(k, got[k, : n[k]]) == pytest.approx(max(value(k, y) for y in itertools.product((0, 1), repeat=n[k])))
        content, changes = quality_rules._expected(score, n, step)
        for k in range(3):
            all_y = [*itertools.product((0, 1), repeat=n[k])]
            p = np.exp([value(k, y) for y in all_y])
            assert np.allclose(content[k, : n[k]], (p[:, None] * np.array(all_y)).sum(0) / p.sum())
        assert changes.sum() == pytest.approx((n - 1).sum())


def test_quality_rows(spark):
    good = "\n".join(f"The {a} quiet river of line {i} went past an old {b} house." for i, (a, b) in enumerate(zip("abcdefgh", "ijklmnop")))
    texts = [(1, good), (2, None), (None, ""), (3, "w " * 200), (4, "a | b # c\n" * 3 + " \n"), (1, good)]
    df = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, kept int")
    got = quality_rules.judge(spark, df, quality_rules.NEUTRAL).toPandas()
    assert len(got) == 6 and got[got.doc_id == 1]["kept"].all() and got[got.doc_id.isin([2, 3, 4])]["base_failed"].all()
    r = got[got.doc_id == 4].iloc[0]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (15, 15, 6, 2, 15)
    assert quality_rules.judge(spark, df.limit(0), quality_rules.NEUTRAL).count() == 0


def test_repeated_words():
    key = np.array([*range(10), *range(10), 99], np.uint64)
    assert stats.repeated(key) == 20 and stats.repeated(key[:12]) == 0 and stats.repeated(np.zeros(9, np.uint64)) == 9


def test_line_model_and_classifier_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.trained(spark, docs, labels)
    y = labels.where(stats.held_out("doc_id", 4, 2)).select("doc_id", "quality").toPandas().set_index("doc_id")["quality"]
    s = classifier.score(spark, docs, model).toPandas().set_index("doc_id")["score"][y.index]
    assert ((s >= 0.7) == (y == 1)).mean() > 0.95 and s.between(0, 1).all()
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "x " * 50_000, 1.0)], "doc_id long, text string, score double")
    assert classifier.score(spark, odd, model).count() == 3 and classifier.score(spark, odd.limit(0), model).count() == 0
    assert classifier.fit(spark, docs.limit(0).selectExpr("doc_id AS id", "1 AS y", "text")) == 0.5
    assert classifier.keep_good(spark, docs, model).columns == docs.columns


def test_isotonic():
    knots, values = classifier.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert np.interp([1, 2, 3, 4, 5], knots, values).tolist() == [0, 0.5, 0.5, 1, 1]


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def test_numbers_against_plain_patterns():
    rules = {
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= sum(c.isdigit() for c in t) <= 19 and luhn([c for c in t if c.isdigit()])),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= sum(c.isdigit() for c in t) <= 15),
    }
    rng = np.random.default_rng(5)
    parts = ["4111111111111111", "4111 1111-1111 1111", "10.0.0.1", "256", ".", " ", "-", "+", "(", ")", "7", "1.2", "00", "x", "378282246310005", "+4915112345678", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, rng.integers(0, 9)))
        for kind, (pattern, good) in rules.items():
            assert [x[1:] for x in pii.find_plain(t) if x[0] == kind] == [m.span() for m in re.finditer(pattern, t) if good(m[0])], (kind, t)


def test_base_counts_against_plain(spark):
    rng = np.random.default_rng(6)
    texts = [None, ""]
    for _ in range(300):
        few = rng.integers(2, 30)
        texts.append("".join(f"{rng.choice(['a', 'É', '#', '$x', 'wörd'])}{rng.integers(0, few)}{rng.choice([' ', '  ', chr(10), chr(9), chr(0xA0), chr(10) + ' ' + chr(10)])}" for _ in range(rng.integers(0, 80))))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.judge(spark, df, quality_rules.NEUTRAL).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = word.findall(t), [x for x in t.split("\n") if word.search(x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = len({p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 8)})
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, len(w) < 20 or 100 * again > 30 * len(w))
        assert got[i] == want, t


def test_line_model_learns_lines():
    rng = np.random.default_rng(7)
    doc, x, y = [], [], []
    for d in range(300):
        bad = d % 3 == 0
        n = int(rng.integers(1, 700 if d == 0 else 40))
        doc += [d] * n
        y += [0 if bad else 1] * n
        x.append(rng.normal(-1.0 if bad else 1.0, 0.7, (n, stats.N_SHARES + 1)))
    doc, x, y = np.array(doc), np.concatenate(x), np.array(y)
    field = quality_rules.fit(doc, x, y, rounds=60)
    for own, line, row in quality_rules._alike(np.bincount(doc)):
        wide, n = quality_rules._padded(field.scores(x)[line], row, len(own))
        label = quality_rules.viterbi(wide, n, field.step)[np.arange(wide.shape[1])[None] < n[:, None]]
        assert (label == y[line]).mean() > 0.95 and wide.shape[1] < 2 * n.min() + 1
    assert sorted(i for _, line, _ in quality_rules._alike(np.bincount(doc)) for i in line) == [*range(len(doc))]


def test_ridge_against_plain_equations(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    own = stats.labelled(docs, labels, "quality", 200)
    model = classifier.fit(spark, own)
    rows = classifier._features(own).toPandas()
    x, y = np.array([np.frombuffer(v, np.float64) for v in rows["x"]]), rows["y"].to_numpy(float)
    if (rows["part"] == 0).groupby(rows["y"]).any().all() and rows["y"].nunique() == 2:
        x, y = x[rows["part"] != 0], y[rows["part"] != 0]
    p = model.features(x)
    plain = np.linalg.lstsq(np.vstack([p, np.sqrt(classifier.RIDGE) * np.eye(p.shape[1])]), np.append(y, np.zeros(p.shape[1])), rcond=None)[0]
    assert np.allclose(p @ model.beta, p @ plain, atol=1e-6)


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(spark, stats.labelled(docs, labels, "toxic", 20_000, ~stats.held_out("id", 3, 1)))
    y = labels.where(stats.held_out("doc_id", 3, 1)).select("doc_id", "toxic").toPandas().set_index("doc_id")["toxic"]
    s = toxicity.score(spark, docs, model).toPandas().set_index("doc_id")["score"][y.index]
    assert ((s >= 0.7) == (y == 1)).mean() > 0.95


def test_repeated_rows_are_fitted_on_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    assert sorted(map(tuple, stats.labelled(docs, labels, "quality", 10).collect())) == [(1, 1, "a"), (2, 0, None)]


def test_scores_do_not_depend_on_the_rows_beside_them():
    rng, width, n = np.random.default_rng(0), classifier.WIDTH, stats.N_DOCUMENT
    knots = np.sort(rng.standard_normal(50))
    model = classifier.Model(np.zeros(n), np.ones(n), rng.standard_normal((n, width)), rng.uniform(0, 6, width), rng.standard_normal(width + 1), knots, np.sort(rng.random(50)))
    x = rng.standard_normal((400, n))
    whole, raw = model.score(x), model.raw(x)
    for size in (1, 2, 3, 7, 64, 99):
        for at in range(0, 400, size):
            assert (model.score(x[at : at + size]) == whole[at : at + size]).all() and (model.raw(x[at : at + size]) == raw[at : at + size]).all()
    z = np.clip(x, -4, 4) @ model.omega + model.phase
    assert np.allclose(raw, np.append(np.cos(z) * np.sqrt(2 / width), np.ones((400, 1)), 1) @ model.beta, rtol=0, atol=1e-12) and len(model.score(x[:0])) == 0


def test_repeated_and_long_rows_score_alike(spark):
    from sumlattice.llm import classifier

    texts = ["good plain words of a text . " * (k + 1) if k % 2 else "BUY $$$ now !!! " * (k + 1) for k in range(20)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    model = classifier.trained(spark, docs, labels)
    rows = [(1, texts[1], 0), (1, texts[1], 0), (None, texts[1], 0), (2, "word " * 400_000, 0), (3, None, 0), (4, "", 0)]
    many = spark.createDataFrame(rows, docs.schema)
    got = [tuple(r) for r in classifier.score(spark, many, model).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    by = {i: {s for k, s in got if k == i} for i in (1, None, 3, 4)}
    assert by[1] == by[None] and len(by[1]) == 1 and by[3] == by[4]
    kept = [tuple(r) for r in classifier.keep_good(spark, many, model, threshold=0.5).collect()]
    assert [r for r in kept if r[1] == texts[1]] in ([], rows[:3]) and classifier.keep_good(spark, many.limit(0), model).count() == 0
