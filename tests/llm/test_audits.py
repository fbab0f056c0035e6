import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import divergence, spelling, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_divergence(rows, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = {}, {}
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOW))
        counts.setdefault((lang, source), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        all_ = Counter()
        for (other, _), c in counts.items():
            if other == lang:
                all_.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = shares(own), shares(all_)
        pairs = [(o, sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept)) for (ln, o), c in counts.items() if ln == lang and o != source for r in [shares(c)]]
        terms = [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in kept if own[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank + 1) for rank, (item, value) in enumerate(found[:most])]
    return sorted(out)


def audited(spark, rows, **params):
    docs = spark.createDataFrame([(None, *r, None, "clash", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, term string, p double")
    return sorted(tuple(r) for r in divergence.audit(docs, **params).collect())


@pytest.mark.parametrize("tile", [2, 64])
def test_divergence_equals_brute_force(spark, tile):
    import random

    r = random.Random(7)
    words = ["the", "of", "éa", "ÉA", "Café", "x'y", "12b", "日本", "rare", "mid", "often", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(r.choices(words, weights=[40, 30, *([3] * (len(words) - 2))], k=r.randrange(0, 60))), r.choice(["en", "de"]), r.choice(["a", "b", "c", "d", None])) for _ in range(150)]
    rows += [rows[0]] * 5 + [(None, "en", "empty"), ("", "en", "empty"), ("lone words here", "xx", "a"), ("other lone words", "xx", "b"), (None, None, None), ("THE the The", "en", "\U0001f600"), ("the of " * 400_000, "en", "long")]
    assert audited(spark, rows, tile=tile, block_terms=4) == brute_divergence(rows)


def test_divergence_of_nothing(spark):
    assert audited(spark, []) == [] and audited(spark, [(None, None, None)]) == []


def test_shares_of_large_counts_are_exact(spark):
    n, total, kept = 7 * 10**15, 9 * 10**15, 123_456_789
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=0, max_size=6), max_size=25))
def test_composition_accepts_the_pairs_at_one_edit(words):
    words = sorted(words)
    found = spelling.one_edit_pairs(words)
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((i, j)) for i in range(len(words)) for j in range(i) if one_edit(words[i], words[j])}
    assert all(len(words[i]) <= len(words[j]) for i, j in found)


def test_acceptor_is_minimal_and_takes_very_long_words():
    a = spelling.Acceptor(sorted(x + y for x in ("ab", "cd", "ef") for y in ("ing", "ed", "er")))
    assert len(a.edges) == 9 and a.size[a.start] == 9
    long = "a" * 5000
    words = sorted([long, long[:2000] + "b" + long[2000:], long[:-1]])
    assert {frozenset((words[i], words[j])) for i, j in spelling.one_edit_pairs(words)} == {frozenset((long, words[2])), frozenset((long, long[:-1]))}


def brute_variants(rows, least_n=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= least_n}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def found_variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 7, "clash", 0) for i, t in rows], f"{DOC}, word string, n long")
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(docs).collect())


def test_variants_equal_brute_force(spark):
    import random

    r = random.Random(5)
    pool = ["".join(r.choice("abÉéß") for _ in range(r.randrange(3, 9))) for _ in range(150)]
    pool += ["chain", "chains", "chainsa", "chainsab", "÷sign×", "Straße", "STRASSE", "naïve", "naive"]
    weights = [1 / (k % 40 + 1) for k in range(len(pool))]
    rows = [(i, ", ".join(r.choices(pool, weights, k=200))) for i in range(40)]
    rows += [rows[3]] * 3 + [(None, "chain " * 30 + "日本naive"), (None, None), (900, ""), (901, "chain " * 40 + "chains " * 12 + "chainsa " * 5), (902, "word" * 3000 + " " + "word" * 3000 + " " + "word" * 3000), (903, "long words here " * 200_000)]
    assert found_variants(spark, rows) == brute_variants(rows)


def test_variants_of_nothing(spark):
    assert found_variants(spark, []) == [] and found_variants(spark, [(1, "a b c")]) == []


def read(text, insults=None):
    return toxicity.Reader({"idiot": 3.0, "scum*": 2.0} if insults is None else insults)(text)[1]


def test_grammar_scores_clauses_not_words():
    weight = lambda text: sum(w for _, w in read(text))
    assert weight("an idiot, truly") == 3 and weight("You are an idiot") == 4 == weight("idiot, that is what YOU are")
    assert weight("you idiot. you idiot.") == 8 and weight("you idiot idiot") == 4
    assert weight("nobody is here") == 0 and weight("she is not an idiot") == 0 and weight("not here. idiot") == 3
    assert weight("not in a month of Sundays, idiot") == 3
    assert weight("he said the man is an idiot") == 1 and weight("he said so. idiot") == 3
    assert weight("scummy") == 2 and weight("scum") == 0  # an entry with a star is for longer words
    assert weight("kill the process") == 0 and weight("i will kill you") == 3 == weight("you, i will kill") and weight("i will not kill you") < 0.1
    assert read("one fine day! you idiot; yes") == [("you idiot", 4.0)] and read(None) == read("") == []


def test_composition_equals_reading_in_a_row():
    import random

    r = random.Random(1)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.threats(), toxicity.targeted()]
    made = toxicity.grammar()
    for _ in range(300):
        states, state, total, composed = [p.start for p in parts], made.start, 0.0, 0.0
        for symbol in r.choices("otnris", k=12):
            state, _, w = made.arcs[state, symbol]
            composed += w
            for k, p in enumerate(parts):
                states[k], symbol, w = p.step(states[k], symbol)
                total += w
        assert total == composed
    assert len({s for s, _ in made.arcs}) < 200


def test_lexicon_prefers_the_narrowest_entry():
    held = {"idi*": (50, 1), "idio*": (50, 1), "idiot": (48, 0), "st*": (9, 200), "bad*": (60, 10), "badly": (20, 0), "the": (99, 900), "few": (2, 0)}
    found = toxicity.weigh(held, 100, 1000, least_docs=4, least_weight=1.0)
    assert set(found) == {"idiot", "bad*"} or set(found) == {"idiot", "bad*", "badly"}


def labelled(spark, n=600):
    import random

    r = random.Random(2)
    calm, rude = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)], ["blarg", "snorf", "gritchen", "gritchel"]
    rows, marks = [], []
    for i in range(n):
        words = r.choices(calm, k=60)
        if toxic := i % 5 == 0:
            for k in range(4):
                words.insert(r.randrange(60), r.choice(rude))
        rows.append((i, ". ".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), "en", "s", 1))
        if i % 3 < 2 or i > 400:
            marks.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {r[0]: r[0] % 5 == 0 for r in rows}


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert {"blarg", "snorf"} <= set(model.insults) and not any(w.startswith("w") for w in model.insults)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    wrong = [r.doc_id for r in rows if r.held_out and bool(r.predicted) != truth[r.doc_id]]
    assert len(wrong) <= 2


def test_toxicity_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = labelled(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_toxicity_edge_cases(spark):
    docs, labels, _ = labelled(spark, 300)
    odd = [(None, "you blarg", "en", "s", 1), (None, None, None, None, None), (5000, None, "en", "s", 1), (5001, "", "en", "s", 1), (5002, "blarg you " * 200_000, "en", "s", 1), (5003, "İ ß blarg", "en", "s", 1), (0, "again wa wb", "en", "s", 1)]
    more = docs.unionByName(spark.createDataFrame(odd, DOC)).withColumn("toxic", F.lit(3)).withColumn("h", F.lit("x")).withColumn("score", F.lit("mine"))
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (0, 1, 1), (77777, 1, 1)], labels.schema))
    model = toxicity.fit(more, marks)
    rows = toxicity.score(more, model).collect()
    assert len(rows) == 307
    by = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id >= 5000}
    assert by[5000].score == by[5001].score < 0.5 and by[5000].worst is None and by[5002].predicted == 1 and by[5003].n_clauses == 1
    none = docs.limit(0)
    assert toxicity.score(none, model).count() == 0
    for kind, share in ((labels.limit(0), 0.0), (labels.withColumn("toxic", F.lit(1)), 1.0), (labels.withColumn("toxic", F.lit(0)), 0.0)):
        flat = toxicity.fit(docs, kind)
        assert flat.insults == {} and {round(r.score, 6) for r in toxicity.score(docs, flat).collect()} == {share}


def test_training_sample_is_bounded(spark):
    docs, labels, _ = labelled(spark)
    # copies and a much repeated id count once
    again = docs.filter("doc_id = 2").withColumn("doc_id", F.lit(2).cast("long")).crossJoin(spark.range(3000)).drop("id")
    assert toxicity.fit(docs.unionByName(again), labels, most_docs=200).insults
    assert toxicity.fit(docs.unionByName(again), labels) == toxicity.fit(docs, labels)
