"""Language, toxicity, personal data and lines."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonance.llm import catalog, language, lines, pii, toxicity


def test_language_on_held_out_rows(spark, sf, docs):
    rows = catalog.op1_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 30
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_scores_equal_a_plain_sum():
    model = language.Model(["a", "b"], np.log(np.random.default_rng(1).random((2, language.buckets()))).astype(np.float32), np.log([0.3, 0.7]))
    texts = ["Ab cd", "", "x", "!!", "É ü z" * 30]
    best, sure = language.score(model, texts)
    for i, t in enumerate(texts):
        found, _, letters = language.grams([t])
        total = model.log_probs[:, found].astype(float).sum(axis=1) + model.log_prior
        assert (best[i], letters[0] > 0) == ((total.argmax(), True) if any(c.isalpha() for c in t) else (-1, False))
        if letters[0]:
            assert sure[i] == pytest.approx(np.exp(total.max() - np.logaddexp.reduce(total)), rel=1e-3)
    alone = np.concatenate([np.sort(language.grams([t])[0]) for t in texts])
    together, edges, _ = language.grams(texts)
    assert np.array_equal(alone, np.concatenate([np.sort(together[a:b]) for a, b in zip(edges, edges[1:])]))


def test_language_of_odd_rows(odd, none):
    model = language.train(odd)
    rows = language.identify(odd, model).select("row.*", "lang_pred", "score").collect()
    assert len(rows) == odd.count() and sorted(model.labels) == ["de", "en", "fr"]
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in rows)
    empty = language.train(none)
    assert language.identify(none, empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(2)
    terms = ["".join(r.choice("abc") for _ in range(r.randint(3, 10))) for _ in range(40)]
    trie = toxicity.Trie()
    for t in terms:
        trie.add(t, False)
    trie.add("cab", True)
    for _ in range(400):
        token = "".join(r.choice("abc") for _ in range(r.randint(1, 11)))
        found = dict(trie.matches(token))
        want = {t: distance(t, token) for t in set(terms) if distance(t, token) <= toxicity.errors_allowed(len(t))}
        assert not found or toxicity.possible([*terms, "cab*"]).search(token)
        assert found == want | ({"cab*": 0} if token.startswith("cab") else {})


def test_automaton_finds_edited_terms():
    r = random.Random(3)
    terms = list(toxicity.BASE_TERMS)
    trie = toxicity.Trie()
    for t in terms:
        trie.add(t, False)
    may = toxicity.possible(terms).search

    def edited(token):
        at = r.randint(0, len(token))
        return r.choice([token[:at] + r.choice("aeust") + token[at:], token[:at] + token[at + 1:], token[:at] + "x" + token[at + 1:]])

    tokens = ["disguuusting", "worthhhless", "woxxrthless"]
    for term in terms:
        tokens += [term, *(edited(term) for _ in range(20)), *(edited(edited(term)) for _ in range(40))]
        tokens += [term[:at] + 2 * c + term[at:] for at in range(len(term) + 1) for c in (term[at:at + 1] or "z", "q")]
    for token in tokens:
        want = {t: d for t in terms if (d := distance(t, token)) <= toxicity.errors_allowed(len(t))}
        assert dict(trie.matches(token)) == want and (may(token) or not want)


def test_context_and_misspelling():
    scorer = toxicity.Scorer(toxicity.Model({"moron": 0.95, "worthless": 0.95, "veq*": 0.99}, frozenset({"oron"}), 0.02))
    plain, quoted = scorer.score("you moron, go away"), scorer.score('they said "moron" and left')
    assert plain > 0.9 > 0.7 > quoted > 0.02
    assert scorer.score("an oron of gold") == pytest.approx(0.02)
    assert scorer.score("what a moronn, worthles thing") > 0.7
    assert scorer.score("un vequaire") > 0.9 and scorer.score("") == pytest.approx(0.02)


def test_quotations_of_any_length():
    scorer = toxicity.Scorer(toxicity.Model({"moron": 0.95}, frozenset(), 0.02))
    far = "and so on and on " * 10
    for a, b in ('""', "“”", "«»", "„“", "‘’"):
        assert scorer.score(f"he spoke: {a}{far}moron {far}{b} and left") < 0.7
        assert scorer.score(f"{a}{far}{b} you moron {a}yes{b}") > 0.9
        assert scorer.score(f"{a}yes{b} you moron {a}{far}{b}") > 0.9
        assert scorer.score(f"{a}yes{b} {far} {a}a moron{b}") < 0.7
    assert scorer.score("„ja“ you moron “yes”") > 0.9
    assert scorer.score(f'a 5" screen\n\nyou moron "yes" {far}') > 0.9
    assert scorer.score(f'a 5" screen\n\n"you moron" {far}') < 0.7
    assert toxicity.quotations('“a "b" c” "d „e“ f') == [(0, 9), (13, 16)]
    assert toxicity.quotations('“a "b” c"') == [(0, 9)]


def test_a_full_memory_loses_no_match(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 4)
    model = toxicity.Model({"moron": 0.95, "worthless": 0.95}, frozenset(), 0.02)
    scorer = toxicity.Scorer(model)
    for text in ["you moron", "one two three four", "a moron again", "moron moron", "five six seven worthless", "worthless moron one"]:
        assert scorer.score(text) == toxicity.Scorer(model).score(text)


def test_toxicity_learns_words_and_stems(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            words[7], words[20] = "zorblax", "qiv" + word()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, known.where("doc_id < 300 or doc_id is null"))
    assert {"zorblax", "qiv*"} <= set(model.sureness)
    scored = {x["doc_id"]: x["predicted"] for x in toxicity.score_texts(docs, model).select("row.doc_id", "predicted").collect()}
    assert scored == dict(labels)


def test_toxicity_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score_texts(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_texts(none, toxicity.train(none, labels)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            n = "".join(c for c in m.group() if c in "0123456789")
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if name == "ip" else False,
                  "card": 13 <= len(n) <= 19 and doubled % 10 == 0, "phone": 9 <= len(n) <= 15}[name]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_patterns_equal_plain_ones():
    r = random.Random(6)
    parts = ["4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.2.3.4", "999.1.1.1", "a.b@c.de", "x@y", "@", "+", " ", " ", "-", ".", "12", "é", "b@c@d.e", "1.2.3.4.5.6.7.8"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert pii.base_spans(text) == plain_base(text), text


def brute_marginals(field, g):
    n, m = len(g.spans), len(pii.LABELS)
    p = np.zeros((n, m))
    for labels in itertools.product(range(m), repeat=n):
        score = sum(field.node.get(s, field.node["other"])[k] for s, k in zip(g.shapes, labels))
        score += sum(pii.CHAIN * field.chain[labels[a], labels[b]] for a, b in g.chain)
        score += sum(pii.SKIP * field.skip[labels[a], labels[b]] for a, b in g.skip)
        p[range(n), labels] += np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees(monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 60)
    field = pii.field_from({("chain", "2", 2): 30, ("chain", "4", 4): 100, ("skip", "2", 2): 40, ("skip", "4", 4): 60, ("node", "card", 2): 20, ("node", "card", 4): 9})
    g = pii.graph(["4111111111111111 77 and 4111111111111111 then 55"], [[]])
    assert g.skip and g.chain
    assert np.allclose(field.marginals(g), brute_marginals(field, g), atol=1e-3)


def test_the_field_adds_what_the_patterns_drop(spark):
    card, other = "4111111111111111", "5500005555555559"
    rows = [(1, f"pay {card} {other} now"), (2, f"a {card} b"), (3, "version 3. of 2.0 and 12345678901234567"), (4, "call +1 (826) 555-4081 190.137.223.204 x")]
    rows += [(10 + i, f"card {card} end, mail a.b{i}@c.de or +1 (017) 555-771{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs, pii.train(docs)).select("row.*", "spans", "masked", "n_card").collect()}
    assert found[1]["spans"] == "card:4:20,card:21:37" and found[1]["n_card"] == 0
    assert found[1]["masked"] == "pay [CARD] [CARD] now"
    assert found[3]["spans"] == "" and found[3]["masked"] is None
    assert found[4]["spans"] == "ip:23:38,phone:5:22"


def test_personal_data_of_odd_rows(odd, none):
    found = pii.find(odd, pii.train(odd)).collect()
    assert len(found) == odd.count()
    assert {r["base_sha256"] for r in found} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(none, pii.train(none)).count() == 0


def test_overlapping_spans_are_masked_once():
    assert pii.masked("ab 12345 cd", [(2, 3, 6), (3, 5, 8)]) == "ab [CARD] cd"


def test_lines_of_odd_rows(odd, none):
    rows = lines.remove_boilerplate(odd, min_sites=1).select("row.*", "cleaned", "n_lines", "n_removed").collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert (by_id[8]["cleaned"], by_id[8]["n_lines"], by_id[8]["n_removed"]) == ("one\ntwo\n\n", 5, 1)
    assert by_id[3]["cleaned"] is None and by_id[2]["cleaned"] == ""
    assert lines.remove_boilerplate(none).count() == 0


@pytest.mark.parametrize("sites, gone", [(9, False), (10, True), (30, True)])
def test_spread_near_and_far_from_the_threshold(spark, sites, gone):
    rows = [(i, f"s{i % sites}", f"own line {i}\nshared line") for i in range(60)]
    found = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    kept = [r["row"]["doc_id"] for r in found if "shared" in r["cleaned"]]
    assert kept == [0] if gone else len(kept) == 60
    every = lines.remove_boilerplate(
        spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", F.lit(1)), keep_first=False
    )
    assert every.where(F.col("cleaned").contains("shared")).count() == (0 if gone else 60)
