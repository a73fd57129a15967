import re
from collections import Counter

import numpy as np
import pytest
from candlemill.llm import boosting, quality_classifier, quality_rules, toxicity
from candlemill.llm.terms import BUCKETS
from text_helpers import WORD, clash, docs, odd_rows, prose

LABELS = "doc_id long, quality int, toxic int"


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]
    return [*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]]


def labelled(spark, n=400):
    """Good prose and junk made of marks, each kind with a word of its own; every fourth document has no label."""
    rows = [(i, prose(60 + i % 90, i, 20_000) + " Fine." if i % 3 else " ".join(f"{w}###" for w in prose(60 + i % 90, i, 20_000).split()) + " Vile###") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n) if i % 4] + [(None, 1, 1), (3, None, None)], LABELS)
    return rows, labels


def test_base_counts(spark):
    texts = [t for _, t, _ in odd_rows()] + ["a b c a b c", "x\nx\n x\nx\t\n\n", "a a a a", "é ß # <|> $", prose(300, 3, 6), "a\rb\ra\rb"]
    rows = list(enumerate(texts))
    some, labels = labelled(spark)
    forest = quality_rules.fit_rules(docs(spark, some), labels)
    table = clash(docs(spark, rows), "kept", "n_words", "x")
    out = quality_rules.judge_quality(table, forest)
    assert set(table.columns) <= set(out.columns)
    names = [c.split()[0] for c in quality_rules.BASE.split(", ")]
    for r in out.collect():
        assert [r[n] for n in names] == slow_counts(texts[r.doc_id]) and not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(table, forest)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out.collect() if r.kept)


def test_rules_tell_good_from_junk(spark):
    some, labels = labelled(spark)
    out = quality_rules.quality_report(docs(spark, some), labels)
    assert {(r.doc_id % 3 > 0, r.kept) for r in out.collect()} == {(True, True), (False, False)}
    assert out.sort("doc_id").collect() == quality_rules.quality_report(docs(spark, some).repartition(7), labels).sort("doc_id").collect()


def test_no_labels_keep_what_the_base_rules_pass(spark):
    some, labels = labelled(spark, 60)
    out = quality_rules.quality_report(docs(spark, some), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in out)
    assert quality_rules.quality_report(docs(spark, []), labels).count() == 0


def test_trees_keep_the_directions():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 3))
    y = (x[:, 0] + 0.7 * np.sin(3 * x[:, 0]) - x[:, 1] + x[:, 2] ** 2 + draw.normal(0, 0.7, 3000) > 0.5).astype(float)
    forest = boosting.fit(x, y, [1, -1, 0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.8
    for column, way in ((0, 1), (1, -1)):
        line = np.repeat(x[:50], 40, axis=0)
        line[:, column] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(forest.margin(line).reshape(50, 40), axis=1)
        assert (way * steps >= -1e-9).all()


@pytest.mark.parametrize("module,report", [(quality_classifier, quality_classifier.quality_scores), (toxicity, toxicity.toxicity_scores)])
def test_scores_of_odd_rows(spark, module, report):
    some, labels = labelled(spark)
    rows = docs(spark, odd_rows()).unionByName(docs(spark, [(1000 + i, t) for i, t in some]))
    ids = spark.createDataFrame([(1000 + i, q, 1 - q) for i, q, _ in labels.dropna().collect()], LABELS)
    out = report(clash(rows, "held_out", "score", "predicted"), ids).collect()
    assert len(out) == len(odd_rows()) + len(some)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in out)
    import zlib
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id >= 1000 and r.held_out]
    good = module is quality_classifier  # the other one looks for the junk
    assert held and sum((r.predicted == 1) == (((r.doc_id - 1000) % 3 > 0) == good) for r in held) >= 0.95 * len(held)
    for none in (ids.limit(0), ids.where("quality = 1")):
        assert len({r.score for r in report(rows, none).collect()}) == 1
    assert report(docs(spark, []), ids).count() == 0


def test_held_out_labels_are_never_used(spark):
    some, labels = labelled(spark)
    import zlib
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if r.doc_id in held else r.quality, 0) for r in labels.dropna().collect()], LABELS)
    for report in (quality_classifier.quality_scores, quality_rules.quality_report):
        a, b = (sorted(map(tuple, report(docs(spark, some), x).collect())) for x in (labels.dropna(), turned))
        assert a == b


def test_dual_descent_separates_with_a_margin():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w, bias = quality_classifier.descend(rows, [np.ones(len(r)) for r in rows], y, 3, cost=100.0, rounds=500)
    margins = np.array([w[r].sum() + bias for r in rows]) * y
    assert margins.min() == pytest.approx(1, abs=0.02) and w[0] == pytest.approx(-w[1], abs=0.02)


def test_ngrams_are_whole_and_unique():
    found = quality_classifier.ngrams(b"One two TWO!! two two 17 | | |")
    assert len(found) == len(set(found.tolist())) and found.max() < BUCKETS
    assert len(quality_classifier.ngrams(b"")) == 0
    assert quality_classifier.shape(b"THEM!!!") == b"A!" and quality_classifier.shape("é12".encode()) == b"a9"


def test_pairs_count_for_more_than_their_terms():
    """Each of two terms alone is harmless, both together are not: no sum of weights can say so at this threshold."""
    draw = np.random.default_rng(3)
    rows, y = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        rows.append(np.unique(np.array([0] * a + [1] * b + draw.integers(2, 40, 8).tolist())))
        y.append(float(a and b))
    bias, w, v = toxicity.descend(rows, np.array(y), 40, rounds=300)

    def score(r):
        return bias + w[r].sum() + ((v[r].sum(0) ** 2).sum() - (v[r] ** 2).sum()) / 2

    assert ((np.array([score(r) for r in rows]) > 0) == np.array(y)).mean() > 0.98
    assert v[0] @ v[1] > 0.5


def planted_pairs(n, seed):
    """Texts of an insult, a group or both; only both together are toxic."""
    draw, rows, toxic = np.random.default_rng(seed), [], []
    for i in range(n):
        insult, group = (int(x) for x in draw.integers(0, 2, 2))
        words = [f"w{draw.integers(60)}" for _ in range(12)] + ["vermin"] * insult + ["foreigners"] * group
        rows.append((i, " ".join(draw.permutation(words))))
        toxic.append(insult and group)
    return rows, toxic


def test_insult_and_group_are_toxic_together_only(spark):
    rows, toxic = planted_pairs(1600, 5)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    out = toxicity.toxicity_scores(docs(spark, rows), labels).where("held_out").collect()
    assert len(out) > 300 and sum(r.predicted == toxic[r.doc_id] for r in out) > 0.97 * len(out)


def test_machine_equals_the_plain_sum_over_pairs(spark):
    rows, toxic = planted_pairs(400, 6)
    found = [toxicity.terms(t.encode()) for _, t in rows]
    machine = toxicity.fit_rows(found, np.array(toxic, float))
    assert machine.factors.any(axis=1).sum() > 2
    for r in found[:40]:
        at = machine.place[r]
        plain = machine.bias + sum(machine.weights[i] for i in at)
        plain += sum(machine.factors[i] @ machine.factors[j] for a, i in enumerate(at) for j in at[a + 1:])
        assert machine.margin(r) == pytest.approx(plain, abs=1e-9)
    table = toxicity.Rows([machine.place[r] for r in found], len(machine.weights))
    assert table.margins(machine.bias, machine.weights, machine.factors) == pytest.approx([machine.margin(r) for r in found])


def test_stems_stand_for_forms_never_seen():
    same = set(toxicity.terms("Disgusting!".encode()).tolist()) & set(toxicity.terms("disgusted".encode()).tolist())
    assert len(same) == 2 and len(toxicity.terms(b"cat cat CAT")) == 1 and len(toxicity.terms(b"")) == 0
    assert len(set(toxicity.terms("äöüßé".encode()).tolist()) & set(toxicity.terms("äöüßó".encode()).tolist())) == 1


def test_sample_is_as_large_as_it_can_be(spark):
    """Null labels do not shrink it, repeated ids do not swell it, and few labels are all taken."""
    from candlemill.llm.common import labelled as draw

    table = docs(spark, [(i % 5000, f"text {i}") for i in range(8000)])
    known = spark.createDataFrame([(i, 1 if i % 100 == 0 else None, 0) for i in range(5000)] * 3, LABELS)
    qualify = {r[0] for r in known.where("quality = 1").distinct().where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").collect()}
    got = draw(table, known, "quality", 400).collect()
    assert sorted(r.doc_id for r in got) == sorted(qualify)
    assert all(r.text == min(f"text {i}" for i in range(8000) if i % 5000 == r.doc_id) for r in got)
    many = spark.createDataFrame([(i, 1, 0) for i in range(1000)] * 20, LABELS)
    got = draw(table, many, "quality", 100).collect()
    assert len(got) == len({r.doc_id for r in got}) == 100
    assert draw(table, many.limit(0), "quality", 100).count() == 0
