import math
from collections import Counter

import helpers
import numpy as np

from laurel.llm import quality


def corpus(count=800):
    rng = np.random.default_rng(6)
    rows, good = [], {}
    for i in range(count):
        good[i] = bool(rng.random() < 0.8)
        words = ["".join(rng.choice(["an", "the", "or", "in"], rng.integers(1, 4))) for _ in range(rng.integers(5, 80))]
        rows.append((i, " ".join(w if good[i] else w + "%%%" for w in words), "en", "s"))
    return rows, good


def test_the_sample_resembles_the_target(spark):
    rows, good = corpus()
    docs = helpers.documents(spark, rows)
    target = spark.createDataFrame([(i,) for i in good if good[i] and i % 3], "_id long")
    out = quality.resampled(docs, target, share=0.7).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert len(kept) == round(0.7 * len(rows))
    assert sum(good[i] for i in kept) > 0.98 * len(kept)
    again = {r.doc_id for r in quality.resampled(docs, target, share=0.7).collect() if r.kept}
    assert kept == again


def test_counts_and_weights_match_plain_python(spark):
    rows, good = corpus(40)
    target = spark.createDataFrame([(i,) for i in good if good[i]], "_id long")
    counts = quality.bag_counts(quality.marked(helpers.documents(spark, rows), target))
    total = sum(len(r[1].split()) * 2 - 1 + sum("%" in w for w in r[1].split()) for r in rows)
    assert counts[0].sum() == total and (counts[1] <= counts[0]).all()
    # With no other text, an n-gram's chance is the same in both models.
    lone = np.zeros((2, quality.BUCKETS))
    lone[:, 5] = 3
    weight, n = quality.log_weights(lone, np.array([5, 5, 5]), np.array([0, 0, 0]), np.array([True]))
    assert n.tolist() == [3] and abs(weight[0]) < 1e-9


def test_awkward_rows(spark):
    docs = helpers.documents(spark, helpers.AWKWARD)
    none = spark.createDataFrame([], "_id long")
    out = quality.resampled(docs, none, share=0.5).collect()
    assert len(out) == len(helpers.AWKWARD) and sum(r.kept for r in out) == 6
    assert {r.log_weight for r in out} == {0.0, None} and not any(r.kept for r in out if r.log_weight is None)
    assert quality.resampled(docs.limit(0), none).count() == 0


def test_weights_and_sample_equal_a_brute_force_version(spark):
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def grams(text):
        cores, out = [], []
        for word in helpers.words(text):
            end = len(word)
            while end > 1 and word[end - 1] in marks:
                end -= 1
            start = 0
            while end - start > 1 and word[start] in marks:
                start += 1
            cores.append(word[start:end])
            out += [("core", word[start:end])] + ([("marks", word[end:])] if end < len(word) else [])
        return out + [("pair", *p) for p in zip(cores, cores[1:], strict=False)]

    # Few different n-grams, so that no two share a place of the model.
    rng = np.random.default_rng(3)
    good = {i: bool(rng.random() < 0.7) for i in range(60)}
    rows = [(i, " ".join(rng.choice(["an", "the", "or", "in", "end"]) + ("" if good[i] or rng.random() < 0.5 else "%%") for _ in range(rng.integers(1, 60))), "en", "s") for i in good]
    rows += [(100, "(the) end, %% the or.", "en", "s"), (101, "", "en", "s"), (102, None, "en", "s")]
    chosen = {i for i in good if good[i] and i % 2} | {100}
    found = {r[0]: grams(r[1]) for r in rows}
    counts = [Counter(g for i in found if i in chosen for g in found[i]), Counter(g for i in found for g in found[i])]
    sizes = [sum(c.values()) for c in counts]
    want = {}
    for i, own in found.items():
        logs = []
        for g in own:
            mine = [own.count(g) * (i in chosen), own.count(g)]
            p = [(c[g] - m + s / quality.BUCKETS) / s for c, m, s in zip(counts, mine, sizes, strict=True)]
            logs.append(math.log(p[0]) - math.log(p[1]))
        want[i] = (len(own), quality.EVIDENCE * sum(logs) / len(logs) if own else None)
    got = quality.resampled(helpers.documents(spark, rows), spark.createDataFrame([(i,) for i in sorted(chosen)], "_id long"), share=0.5).collect()
    for r in got:
        assert r.n_grams == want[r.doc_id][0]
        assert r.log_weight is None if want[r.doc_id][1] is None else math.isclose(r.log_weight, want[r.doc_id][1], rel_tol=1e-9, abs_tol=1e-9)
    order = sorted(got, key=lambda r: (r["sum"] is None, -(r["sum"] or 0), r.doc_id))
    assert [r.place for r in order] == list(range(1, len(got) + 1))
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in order[: round(0.5 * len(got))]}
