import zlib

import helpers
import numpy as np

from laurel.llm import toxicity

STEMS = ["grumf", "blarg", "snorkelig"]
ENDS = ["en", "ung", "ista", "ole", "ur", "and"]


def corpus(count, seed=0):
    rng = np.random.default_rng(seed)
    syllables = ["an", "the", "or", "in", "ea", "st", "ou", "nd", "re", "ti"]
    docs, labels = [], []
    for i in range(count):
        words = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(rng.integers(20, 200))]
        toxic = bool(rng.random() < 0.2)
        if toxic:
            for at in rng.integers(0, len(words), max(2, len(words) // 20)):
                words[at] = str(rng.choice(STEMS)) + str(rng.choice(ENDS))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_labels_are_found(spark, tmp_path):
    docs, labels = corpus(1500)
    folder = helpers.write(helpers.documents(spark, docs), tmp_path, "documents")
    helpers.write(spark.createDataFrame(labels, "doc_id long, toxic int"), tmp_path, "labels")
    rows = toxicity.op3_toxicity(spark, folder).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if truth[r.doc_id]]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_counts_match_plain_python(spark):
    docs, labels = corpus(60, 3)
    part = [t + 2 * (i % 3 == 0) for i, t in labels]
    df = spark.createDataFrame([(d[1], p) for d, p in zip(docs, part, strict=True)], "text string, part int").repartition(4)
    got = toxicity.step_counts(df).where("level = 0").select("a0", "a1", "b0", "b1").collect()
    want = {}
    for d, p in zip(docs, part, strict=True):
        for w in set(d[1].split()):
            step = (w[:4], len(w) <= 4)
            want.setdefault(step, [0, 0, 0, 0])[p] += 1
    assert sorted(map(list, got)) == sorted(want.values())


def test_awkward_rows_and_labels(spark):
    docs = helpers.documents(spark, helpers.AWKWARD)
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.p for r in none.score(docs, ["doc_id"], "p").collect()} == {0.0}
    some = [(1, 1), (1, 0), (5, 0), (6, None), (None, 1), (7, 0), (8, 0), (9, 1), (99, 1)]
    model = toxicity.learn(docs, spark.createDataFrame(some, "doc_id long, toxic int"))
    out = model.score(docs, docs.columns, "p")
    assert out.columns == [*docs.columns, "p"]
    rows = out.collect()
    assert len(rows) == len(helpers.AWKWARD) and all(0 <= r.p <= 1 for r in rows)
    assert model.score(docs.limit(0), ["doc_id"]).count() == 0


def test_nodes_that_share_low_bits_stay_apart(spark):
    rows = [(0, 7, 0, 9, 1), (0, 7 + (1 << 20), 0, 1, 9), (0, 7 + (5 << 40), 0, 2, 2), (0, -7, 0, 1, 1)]
    counts = spark.createDataFrame(rows, "level int, node long, parent long, a0 long, a1 long")
    known, below = toxicity.tables(toxicity._ratios(counts, counts.a0, counts.a1))
    nodes = np.array([7, 7 + (1 << 20), 7 + (5 << 40), -7, 7 + (2 << 20), 8], np.int64)
    got = known.get(nodes)
    assert got[0] < got[2] < got[1] and np.isnan(got).tolist() == [False] * 4 + [True] * 2
    assert np.isnan(below.get(np.array([0, 1 << 20], np.int64))).tolist() == [False, True]


def test_parts_give_what_one_table_gives(spark):
    rng = np.random.default_rng(2)
    nodes = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64))
    rows = [(i % 3 > 0, int(n), float(i)) for i, n in enumerate(nodes)]
    ratios = spark.createDataFrame(rows, "known boolean, at long, value float")
    whole, parts = toxicity.tables(ratios), toxicity.tables(ratios, size=300)
    assert [len(t.parts) for t in whole] == [1, 1] and [len(t.parts) for t in parts] == [16, 8]
    asked = np.append(nodes, rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64))
    for one, many in zip(whole, parts, strict=True):
        assert np.array_equal(one.get(asked), many.get(asked), equal_nan=True)
        many.destroy()


def test_the_model_grows_with_the_words():
    rng = np.random.default_rng(1)
    nodes = np.unique(rng.integers(-(2**63), 2**63 - 1, (1 << 20) + 5000, dtype=np.int64))
    values = np.arange(len(nodes)).astype(np.float32)
    assert (toxicity.Ratios(nodes, values).get(nodes) == values).all()
    assert np.isnan(toxicity.Ratios(nodes[:0], values[:0]).get(nodes[:3])).all()


def scores(spark, docs, labels, asked):
    model = toxicity.learn(helpers.documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    return [r.score for r in sorted(model.score(rows, ["doc_id"]).collect(), key=lambda r: r.doc_id)]


def test_text_beyond_a_prefix_counts(spark):
    docs, labels = corpus(600, 5)
    rng = np.random.default_rng(6)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 60)]
    for i in range(600, 1200):
        text = "".join(rng.choice(signs, 120))
        toxic = bool(rng.random() < 0.3)
        if toxic:  # two signs that ordinary texts do not have, far behind the first bytes
            for at in (40, 60, 80, 100):
                text = text[:at] + "毒物" + text[at:]
        docs.append((i, text, "zh", "s"))
        labels.append((i, int(toxic)))
    plain = ["".join(rng.choice(signs, 120)) for _ in range(2)]
    hidden = plain[0][:50] + "毒物" + plain[0][50:80] + "毒物" + plain[0][80:]
    joined = docs[0][1].replace(" ", "-")
    toxic = "-".join([*docs[0][1].split()[:40], "grumfen", "blargung", "snorkeligole"])
    got = scores(spark, docs, labels, [plain[0], hidden, joined.split("grumf")[0], toxic])
    assert got[0] < 0.5 < got[1] and got[2] < got[3]


def test_long_words_that_begin_alike_are_told_apart(spark):
    texts = [("donaudampfschiffblume " if i % 3 else "donaudampfschiffgrumf ") + f"wort{i % 7} und mehr" for i in range(400)]
    labels = [(i, int(i % 3 == 0)) for i in range(400)]
    docs = [(i, t, "de", "s") for i, t in enumerate(texts)]
    clean, toxic = scores(spark, docs, labels, ["donaudampfschiffblume und", "donaudampfschiffgrumf und"])
    assert clean < toxic


def test_many_mild_words_and_ordinary_words_count(spark):
    rng = np.random.default_rng(8)
    mild, usual, rest = ([f"{x}{i}" for i in range(40)] for x in ("mild", "kind", "some"))
    docs, labels = [], []
    for i in range(600):
        toxic = bool(rng.random() < 0.4)
        words = [*rng.choice(mild, 30 if toxic else 18), *rng.choice(usual, 18 if toxic else 30), *rng.choice(rest, 20)]
        docs.append((i, " ".join(rng.permutation(words)), "en", "s"))
        labels.append((i, int(toxic)))
    toxic, empty, ordinary = scores(spark, docs, labels, [" ".join(mild * 2), "", " ".join(usual * 2)])
    assert ordinary < empty < toxic
