import random

import helpers
import pytest

from laurel.llm import jaccard


def brute(rows):
    sets, link = [], helpers.Sets()
    for _, text in rows:
        w = helpers.words(text, lower=True)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                link.join(rows[i][0], rows[j][0])
    return helpers.plain((d, len(s), None if d is None else link.find(d) if s else d) for (d, _), s in zip(rows, sets, strict=True))


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    for _ in range(50):
        out.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] + common))
        out.append(" ".join(common[: rng.randint(8, 30)]))
    return out + ["a b c", "A b  c", "a", "a", "a b c d e", "a b c d e f", "a b c d e f g h i j k l", "a b c d e f g h i j k m"]


@pytest.mark.parametrize("small", [False, True])
def test_every_link_is_found(spark, monkeypatch, small):
    if small:  # many common shingles, divided components
        monkeypatch.setattr(jaccard, "COMMON", 6)
        monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = [(10 + i, t) for i, t in enumerate(texts())] + [(r[0], r[1]) for r in helpers.AWKWARD if r[0] != 5] + [(5, "one two")]
    docs = helpers.documents(spark, [(*r, "en", "s") for r in rows]).repartition(4)
    got = helpers.plain(jaccard.similar(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_own_shingles_do_not_crowd_out_the_common_ones(spark, monkeypatch):
    """Documents of a common text and a fifth of their own, all like the common text and unlike each other."""
    monkeypatch.setattr(jaccard, "COMMON", 3)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(125)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        rows.append((i, " ".join(base + [f"own{i}x{rng.randrange(10**9)}" for _ in range(28)])))
    docs = helpers.documents(spark, [(*r, "en", "s") for r in rows]).repartition(4)
    got = helpers.plain(jaccard.similar(docs).collect())
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_a_posted_prefix_holds_what_any_partner_shares():
    import numpy as np

    for n in range(1, 2000):
        share = int(jaccard.posted(np.array([n]))[0]) - n // 5
        assert share <= n - n // 5
        for m in (n, -(-4 * n // 5)):
            # Both sets' prefixes hold this many common shingles at least.
            assert min(share, int(jaccard.posted(np.array([m]))[0]) - m // 5) >= n // 25 + 1


def test_one_document_of_a_group_stays(spark):
    docs = helpers.documents(spark, helpers.AWKWARD)
    out = jaccard.deduplicated(docs)
    assert out.columns == docs.columns
    # 6 is 1 in other case, 8 is nearly 7; rows without words or id stay, and one of the equal rows of 5.
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, None, None, 9]))
    assert jaccard.similar(docs.limit(0)).count() == 0


def test_bit_counts_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        both = rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64)
        x, y = (np.unique(np.append(both, rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))) for _ in range(2))
        n = np.array([len(x), len(y)])
        bits = jaccard.bitmaps(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        common = len(np.intersect1d(x, y))
        linked = 100 * common >= 80 * (len(x) + len(y) - common)
        assert jaccard.exact(x, y) == linked
        assert not linked or jaccard.may_link(n, bits, np.array([0]), np.array([1]))[0]
