import hashlib
import random

import helpers
import pytest

from laurel.llm import substrings


def brute(rows):
    """Rows in order of id, null first; ids must be unique or their texts equal."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = helpers.words(text)
        removed = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                removed[s : s + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, r in zip(words, removed, strict=True) if not r)
        out.append((doc, len(words), sum(removed), hashlib.sha256(kept.encode()).hexdigest()))
    return helpers.plain(out)


def rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)]
    passages = [[rng.choice(vocabulary) for _ in range(80)] for _ in range(5)]
    out = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            elif kind < 0.8:
                at = rng.randrange(60)
                words += rng.choice(passages)[at : at + rng.randint(15, 80)]
            else:
                words += ["ing"] * rng.randint(1, 50)
        out.append((100 + i, rng.choice([" ", "  ", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_repeats_go_but_for_the_first(spark, tmp_path, parts):
    data = rows(parts) + [(r[0], r[1]) for r in helpers.AWKWARD if r[0] is not None] + [(None, helpers.LONG)]
    docs = helpers.documents(spark, [(*r, "en", "s") for r in data]).repartition(parts)
    folder = helpers.write(docs, tmp_path, "documents")
    assert helpers.plain(substrings.op10_substrings(spark, folder).collect()) == brute(data)


def test_equal_rows_keep_one_and_nothing_is_no_text(spark):
    text = " ".join(f"x{i}" for i in range(40))
    docs = helpers.documents(spark, [(1, text, "en", "s")] * 3 + [(2, None, None, None)])
    got = helpers.plain(substrings.without_repeats(docs).select("doc_id", "n_removed", "text").collect())
    assert got == [(1, 0, text), (1, 40, ""), (1, 40, ""), (2, 0, "")]
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_repeats_share_an_early_cut():
    import numpy as np

    rng = np.random.default_rng(3)
    data = {"doc_ids": [1], "size": 0}
    for _ in range(100):
        repeat = " ".join(f"r{x}" for x in rng.integers(0, 4, 20))
        found = []
        for _ in range(2):
            before = [f"r{x}" for x in rng.integers(0, 4, rng.integers(0, 12))]
            after = [f"r{x}" for x in rng.integers(0, 4, rng.integers(0, 12))]
            text = " ".join([*before, repeat, *after]).encode()
            import pyarrow as pa

            block = substrings.Block(data | {"size": len(text), "lengths": [len(text)], "data": pa.compress(text, "zstd", asbytes=True)})
            at, names = block.cuts()
            inside = (at >= len(before)) & (at <= len(before) + substrings.LOST)
            found.append(set(zip((at[inside] - len(before)).tolist(), names[inside].tolist(), strict=True)))
        assert found[0] & found[1]
