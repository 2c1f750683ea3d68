import random
import re

import helpers
import numpy as np
import pyarrow as pa
import pytest

from laurel.llm import quality_rules as rules
from laurel.llm import words as word_arrays


def counts(text):
    text = text or ""
    words = helpers.words(text)
    lines = [x for x in text.split("\n") if helpers.words(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def random_text(draw):
    base = ["aa", "b#", "é|é", "日本", "c", "\n", "\n", "  ", "\n\n", "\t", "x" * 9]
    return " ".join(draw.choice(base) for _ in range(draw.randint(0, 120))) if draw.random() < 0.5 else "".join(draw.choice(base) for _ in range(60))


def test_counts_equal_plain_python():
    draw = random.Random(5)
    texts = [random_text(draw) for _ in range(400)] + ["", "\n", "a\n", "a\na", "a\na\n", "\na", "a b c d e f g h " * 5] + [r[1] for r in helpers.AWKWARD]
    got = [tuple(int(m[c][i]) for c in rules.COUNTS) for slab in word_arrays.slabs(pa.array(texts, pa.string()), size=700) for m in [rules.measures(slab)] for i in range(len(slab.counts))]
    assert got == [counts(t) for t in texts]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(" ".join(f"w{i % 91}" * (1 + i % 13) for i in range(3000)).encode(), np.uint8)
    starts, ends, _ = word_arrays.spans(data, np.array([0, len(data)]))
    whole = word_arrays.span_hashes(data, starts, ends)
    monkeypatch.setattr(word_arrays, "HASHED_BYTES", 17)
    assert (word_arrays.span_hashes(data, starts, ends) == whole).all()


def test_buckets_are_ordered_and_close(spark):
    got = spark.range(0, 200_000, 7).select("id", rules.bucket(rules.F.col("id")).alias("b")).withColumn("low", rules.least(rules.F.col("b"))).collect()
    assert [r.b for r in got] == sorted(r.b for r in got)
    assert all(r.low <= r.id and (r.id - r.low) * 32 <= r.id for r in got)
    assert all(r.low == r.id for r in got if r.id < rules.EXACT)


def plain_limits(values, slack, two_sided):
    def bucket(v):
        shift = max(v.bit_length() - 6, 0)
        return 32 * shift + (v >> shift)

    def low(b):
        shift = max(b // 32 - 1, 0)
        return (b - 32 * shift) << shift

    ordered = sorted(map(bucket, values))
    q = [low(ordered[-(-k * len(ordered) // 4) - 1]) for k in (1, 2, 3)]
    return q[1] + 3 * (q[2] - q[1]) + slack, q[1] - 3 * (q[1] - q[0]) - slack if two_sided else None


def test_verdicts_equal_plain_python(spark):
    draw = random.Random(9)
    rows = []
    for i in range(900):
        lang, source = draw.choice(["en", "de", None]), draw.choice(["a", "a", "b", None])
        size = {"en": 4, "de": 9, None: 6}[lang]
        text = " ".join("".join(draw.choice("abcdefgh") for _ in range(max(1, size + draw.randint(-1, 1)))) for _ in range(draw.randint(15, 60)))
        text = text.replace(" ", "### ") if i % 31 == 0 else text.replace(" ", "") if i % 37 == 0 else "\n".join([text] * 3) if i % 41 == 0 else text
        rows.append((i, text, lang, source))
    got = {r.doc_id: r for r in rules.judged(helpers.documents(spark, rows)).collect()}
    own = {r[0]: dict(zip(rules.COUNTS, counts(r[1]), strict=True)) for r in rows}

    def value(m, i):
        return 1000 * own[i][m.part] // own[i][m.whole] if own[i][m.whole] else None

    for i, _, lang, source in rows:
        scopes = [[r[0] for r in rows if (r[2], r[3]) == (lang, source)], [r[0] for r in rows if r[2] == lang], [r[0] for r in rows]]
        scope = next((s for s in scopes[:2] if len(s) >= rules.SUPPORT), scopes[2])
        failed = []
        for m in rules.MEASURES:
            most, least = plain_limits([value(m, j) for j in scope], m.slack, m.two_sided)
            if value(m, i) > most or (least is not None and value(m, i) < least):
                failed.append(m.name)
        base = own[i]["n_words"] < 20 or 100 * own[i]["n_repeat_words"] > 30 * own[i]["n_words"]
        assert (got[i].base_failed, got[i].failed, got[i].kept) == (base, failed, not base and not failed)
        if i % 31 == 0 and not base:
            assert "symbols" in failed


def test_a_long_normal_word_of_one_language_is_kept(spark):
    """A cutoff for all languages would drop the language with long words, or keep the other's junk."""
    rows = [(i, " ".join(["tree" if i % 2 else "donaudampfschiff" + "x" * (j % 3) for j in range(40)] + [f"u{i}"]), "en" if i % 2 else "de", "s") for i in range(400)]
    rows = [(i, " ".join(f"{w}{j}" for j, w in enumerate(t.split())), lang, s) for i, t, lang, s in rows]
    rows.append((1000, " ".join(f"donaudampfschiff{j}" for j in range(40)), "en", "s"))
    got = {r.doc_id: r for r in rules.judged(helpers.documents(spark, rows)).collect()}
    assert all(got[i].kept for i in range(400)) and got[1000].failed == ["word_length"]


def test_awkward_rows(spark):
    docs = helpers.documents(spark, helpers.AWKWARD)
    got = rules.judged(docs)
    assert helpers.plain(got.select("doc_id", *rules.COUNTS).collect()) == helpers.plain([(r[0], *counts(r[1])) for r in helpers.AWKWARD])
    assert all(not r.kept for r in got.where("n_words < 20").collect())
    assert rules.judged(docs.limit(0)).count() == 0
    assert [r.kept for r in rules.judged(docs.where("text IS NULL")).collect()] == [False, False]


@pytest.mark.parametrize("size", [1, 99, 100])
def test_small_groups_take_wider_thresholds(spark, size):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "big") for i in range(300)] + [(1000 + i, " ".join(f"wordy{i}word{j}" for j in range(30)), "en", "own") for i in range(size)]
    kept = [r.kept for r in rules.judged(helpers.documents(spark, rows)).where("doc_id >= 1000").collect()]
    assert len(kept) == size and all(kept) == (size >= rules.SUPPORT)
