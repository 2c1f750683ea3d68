import random
from collections import Counter

import helpers

from laurel.llm import decontamination


def shingles(text):
    w = helpers.words((text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute(docs, items):
    """The best of all windows, not only of those at anchors."""
    out = {}
    for doc, text in {(d, t) for d, t in docs}:
        s = shingles(text)
        for item, passage in items:
            i = Counter(shingles(passage))
            n = sum(i.values())
            for start in range(max(1, len(s) - n + 1)) if s and n else ():
                w = Counter(s[start : start + n])
                common = sum((i & w).values())
                union = n + sum(w.values()) - common
                if 100 * common >= 80 * union:
                    out[doc, item] = max(out.get((doc, item), 0), common / union)
    return out


def test_every_similar_window_is_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 50)))) for i in range(12)]
    items += [(20, "a b c"), (21, None), (22, ""), (23, "x x x x x x x x x x"), (24, items[0][1])]
    docs = []
    for d in range(150):
        passage = rng.choice(items[:12])[1].split()
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        around = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        cut = rng.randint(0, len(around))
        docs.append((d, " ".join(around[:cut] + passage + around[cut:]).upper()))
    docs += [(200, "A b\tC"), (201, "a b c d"), (202, None), (203, ""), (204, "x " * 40), (None, items[1][1]), (205, helpers.LONG), (0, docs[0][1])]
    frame = helpers.documents(spark, [(*d, "en", "s") for d in docs])
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, n string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.found(frame, bench).collect()}
    assert got == brute(docs, items)
    clean = decontamination.decontaminated(frame, bench)
    dirty = {d for d, _ in got}
    assert clean.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(d) for d, _ in docs if d not in dirty)


def test_empty_tables(spark):
    docs = helpers.documents(spark, helpers.AWKWARD)
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran to the park today")], "item_id long, text string")
    assert decontamination.found(docs.limit(0), bench).count() == 0
    assert decontamination.found(docs, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontamination.found(docs, bench).collect()} == {1, 6}


def test_blocks_reach_every_fingerprint_within_the_radius(spark):
    rng, base = random.Random(9), 0x0123456789ABCDEF
    far = []
    for _ in range(300):
        x = base
        for bit in rng.sample(range(64), rng.randint(0, decontamination.RADIUS)):
            x ^= 1 << bit
        far.append(x - (1 << 64 if x >> 63 else 0))
    prints = spark.createDataFrame([(i, x) for i, x in enumerate(far)], "key long, print long")
    index = decontamination.probes(spark.createDataFrame([(base,)], "print long")).select("block", "value")
    assert decontamination.blocks(prints).join(index, ["block", "value"]).select("key").distinct().count() == 300
