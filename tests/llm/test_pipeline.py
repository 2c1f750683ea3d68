import hashlib
import math
import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import public_tokenizers
import test_decontamination
import test_jaccard
import test_toxicity
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline


def brute_mix(rows):
    """Copies of each (doc_id, source, size)."""
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    goal, fixed = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        total = sum(weight[s] for s in order if s not in fixed)
        goal = {s: 3 * sizes[s] if s in fixed else left * weight[s] / total for s in order}
        above = {s for s in order if s not in fixed and goal[s] > 3 * sizes[s]}
        if not above:
            break
        fixed |= above
    out = Counter()
    for source in order:
        key = hashlib.md5(f"0:s{source}".encode() if source is not None else b"0:null").hexdigest()
        offset, each = int(key[:8], 16) / 2**32, goal[source] / sizes[source] if sizes[source] else 0.0
        own = sorted((z, hashlib.md5(f"0:{d}".encode()).hexdigest(), d) for d, s, z in rows if s == source)
        for rank, (_, _, d) in enumerate(own, 1):
            out[d] += min(math.floor(rank * each + offset) - math.floor((rank - 1) * each + offset), math.ceil(each))
    return +out


def test_stages_match_plain_python(spark, tmp_path):
    docs, labels = test_toxicity.corpus(900, 5)
    clean = [d for d, (_, t) in zip(docs, labels, strict=True) if not t]
    bench = [(i, " ".join(clean[i][1].split()[:25])) for i in range(6)]
    rows = [(d, t, "en", f"s{d % 4}", len(t)) for d, t, *_ in docs]
    rows += [(2000 + i, clean[i % 30][1] + " more", "en", "s1", 1) for i in range(60)]
    rows += [(3000 + i, clean[50 + i][1] + " " + bench[i % 6][1], "en", None, 1) for i in range(12)]
    rows += [(4000, None, None, "s2", None), (4001, "", "en", "s2", 0)]
    folder = str(tmp_path)
    helpers.documents(spark, rows, clashing=False).repartition(4).write.parquet(f"{folder}/documents.parquet")
    helpers.write(spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    helpers.write(spark.createDataFrame(bench, "item_id long, text string"), tmp_path, "benchmark")

    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], folder).write.parquet(f"{folder}/stage{i}")
        frames.append(spark.read.parquet(f"{folder}/stage{i}"))
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    truth = dict(labels)
    gone = set(texts[0]) - set(texts[1])
    assert np.mean([d in gone for d, t in truth.items() if t]) > 0.9
    assert np.mean([d in gone for d, t in truth.items() if not t]) < 0.02
    similar = {d: c for d, _, c in test_jaccard.brute(sorted(texts[1].items()))}
    assert set(texts[2]) == {d for d, c in similar.items() if d == c}
    leaks = {d for d, _ in test_decontamination.brute(sorted(texts[2].items()), bench)}
    assert set(texts[3]) == set(texts[2]) - leaks
    before = frames[3].collect()
    mixed = Counter(r.doc_id for r in frames[4].collect())
    assert mixed == brute_mix([(r.doc_id, r.source, len(helpers.words(r.text))) for r in before])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for doc in sorted(mixed):
        ids = [*library.encode(texts[4][doc] or "", add_special_tokens=False).ids, 2]
        for _ in range(mixed[doc]):
            want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, frames[5].collect())) == want
    run = entry.queries()["pipeline"](spark, folder)
    assert sorted(map(tuple, run.collect())) == want
