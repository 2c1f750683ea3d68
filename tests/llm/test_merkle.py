import hashlib
import zlib
from itertools import groupby

import helpers
import pytest

from laurel.llm import merkle
from laurel.llm.order import running


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(digests):
    """The top of a tree and, for each of its leaves, the (left, right) pairs up to it."""
    paths, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(place):
            low = at // 16 * 16
            paths[i].append(("".join(digests[low:at]), "".join(digests[at + 1 : low + 16])))
            place[i] = at // 16
        digests = [sha(*digests[i : i + 16]) for i in range(0, len(digests), 16)]
    return digests[0] if digests else None, paths


def plain(rows):
    def source(r):
        return (r[3] is not None, (r[3] or "").encode())

    rows = sorted(rows, key=lambda r: (source(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=source)]
    tops = [climbed([leaf(r) for r in g]) for g in groups]
    root, above = climbed([t for t, _ in tops])
    out = []
    for g, (top, paths), up in zip(groups, tops, above, strict=True):
        for r, path in zip(g, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, lower=hit)
            for left, right in path + up:
                fold = sha(left, fold, right)
            out.append((r[0], leaf(r), top, root, sha(*(x for p in path + up for x in p)), fold, fold == root))
    return helpers.plain(out)


def found(docs):
    return helpers.plain(merkle.verified(merkle.manifest(docs, merkle.tampered(docs))).collect())


@pytest.mark.parametrize("sizes", [[1], [17], [1, 16, 257, 3], [2] * 20, [600]])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(i * 1000 + j, f"Text {j * 7 % 5} of {i}", "en", f"s{i:02d}", j) for i, n in enumerate(sizes) for j in range(n)]
    assert found(helpers.documents(spark, rows)) == plain(rows)


def test_awkward_rows(spark):
    rows = [(*r, 0) for r in helpers.AWKWARD]
    docs = helpers.documents(spark, helpers.AWKWARD)
    assert found(docs) == plain(rows)
    assert found(docs.limit(0)) == []
    only = merkle.manifest(docs.where("doc_id = 9")).collect()
    assert len(only) == 1 and only[0].leaf == only[0].root == only[0].subroot and only[0].path == []


def test_running_goes_over_ranges(spark):
    rows = [(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i % 50}", i, i * i, i * 7919) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i long, a long, x long").repartition(5)
    got = {r.i: r for r in running(df, "k", ["i"], adds=["a"], xors=["x"]).collect()}
    keys = sorted({r[0] for r in rows}, key=lambda k: (k is not None, k or ""))
    for key in keys:
        a = x = 0
        for row in (r for r in rows if r[0] == key):
            a, x = a + row[2], x ^ row[3]
            assert (got[row[1]].a, got[row[1]].x, got[row[1]]._number) == (a, x, keys.index(key))
    assert running(df.limit(0), "k", ["i"], adds=["a"]).count() == 0
