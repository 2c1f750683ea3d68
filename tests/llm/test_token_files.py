import zlib

import helpers
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laurel.llm import token_files
from laurel.llm.words import text_buffers


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 700))
@settings(max_examples=60, deadline=None)
def test_files_round_trip(values, low, high):
    values = np.array(values, np.uint32)
    file = token_files.TokenFile(token_files.encode_file(values, [7, None], np.array([0, len(values) // 2])))
    assert file.doc_ids == [7, None] and file.first.tolist() == [0, len(values) // 2, len(values)]
    assert (file.read(0, len(values)) == values).all()
    low, high = min(low, len(values)), min(high, len(values))
    assert (file.read(low, high) == values[low:high]).all()


TEXT = st.lists(st.one_of(st.sampled_from([" ", "\n", "a", "é", "×", "'s", "'", "don't", ".", "\t", " ", "　", "日", "\x1f", "\x85", "<|endoftext|>", "|", "9", "%%%"]), st.text(max_size=3)), max_size=25).map("".join)


@given(st.lists(TEXT, max_size=8))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_like_whole_texts(library, texts):
    import pyarrow as pa

    data, offsets = text_buffers(pa.array(texts, pa.string()))
    ids, counts = token_files.encoder(token_files.TOKENIZER).encode(data, offsets)
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == [*library.encode(text, add_special_tokens=False).ids, token_files.END_ID]


def test_a_full_table_of_pieces_starts_afresh(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "SLOTS", 1 << 8)
    own = token_files.Encoder(token_files.TOKENIZER)
    for at in range(0, 400, 20):
        texts = [f"word{i} and more{i}" for i in range(at, at + 20)]
        ids, _ = own.encode(*text_buffers(pa.array(texts)))
        assert ids.tolist() == [x for t in texts for x in [*library.encode(t, add_special_tokens=False).ids, token_files.END_ID]]


def test_one_text_may_have_more_pieces_than_the_table(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "SLOTS", 1 << 8)
    own = token_files.Encoder(token_files.TOKENIZER)
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} again{chr(97 + i % 5)}" for i in range(600))
    for texts in ([long], ["before", long, "", long + " tail"], ["after one"]):
        ids, counts = own.encode(*text_buffers(pa.array(texts)))
        want = [[*library.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
        assert ids.tolist() == [x for t in want for x in t] and counts.tolist() == list(map(len, want))


def test_files_hold_all_documents_in_order(spark, library, tmp_path):
    rows = [*helpers.AWKWARD, *[(1000 - i, f"text number {i} " * (i % 7), "en", "s") for i in range(300)]]
    docs = helpers.documents(spark, rows).repartition(5)
    manifest = token_files.write_token_files(docs, f"{tmp_path}/tokens", limit=500)
    assert manifest.count() > 3
    got = token_files.digest(token_files.read_token_files(manifest, f"{tmp_path}/tokens")).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    want = sorted((str(d), zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    assert token_files.encoded(docs.limit(0)).count() == 0
