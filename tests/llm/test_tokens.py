"""Encoder, packed files and flat files against whole-text encoding and round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tspanel.llm.simple8b import BLOCK, pack, unpack  # noqa: E402
from tspanel.llm.text import byte_slices  # noqa: E402
from tspanel.llm.token_counts import scan_flat, token_counts  # noqa: E402
from tspanel.llm.token_output import token_output  # noqa: E402
from tspanel.llm.tokens import Encoder  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The quick, brown fox. It's 42!", "", None, "   \n\t ", "é ́x don't we'll 'S", "a<|endoftext|>b <|startoftext|>. <|x",
    "straße ÀÉ x y\x0bz\x0c. , ., a.b. a.", "x" * 5000, "w. " * 3000, '"quoted" text, with.dots.', "a.,b, c,. d", "日本語 テキスト。", "The quick, brown fox. It's 42!",
]
SCHEMA = "doc_id long, text string, n_tokens string, file string"


def expected(texts, literal):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = literal
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("literal", [True, False])
@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_pieces_equal_whole_texts(literal, limit):
    code, got = Encoder(PATH, literal), []
    for _, _, data, offsets in byte_slices(pa.array(TEXTS), limit):
        ids, lengths = code.ids(data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == expected(TEXTS, literal)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB.,' \n\x0b<|>é́2", max_size=30), min_size=1, max_size=5))
def test_pieces_equal_whole_random_texts(texts):
    code = CODE
    for _, _, data, offsets in byte_slices(pa.array(texts)):
        ids, lengths = code.ids(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == expected(texts, False)


CODE = Encoder(PATH, False)


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 3])
def test_simple8b_round_trip(n):
    r = np.random.default_rng(n)
    for v in (r.integers(0, 49408, n), np.zeros(n, int), r.integers(0, 1 << 62, n), np.where(r.random(n) < 0.5, (1 << 60) - 1, 1 << 60), np.where(r.random(n) < 0.2, 0xF << 59, 2)):
        words, sizes = pack(v.astype(np.uint64))
        assert sizes.sum() == len(words) and (unpack(words, sizes, n) == v.astype(np.uint64)).all()


def test_token_output(spark):
    rows = [(i * 7 % 13, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (3, "same id", "x", "y"), (3, "same id", "x", "y")]
    got = [tuple(r) for r in token_output(spark.createDataFrame(rows, SCHEMA), PATH).drop("file").collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n
    ids = expected([r[1] for r in rows], False)
    want = sorted((r[0] or -1, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for r, x in zip(rows, ids))
    assert sorted((d or -1, n, c) for d, _, n, c in got) == want


def test_token_output_empty(spark):
    assert token_output(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_token_counts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (3, "again", "x", "y")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_counts(spark.createDataFrame(rows, SCHEMA), PATH, 49407).collect())
    assert got == sorted((-1 if r[0] is None else r[0], len(x)) for r, x in zip(rows, expected([r[1] for r in rows], True)))
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH, 49407).count() == 0


@pytest.mark.parametrize("block", [2, 6, 10, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    """Blocks down to one id; runs of separators, none at all, an open end."""
    r = np.random.default_rng(5)
    files = {"a": r.integers(0, 4, 200), "b": np.zeros(9, int), "c": np.full(50, 7), "d": np.array([5, 0, 0, 7, 7, 7]), "e": np.zeros(0, int)}
    want = []
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes() + b"\x01")  # half an id is left over
        ends = np.flatnonzero(ids == 0).tolist()
        starts = [0, *(e + 1 for e in ends)]
        want += [(name, k, s, e - s, True) for k, (s, e) in enumerate(zip(starts, ends))]
        if starts[-1] < len(ids):
            want.append((name, len(ends), starts[-1], len(ids) - starts[-1], False))
    sizes = spark.createDataFrame([(n, 2 * len(v) + 1) for n, v in files.items()], "file string, length long")
    assert sorted(tuple(r) for r in scan_flat(sizes, str(tmp_path), 0, 2, block).collect()) == sorted(want)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A tokenizer that keeps the case and white space is told apart and encodes whole texts."""
    import json

    spec = json.loads(Tokenizer.from_file(PATH).to_str())
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    code, other = Encoder(str(tmp_path / "other.json"), False), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert CODE.by_pieces and not code.by_pieces
    got = []
    for _, _, data, offsets in byte_slices(pa.array(TEXTS), 40):
        ids, lengths = code.ids(data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [other.encode(x or "", add_special_tokens=False).ids for x in TEXTS] != expected(TEXTS, False)


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    from tspanel.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    monkeypatch.setattr(tokens, "GROUP", 2)
    code = Encoder(PATH, False)
    for _ in range(2):
        for _, _, data, offsets in byte_slices(pa.array(TEXTS), 60):
            ids, lengths = code.ids(data, offsets)
            assert len(ids) == lengths.sum()
    ids, lengths = code.ids(*next(byte_slices(pa.array(TEXTS)))[2:])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == expected(TEXTS, False)


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    from tspanel.llm.token_counts import write_flat

    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    with pytest.raises(ValueError, match="does not fit"):
        write_flat(docs, PATH, str(tmp_path), separator=70000)
    ordinary = int(CODE.ids(*next(byte_slices(pa.array(["some"])))[2:])[0][0])
    for separator, width, what in ((ordinary, 2, "is an id of a text"), (255, 1, "does not fit 1 bytes")):
        with pytest.raises(Exception, match=what):
            write_flat(docs, PATH, str(tmp_path), separator=separator, width=width)
