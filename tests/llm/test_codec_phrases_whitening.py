"""SentencePiece codec, phrase collocations and embedding whitening."""

import hashlib
import math
import random

import brute
import numpy as np
import pytest

from groundswell.llm import phrases, queries, sentence_pieces, whitening

MODEL = queries.vocabulary("piece_bpe_32k.model")


# --- codec -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(number):
    rng = random.Random(9)
    parts = list("abcdef ABC  \n\t.,'éßñ漢字　▁ﬁ①Å̊ ﻿😀‍\x00e") + [
        "  ", "the ", "ing", " <s>", "</s>", "<0x41>", "￼", "▁▁", "x" * 60,
    ]
    edges = ["", " ", "   ", "\n", " \n ", "a", "▁", "a ▁ b", "word " * 50]
    return edges + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(number)]


def same_as_library(codec, model, text):
    raw = text.encode()
    ids, starts, ends = codec.encode(raw)
    assert ids.tolist() == model.encode(text, add_bos=True, add_eos=True)
    pieces = model.encode(text, return_type="proto").pieces
    spans = list(zip(starts[1:-1].tolist(), ends[1:-1].tolist()))
    assert spans == [(p.begin, p.end) for p in pieces], text
    assert [raw[a:b].decode() for a, b in spans] == [p.surface for p in pieces]


def test_ids_and_spans_equal_the_library(library):
    codec = sentence_pieces.Codec(sentence_pieces.read_model(MODEL))
    for text in odd_texts(1500):
        same_as_library(codec, library, text)


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_longest_prefixes_of_a_compiled_map(prefix, squeeze):
    """The library's own character map (nmt_nfkc) put into the model."""
    import sentencepiece

    fields, message = sentence_pieces.fields, sentence_pieces._message
    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = next(v for f, v, _ in fields(made) if f == sentence_pieces.NORMALIZER)
    body = b"".join(w for f, _, w in fields(spec) if f not in (3, 4, 5))
    body += bytes([3 << 3, prefix, 4 << 3, squeeze, 5 << 3, 1])
    own = sentence_pieces.read_model(MODEL)
    rest = b"".join(w for f, _, w in fields(own) if f != sentence_pieces.NORMALIZER)
    model = rest + message(sentence_pieces.NORMALIZER, body)
    codec = sentence_pieces.Codec(model)
    assert codec.map.starts
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in odd_texts(500):
        same_as_library(codec, library, text)


def test_bytes_that_are_no_text(library):
    raw = b"ab\xff\xe6\xbc cd"
    codec = sentence_pieces.Codec(sentence_pieces.read_model(MODEL))
    ids, starts, ends = codec.encode(raw)
    assert ids.tolist() == library.encode("ab��� cd", add_bos=True, add_eos=True)
    assert ends[-1] == len(raw) and (np.diff(starts[1:-1]) >= 0).all()


def test_chunks_that_are_forgotten_and_blocks(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "STORED", 5)
    monkeypatch.setattr(sentence_pieces, "BLOCK", 16)
    codec = sentence_pieces.Codec(sentence_pieces.read_model(MODEL))
    for text in odd_texts(300):
        same_as_library(codec, library, text)


def test_models_of_other_kinds_are_refused():
    fields = sentence_pieces.fields
    model = sentence_pieces.read_model(MODEL)
    bare = b"".join(w for f, _, w in fields(model) if f != sentence_pieces.TRAINER)
    with pytest.raises(ValueError):
        sentence_pieces.Codec(bare)


def test_codec_report_and_its_parts(spark, docs, no_docs, texts, library):
    sha = lambda data: hashlib.sha256(data).hexdigest()
    repeated = docs.union(docs.limit(3))
    report = [r.asDict() for r in sentence_pieces.codec_report(repeated, MODEL).collect()]
    assert len(report) == repeated.count()
    by_id = {r["doc_id"]: r for r in report}
    encoded = sentence_pieces.encode_texts(docs, MODEL)
    decoded = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_ids(encoded, MODEL).collect()}
    lists = {r["doc_id"]: r for r in encoded.collect()}
    for doc_id, text in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert lists[doc_id]["ids"] == ids
        assert decoded[doc_id] == library.decode(ids)
        raw = (text or "").encode()
        assert lists[doc_id]["ends"][-1] == len(raw)
        row = by_id[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert row["decoded_sha256"] == sha(library.decode(ids).encode())
    assert sentence_pieces.codec_report(no_docs, MODEL).count() == 0
    empty = spark.createDataFrame([(None, None), (1, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in sentence_pieces.decode_ids(empty, MODEL).collect()] == ["", ""]


def test_codec_on_a_table(small, library):
    docs = small("documents")
    found = {r["doc_id"]: r["ids_sha256"] for r in sentence_pieces.codec_report(docs, MODEL).collect()}
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_bos=True, add_eos=True)
        assert found[row["doc_id"]] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


# --- phrases ---------------------------------------------------------------------------


def phrase_texts():
    rng = random.Random(4)
    words = ["a", "b", "c", "New", "york", "CITY", "ünï", "x=1", " ", "漢", "the"]
    texts = []
    for i in range(150):
        n = rng.randint(0, 60)
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for _ in range(n))
        texts.append((text + " new york city", ["en", "de", None][i % 3]))
    texts += [(None, "en"), ("", "de"), (" .;,\x0b\x0c\r\n", None), ("a " * 400, "en"), ("b" * 5000, "fr")]
    texts += [("one two", "it")] * 12 + [("three four five", "it")] * 9
    return texts


def collocation_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 300)
    monkeypatch.setattr(phrases, "BLOCK", 64)
    texts = phrase_texts()
    rows = [(i, t, lang, "x", i) for i, (t, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, total string, place long")
    found = phrases.collocations(docs.repartition(3), longest=longest)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute.collocations(texts, longest)
    assert want and collocation_rows(found) == want


def test_collocations_top_and_least(spark):
    texts = phrase_texts()
    docs = spark.createDataFrame([(t, lang) for t, lang in texts], "text string, lang string")
    found = phrases.collocations(docs, least=3, covered=90, top=7)
    assert collocation_rows(found) == brute.collocations(texts, 3, 3, 90, 7)


def test_collocations_of_nothing(spark, no_docs):
    assert phrases.collocations(no_docs).count() == 0
    blank = spark.createDataFrame([(None, None), ("", "en"), ("only once said", "en")], "text string, lang string")
    assert phrases.collocations(blank).count() == 0


def test_index_intervals_are_occurrences():
    """Every interval, grown to the right and to the left, against a plain count."""
    rng = np.random.default_rng(2)
    places = np.concatenate([[0], rng.integers(0, 5, 400), [0]])
    text = places.tolist()

    def count(*phrase):
        return sum(tuple(text[i : i + len(phrase)]) == phrase for i in range(len(text)))

    mirrored = phrases.Index(places, 1, mirrored=True)
    words = np.arange(1, 5)
    begins, sizes = phrases._before(mirrored.counts)[words], mirrored.counts[words]
    parent, symbol, smaller, size, _ = mirrored.extend(begins, sizes)
    pairs = {(int(words[p]), int(s)): (int(begins[p] + m), int(n)) for p, s, m, n in zip(parent, symbol, smaller, size)}
    assert {k: n for k, (_, n) in pairs.items()} == {
        (a, b): count(a, b) for a in range(1, 5) for b in range(1, 5) if count(a, b)
    }
    forward = phrases.Index(places, 2)
    keys = list(pairs)
    begin, size = (np.array([pairs[k][x] for k in keys]) for x in (0, 1))
    parent, symbol, _, size, row = forward.extend(begin, size)
    steps = forward.steps()
    for p, s, n, r in zip(parent, symbol, size, row):
        assert count(int(s), *keys[p]) == n
        around = pairs[int(s), keys[p][0]]
        assert around[0] <= steps[r] < around[0] + around[1]


# --- whitening -------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, n long, whitened string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS).repartition(3)


def whitened_rows(df):
    out = {}
    for r in df.orderBy("component").collect():
        out.setdefault(r["vec_id"], []).append(r)
    return out


def same_as_brute(found, rows, components=4):
    want, n, explained = brute.whitening(rows, components)
    assert set(found) == set(want)
    signs = None
    for i, (deviation, white) in want.items():
        got = found[i]
        assert [r["component"] for r in got] == list(range(1, len(white) + 1))
        assert {r["deviation"] for r in got} == {deviation} and {r["n"] for r in got} == {n}
        np.testing.assert_allclose([r["explained"] for r in got], explained, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in got)
        values = np.array([r["whitened"] for r in got])
        if signs is None:
            signs = np.sign(values * white)
        np.testing.assert_allclose(values, signs * white, atol=1e-8)


def odd_vectors(dim=7):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=dim) * np.arange(1, dim + 1) - 0.3).tolist()) for i in range(80)]
    rows += [(200 + k, rows[5][1]) for k in range(40)]  # a hot vector counts once
    rows += [(300, [0.0] * dim), (301, [-0.0] * dim), (302, [1e-9] * dim), (303, [-1e-9] * dim)]
    bad = [None, [], [1.0] * (dim - 1) + [None], [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [1e300] * dim]
    return rows, [(400 + i, v) for i, v in enumerate(bad)]


def test_whitening_equals_brute_force(spark):
    rows, bad = odd_vectors()
    found = whitened_rows(whitening.whiten(vector_table(spark, rows + bad)))
    same_as_brute(found, rows)


def test_whitening_far_from_zero(spark):
    """Centred before multiplying: a large common offset costs no digits."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-50, 50, 5) / 256 + 1e10).tolist()) for i in range(60)]
    near = [(i, [c - 1e10 for c in v]) for i, v in rows]
    far, close = (whitened_rows(whitening.whiten(vector_table(spark, x))) for x in (rows, near))
    for i in far:
        assert [r["deviation"] for r in far[i]] == [r["deviation"] for r in close[i]]
        np.testing.assert_allclose([r["whitened"] for r in far[i]], [r["whitened"] for r in close[i]], rtol=1e-12)


def test_whitening_of_few_and_flat_vectors(spark):
    assert whitening.whiten(vector_table(spark, []).limit(0)).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, None), (2, [])])).count() == 0
    alone = whitened_rows(whitening.whiten(vector_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])))
    for got in alone.values():
        assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [
            (1, 0, None, None, None)
        ] * 2
    line = [(i, [float(i), float(2 * i), 0.0]) for i in range(10)]
    for got in whitened_rows(whitening.whiten(vector_table(spark, line))).values():
        assert [r["whitened"] is None for r in got] == [False, True, True]
        assert got[0]["explained"] == pytest.approx(1.0) and got[0]["identity_error"] < 1e-9


def test_lengths_are_fitted_apart(spark):
    rows, _ = odd_vectors()
    other = [(1000 + i, v[:3]) for i, v in rows]
    found = whitened_rows(whitening.whiten(vector_table(spark, rows + other)))
    same_as_brute({i: r for i, r in found.items() if i < 1000}, rows)
    same_as_brute({i: r for i, r in found.items() if i >= 1000}, other)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**52) * (i % 5), float(i), -float(2**53) * (i % 3)]) for i in range(20)]
    want, n, _ = brute.whitening(rows, 2)
    for i, got in whitened_rows(whitening.whiten(vector_table(spark, rows), 2)).items():
        exact = want[i][0]
        assert {r["deviation"] for r in got} == {exact if exact < 2**63 else None}


def test_whitening_on_a_table(small):
    table = small("embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    same_as_brute(whitened_rows(whitening.whiten(table)), rows)


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40])
def test_counts_and_leading_pairs(size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(size, size))
    spread = base * 10.0 ** rng.uniform(-6, 6, size)
    for matrix in (base @ base.T, base + base.T, spread @ spread.T, np.eye(size) * 3, np.zeros((size, size))):
        values = np.linalg.eigvalsh(matrix)[::-1]
        gap = np.abs(values).max() * 1e-10
        for shift in rng.uniform(values[-1] - 1, values[0] + 1, 20):
            if np.abs(values - shift).min() > gap:
                assert whitening.count_above(matrix, shift) == (values > shift).sum()
        pairs = whitening.leading_pairs(matrix, 4)
        axes = np.array([axis for _, axis in pairs])
        scale = max(np.abs(values).max(), 1e-300)
        np.testing.assert_allclose([v for v, _ in pairs], values[: len(pairs)], atol=1e-13 * scale)
        np.testing.assert_allclose(axes @ axes.T, np.eye(len(pairs)), atol=1e-12)
        for value, axis in pairs:
            assert np.linalg.norm(matrix @ axis - value * axis) <= 1e-12 * scale
