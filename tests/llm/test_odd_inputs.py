"""Texts, names and markup that no generator of test data thinks of."""

import random

import numpy as np
import pytest

from groundswell.llm import common, html_text, line_dedup, packing, queries, substring

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


def odd_texts(seed, number):
    rng = random.Random(seed)
    marks = ["̊", "̈", "̱", "̌", "̣", "́", "̸", "͂"]
    letters = list("YTWHJAaouzİßΣ<=>'’-.,!0漢‍ 　\t\n") + ["<|", "|>", "<|endoftext|>", "  "]
    for _ in range(number):
        yield "".join(rng.choice(letters) + (rng.choice(marks) if rng.random() < 0.4 else "") for _ in range(rng.randint(1, 12)))


def test_ids_of_decomposed_capitals():
    """The tokenizer composes before it lower-cases: Y and a ring stay two signs, y and a ring do not."""
    known = packing.WordTokens(VOCABULARY)
    texts = ["Y̊", "T̈ea W̊ord", "H̱ J̌ JJ̌!", *odd_texts(8, 4000)]
    want = known.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, found in zip(texts, want):
        words = known.words(text.encode())
        known.learn(set(words))
        assert np.frombuffer(known.encode(words), "<u4").tolist() == found.ids, ascii(text)


@pytest.mark.parametrize("name", ["my col-1", "a.b", "tick`s", "select", "ü 漢", "x:y<z>"])
def test_columns_of_any_name(spark, name):
    line = "a line that stands in three documents"
    rows = [(i, f"{line}\nown {i}", i, "kept", i) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_chars", name, "rest"])
    found = line_dedup.drop_repeated_lines(docs)
    assert found.columns == docs.columns
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert [by_id[i][name] for i in range(4)] == ["kept"] * 4
    assert [by_id[i]["text"] for i in range(4)] == ["own 0", "own 1", "own 2", f"{line}\nown 3"]
    assert [by_id[i]["n_chars"] for i in range(4)] == [5, 5, 5, len(line) + 6]


def test_marked_sections():
    page = "<html><body><article><p>Before <![foo[x]]> and after the section.</p>{}</article></body></html>"
    for odd in ("<![foo[x]]>", "<![", "<![ [", "<![endif]>", "<![CDATA[a > b]]>", "<![if !IE]>", "<!-", "<!", "<?", "</", "<![ é"):
        text = html_text.main_text(page.format(odd))
        assert text.startswith("Before ") and "after the section." in text


def test_pages_of_any_bytes():
    rng = random.Random(5)
    parts = [
        "<", ">", "</", "<!", "<![", "<!--", "-->", "<![foo[", "]]>", "<?", "&", "&#x", "&#99999999;", "&amp", "p", "div",
        "article", "script", "title", " class=", '"', "'", "=", "text ", "\x00", "é", "퟿", "<p>", "</p>", "<a href=x>", "</a>",
    ]
    for _ in range(5000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert isinstance(html_text.main_text(page), str)


def test_formulas_are_text():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is known.</p></article>"
    assert html_text.main_text(page) == "The sum a+b is known."


def test_words_of_letters_need_no_special_token():
    """They are tokenized with a space between them, and all words get the library's ids."""
    known = packing.WordTokens(VOCABULARY)
    own, seen = known.tokenizer, []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return own.encode_batch_fast(texts, **options)

    known.tokenizer = Spy()
    texts = ["plain words größe İstanbul ΑΣ 東京 don't a1b2 end. what?! (x) _ -- İİ ªº ǅ", "ﬁn ΣΑΣ, مرحبا नमस्ते"]
    for text in texts:
        words = known.words(text.encode())
        known.learn(set(words))
        ids = np.frombuffer(known.encode(words), "<u4").tolist()
        assert ids == own.encode(text, add_special_tokens=False).ids
    seen.clear()
    known.learn({b"several", b"more", b"such", b"words"})
    assert seen and not any(known.mark in text for text in seen)


def test_words_of_many_texts():
    """Hashed in one go, the words are those of ``split`` of each text, and only equal ones are equal."""
    rng = random.Random(7)
    signs = [b"a", b"b", b"\x00", b"\xc3\xa9", b"\xc2\xa0", b"\xc2\x85", *(bytes([c]) for c in (9, 10, 11, 12, 13, 28, 31, 32, 32))]
    texts = [b"".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += [b"", *(b"ab" * n for n in range(30, 40)), *(b"x" * n + b" " + b"x" * n for n in range(1, 140)), b""]
    ends = np.cumsum([0, *map(len, texts)])
    found = common.Words(np.frombuffer(b"".join(texts), np.uint8), ends)
    words = [text.split() for text in texts]
    assert found.text.tolist() == np.cumsum([0, *map(len, words)]).tolist()
    flat = [word for some in words for word in some]
    assert found.length.tolist() == [len(word) for word in flat]
    assert len(set(found.hashes.tolist())) == len(set(zip(flat, found.hashes.tolist()))) == len(set(flat))
    nothing = common.Words(np.empty(0, np.uint8), np.zeros(3, np.int64))
    assert len(nothing.hashes) == 0 and nothing.text.tolist() == [0, 0, 0]


def test_copies_beside_rows_without_an_id(spark):
    """Large ids stay exact in a batch that also holds a null one."""
    passage = " ".join(f"w{i}" for i in range(20))
    first = 2**53 + 1
    rows = [(None, passage), (first, f"{passage} own"), (first + 2, f"new {passage}"), (first + 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["factors"] for r in substring.duplicate_factors(docs).collect()}
    assert [tuple(f) for f in found.pop(first + 2)] == [(1, 20, first, 0)] and not found


def test_tasks_of_a_worker_share_what_they_learned(tmp_path):
    """One tokenizer per process and file; a file written anew is read anew."""
    known = packing.word_tokens(VOCABULARY)
    for text in ("One task's words, then", "another task's words!!"):
        again = packing.word_tokens(VOCABULARY)
        words = again.words(text.encode())
        again.learn(set(words))
        want = known.tokenizer.encode(text, add_special_tokens=False).ids
        assert again is known and np.frombuffer(again.encode(words), "<u4").tolist() == want
    copy = tmp_path / "words.json"
    with open(VOCABULARY) as source:
        copy.write_text(source.read())
    first = packing.word_tokens(str(copy))
    assert first is not known and packing.word_tokens(str(copy)) is first
    copy.write_text(copy.read_text() + "\n")
    assert packing.word_tokens(str(copy)) is not first


def test_ids_of_many_texts():
    """All texts of a slice at once: each one's ids as the tokenizer gives them, then the end token."""
    known = packing.WordTokens(VOCABULARY)
    texts = ["", "  ", "The same words, the same WORDS!!", *odd_texts(9, 500), "the end", ""]
    ids, ends = known.encode_all([known.words(text.encode()) for text in texts])
    want = [found.ids + [0] for found in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [some.tolist() for some in np.split(ids, ends[:-1])] == want and ends[-1] == len(ids)
    ids, ends = known.encode_all([[]])
    assert ids.tolist() == [0] and ends.tolist() == [1]
