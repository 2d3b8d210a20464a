"""Operators on documents against brute force, with every odd case."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.llm import line_dedup, mixing, near_dup, packing, quality, substring, token_counts
from groundswell.llm.queries import vocabulary

PIECES, WORDS = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")


def by_id(df, *columns):
    return {row[0]: tuple(row[c] for c in columns) for row in df.collect()}


# --- near-duplicates ---


def test_near_duplicates_equal_brute_force(docs, texts):
    found = by_id(near_dup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert found == brute.near_duplicates(texts)
    assert found[2][1] == found[20][1] == 0 and found[4] == (0, 4, True)


def test_near_duplicates_of_a_table(small):
    docs = small("documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = by_id(near_dup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert found == brute.near_duplicates(rows)


def test_near_duplicates_from_four_fifths(spark):
    """The threshold is a parameter: pairs of 0.80 to 0.85 link at 80 and not at 85."""
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for k, changed in enumerate((10, 18, 20, 21, 22, 30)):  # the last words: one shingle less for each
        rows.append((k + 1, " ".join(words[:-changed] + [f"x{k}_{i}" for i in range(changed)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows, 80)
    assert want != brute.near_duplicates(rows)
    assert by_id(near_dup.near_duplicates(docs, 80), "n_shingles", "component_id", "kept") == want
    kept = {r["doc_id"] for r in near_dup.drop_near_duplicates(docs, 80).collect()}
    assert kept == {d for d, w in want.items() if w[2]}


def test_a_chain_of_near_copies_is_one_component(spark):
    """Neighbours link, far ends do not; a star from the smallest id is not enough."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[(7 * i) % 200] = f"n{i}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(near_dup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert found == brute.near_duplicates(rows)


def test_blocks_of_comparisons_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in rng.sample(range(100), rng.randint(0, 3)):
            words[at] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 1000)
    found = by_id(near_dup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert found == brute.near_duplicates(rows)


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    for size, share in ((40, 0.85), (3000, 0.85), (3000, 0.3), (3000, 0.0)):
        both = rng.integers(0, 2**63, int(2 * size * share / (1 + share))).astype(np.uint64)
        rest = (size - len(both)) * 2
        own = rng.integers(0, 2**63, rest).astype(np.uint64)
        a, b = np.concatenate([both, own[: rest // 2]]), np.concatenate([both, own[rest // 2 :]])
        same = (near_dup.registers(a) == near_dup.registers(b)).sum() / near_dup.REGISTERS
        by_chance = near_dup.chance(np.array([len(a)]), np.array([len(b)]))[0]
        assert abs((same - by_chance) / (1 - by_chance) - share) < 0.2


def test_near_dedup_keeps_the_columns(docs, no_docs):
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    want = {r["doc_id"]: r for r in docs.collect()}
    rows = kept.collect()
    assert all(want[r["doc_id"]] == r for r in rows)
    assert {r["doc_id"] for r in rows} == set(want) - {1, 2, 3, 8, 20, 21}
    assert near_dup.drop_near_duplicates(no_docs).count() == 0
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in found) == [
        (0, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)
    ]
    kept = near_dup.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 1]


# --- lines ---


def test_lines_equal_brute_force(docs, texts):
    found = by_id(line_dedup.line_report(docs), "n_lines", "n_dropped", "kept_sha256")
    assert found == brute.line_report(texts)
    assert found[12][1] == 3 and found[18][1] == 0 and found[4][0] == 1


def test_a_full_filter_changes_nothing(docs, texts):
    """One word for all lines: every line is suspected, the exact count decides."""
    found = by_id(line_dedup.line_report(docs, words=1), "n_lines", "n_dropped", "kept_sha256")
    assert found == brute.line_report(texts)


def test_filters_merge_as_they_build():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    seen = np.concatenate([hashes, hashes[:50]])
    rng.shuffle(seen)
    once, twice = np.zeros(64, np.uint64), np.zeros(64, np.uint64)
    for part in np.array_split(seen, 7):
        at, mask = line_dedup.place(part, 64)
        line_dedup.absorb(once, twice, at, mask, np.zeros(len(at), np.uint64))
    at, mask = line_dedup.place(hashes[:50], 64)
    assert ((twice[at] & mask) == mask).all()


def test_line_dedup_keeps_the_columns(docs, no_docs, texts):
    out = line_dedup.drop_repeated_lines(docs)
    assert out.schema == docs.schema and line_dedup.drop_repeated_lines(no_docs).count() == 0
    want = {r["doc_id"]: r.asDict() for r in docs.collect()}
    sha = brute.line_report(texts)
    for row in out.collect():
        row = row.asDict()
        assert brute.sha(row["text"] or "") == sha[row["doc_id"]][2]
        assert row["n_chars"] == (len(row["text"]) if row["text"] is not None else None)
        for name in row:
            if name not in ("text", "n_chars"):
                assert row[name] == want[row["doc_id"]][name]


def test_lines_of_repeated_rows_are_one_document(spark):
    line = "this very line is long enough"
    rows = [(1, line), (1, line), (1, line), (2, line), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_dropped for r in line_dedup.line_report(docs).collect()) == 0
    more = docs.union(spark.createDataFrame([(3, line)], docs.schema))
    assert sum(r.n_dropped for r in line_dedup.line_report(more).collect()) == 4


# --- token counts ---


def test_token_counts_equal_brute_force(docs, texts, no_docs):
    pieces = token_counts.load_pieces(PIECES)
    want = {}
    for i, text in texts:
        words = [w.decode() for w in (text or "").encode().split()]
        if i != 15:
            want[i] = (len(words), sum(brute.token_count(w, pieces) for w in words))
    found = by_id(token_counts.token_counts(docs, PIECES), "n_words", "n_tokens")
    assert found.pop(15)[0] == 1 and found == want
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


def test_shared_prefixes_do_not_change_counts():
    pieces = {"▁a": -1.0, "a": -1.5, "ab": -2.0, "b": -0.5, "▁": -3.0, "bab": -1.1}
    words = ["a", "ab", "abab", "ababb", "b", "", "zz"]
    found = token_counts.count_words(words, pieces, 3)
    assert found == {w: brute.token_count(w, pieces) for w in words}


# --- quality ---


def test_quality_on_held_out_labels(small):
    docs, labels = small("documents"), small("labels")
    rows = quality.quality_scores(docs, labels).collect()
    known = by_id(labels, "quality")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.predicted == known[r.doc_id][0] for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 20 and np.mean(held) > 0.85


def test_held_out_labels_are_not_learned(docs, labels):
    other = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert by_id(quality.quality_scores(docs, labels), "score") == by_id(
        quality.quality_scores(docs, other), "score"
    )


def test_quality_of_odd_texts_and_tables(docs, no_docs, labels):
    found = by_id(quality.quality_scores(docs, labels), "held_out", "score", "predicted")
    assert set(found) == set(range(22)) and all(0 <= f[1] <= 1 for f in found.values())
    assert found[4][1] == found[5][1] == found[6][1]
    assert quality.quality_scores(no_docs, labels).count() == 0
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    kept = quality.keep_quality(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, f in found.items() if f[2]}


def test_gradient_of_the_model():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 4])
    starts, labels = np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(8, 5))
    shapes = {"E": (5, 4), "e": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    w = {k: rng.normal(size=s) for k, s in shapes.items()}

    def loss():
        model = quality.Model(np.zeros(5), np.ones(5), w)
        p = [model.score(bag) for bag in np.split(x, starts[1:])]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - np.array(p)))

    grad = quality._gradient(w, x, sizes, starts, labels)
    for k, s in shapes.items():
        at = tuple(0 for _ in s)
        w[k][at] += 1e-6
        up = loss()
        w[k][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - grad[k][at]) < 1e-5
        w[k][at] += 1e-6


# --- mixing ---


def test_mix_meets_the_targets(small):
    docs = small("documents")
    rows = mixing.mixing_rates(docs).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    langs = by_id(docs.select("doc_id", "lang"), "lang")
    assert np.mean([langs[r.doc_id][0] == r.domain for r in rows]) > 0.9
    total = sum(r.n_tokens * r.rate for r in rows)
    assert abs(total / sum(r.n_tokens for r in rows) - 1) < 0.01
    for domain, weight in mixing.TARGETS.items():
        share = sum(r.n_tokens * r.rate for r in rows if r.domain == domain) / total
        assert abs(share - weight) < 0.02


def nonnegative_least_squares(a, b):
    """Smallest |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if slope.max() <= 1e-10:
            break
        free[slope.argmax()] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                break
            x += (x[low] / (x[low] - trial[low])).min() * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
        x = trial
    return x


@pytest.mark.parametrize("weights", [[0.2, 0.3, 0.5], [0.7, 0.2, 0.1], [0.05, 0.05, 0.9]])
def test_rates_are_a_least_squares_fit(spark, weights):
    """As close to the targets as an independent solver comes, or else the distance is told."""
    rng = np.random.default_rng(1)
    p, tokens = rng.dirichlet([0.3] * 3, 300), rng.integers(1, 1000, 300)
    rows = [(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(tokens, p))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").repartition(3)
    steps, factor, residual = mixing.fit_rates(members, weights)
    rates = mixing.rates(p, steps)
    shares = (tokens[:, None] * p / tokens.sum()).T
    best = nonnegative_least_squares(shares, np.array(weights))
    assert (rates >= 0).all() and factor == 1.0
    far = lambda r: np.abs(shares @ r - weights).max()
    assert far(best) < 1e-9
    assert far(rates) < far(best) + 2 * mixing.CLOSE or (len(steps) == mixing.STEPS and weights[2] == 0.9)
    assert residual == pytest.approx(np.abs((shares @ rates) - np.array(weights)).max(), abs=1e-9)


def test_mixed_documents_are_repeated_by_their_rates(docs, no_docs):
    out = mixing.mix_documents(docs)
    assert out.schema == docs.schema
    rates = by_id(mixing.mixing_rates(docs, at_least=1.0), "rate")
    count = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, (rate,) in rates.items():
        assert np.floor(rate + 1e-6) <= count.get(i, 0) <= np.ceil(rate)
    assert mixing.mixing_rates(no_docs).count() == mixing.mix_documents(no_docs).count() == 0


def test_no_document_goes_at_a_least_rate_of_one(small):
    docs = small("documents")
    out = mixing.mix_documents(docs)
    assert out.select("doc_id").distinct().count() == docs.count() < out.count()


@pytest.mark.parametrize("case", ["most", "missing", "only"])
def test_uneven_domains_lose_no_document(small, case):
    """A domain at 80 % of the tokens, one without a text, and one alone."""
    docs = small("documents").select("doc_id", "text", "lang")
    if case == "most":
        again = docs.where("lang = 'de'").crossJoin(docs.sparkSession.range(1, 27))
        docs = docs.union(again.selectExpr("doc_id + 100000 * id", "concat(text, ' ', id)", "lang"))
    docs = docs.where({"most": "true", "missing": "lang <> 'es'", "only": "lang = 'en'"}[case])
    tokens = {r.doc_id: (r.lang, len((r.text or "").split())) for r in docs.collect()}
    total = sum(n for _, n in tokens.values())
    if case == "most":
        assert sum(n for lang, n in tokens.values() if lang == "de") > 0.75 * total
    out = mixing.mix_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in out} == set(tokens) and max(r["count"] for r in out) <= 60
    shares = dict.fromkeys(mixing.TARGETS, 0)
    for r in out:
        shares[tokens[r.doc_id][0]] += r["count"] * tokens[r.doc_id][1]
    there = {lang for lang, _ in tokens.values()}
    weights = {k: w for k, w in mixing.TARGETS.items() if k in there}
    for k, w in weights.items():
        assert abs(shares[k] / sum(shares.values()) - w / sum(weights.values())) < 0.05


def test_targets_without_documents(docs):
    rows = mixing.mixing_rates(docs, {"xx": 1.0, "yy": 1.0}).collect()
    assert len(rows) == 22 and all(np.isfinite(r.rate) and r.rate >= 0 for r in rows)


# --- substrings ---


def test_substrings_equal_brute_force(docs, texts, no_docs):
    found = by_id(substring.substring_report(docs), "n_words", "n_removed", "kept_sha256")
    assert found == brute.substring_report(texts)
    assert found[10][1] == 40 and found[21][1] == 80
    assert substring.substring_report(no_docs).count() == 0


def test_factors_point_at_equal_words(docs, texts):
    words = {i: (t or "").encode().split() for i, t in texts}
    for row in substring.duplicate_factors(docs).collect():
        for f in row.factors:
            assert f.ref_doc_id < row.doc_id and f.length >= substring.WINDOW
            own = words[row.doc_id][f.start : f.start + f.length]
            assert own == words[f.ref_doc_id][f.ref_start : f.ref_start + f.length]


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_small_alphabets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(substring.substring_report(docs), "n_words", "n_removed", "kept_sha256")
    assert found == brute.substring_report(rows)


# --- packing ---


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 2048
    return len(places), -(-sum(w[3] for w in want) // 2048)


def test_packing_is_a_round_trip(docs, texts, no_docs):
    used, least = check_packing(packing.pack(docs, WORDS).collect(), texts)
    assert used <= least + 1
    assert packing.pack(no_docs, WORDS).count() == 0


def test_packing_of_a_table(small):
    docs = small("documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack(docs.repartition(6), WORDS).collect()
    used, least = check_packing(rows, texts)
    assert used <= 1.02 * least + 1


def test_rounds_of_many_tasks(small, monkeypatch):
    docs = small("documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(packing, "ROUND_ITEMS", 3)
    used, least = check_packing(packing.pack(docs.repartition(12), WORDS).collect(), texts)
    assert used <= 1.1 * least


def test_best_fit_never_overfills():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets, sizes = packing.best_fit(lengths, 100)
        assert sizes.max() <= 100 and sizes.sum() == lengths.sum()
        assert len(sizes) <= 11 / 9 * -(-lengths.sum() // 100) + 40
        for b in range(len(sizes)):
            own = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][own])[:-1] == offsets[bins == b][own][1:]).all()
