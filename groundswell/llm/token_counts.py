"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens of a slice of documents are walked in sorted order, which is a
depth-first walk of their trie: the forward scores of a prefix are computed once and
serve every word below it. The count at a word's end is stored and looked up for every
occurrence. Tasks need nothing from each other, so no row is shuffled.

The vocabulary is a public sentencepiece file; nothing is trained. Its pieces are
ranked by merge order; a piece of rank r has the score -log(r + SMOOTH) (Zipf's law).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from groundswell.llm.common import Recent, binary, documents, give_back, slices

SMOOTH = 10.0
BYTE_SCORE = -20.0  # of each byte of a character that no piece covers
STORED = 250_000  # words in each of the two generations whose counts a task holds
START = "▁"  # stands before each word


def load_pieces(path: str) -> dict[str, float]:
    """Score of each ordinary piece of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): -math.log(SMOOTH - model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }


def count_words(words: list[str], pieces: dict[str, float], longest: int) -> dict[str, int]:
    """Pieces on the best path of each word; of equal paths, the one with fewer pieces.

    ``scores`` and ``counts`` hold the branch of the trie that leads to the word.
    """
    found: dict[str, int] = {}
    scores, counts, last = [0.0], [0], ""
    get = pieces.get
    for word in sorted(words):
        marked = START + word
        depth = 0
        for a, b in zip(marked, last):
            if a != b:
                break
            depth += 1
        del scores[depth + 1 :], counts[depth + 1 :]
        for end in range(depth + 1, len(marked) + 1):
            width = len(marked[end - 1].encode("utf-8", "surrogatepass"))
            best, fewest = scores[end - 1] + width * BYTE_SCORE, counts[end - 1] + width
            for start in range(max(0, end - longest), end):
                score = get(marked[start:end])
                if score is not None:
                    score += scores[start]
                    if score > best or (score == best and counts[start] + 1 < fewest):
                        best, fewest = score, counts[start] + 1
            scores.append(best)
            counts.append(fewest)
        found[word] = counts[-1]
        last = marked
    return found


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        longest = max(map(len, pieces), default=1)
        recent = Recent(STORED)
        for batch in batches:
            raws = binary(batch, "text")
            n_words, n_tokens = [], []
            for rows in slices(raws):
                texts = [raws[row].split() if raws[row] else [] for row in rows]
                names = {w.decode(): w for w in recent.missing(set().union(*texts))}
                stored = recent.now
                for name, n in count_words(list(names), pieces, longest).items():
                    stored[names[name]] = n
                n_words += map(len, texts)
                n_tokens += [sum(map(stored.__getitem__, words)) for words in texts]
            columns = [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_tokens, pa.int64()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_tokens"])
        del recent, pieces
        give_back()

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) per row of ``docs`` (doc_id, text, ...).

    Words are runs without ASCII white space. Null, empty and blank texts count 0;
    repeated rows are counted each for itself.
    """
    return documents(docs).mapInArrow(_count(path), "doc_id long, n_words long, n_tokens long")
