"""Token counts by dynamic programming over a shared trie of pre-tokens.

A pre-token is a run of characters other than ASCII white space, with the
vocabulary's word mark in front.  Its tokens are the best segmentation under a
unigram model over a public vocabulary: pieces are ranked by the file, and a
piece of rank r scores -log(r + 1).  A character that no piece covers counts as
its UTF-8 bytes, each below the rarest piece.  No public file here holds a unigram
model, and none is trained, so these scores are a surrogate.

The distinct pre-tokens of a batch are walked in sorted order, which is a
depth-first walk of their trie: the forward scores of the path to a node are
kept, so that a prefix shared by many pre-tokens is scored once, and the count at
the terminal is stored.  Every document then sums stored counts.  There is no
shuffle; memory is bounded by the batch and by STORED terminals.

Defined results for odd input: a null or blank text has no tokens; repeated rows
give repeated rows; an empty table gives an empty result; other columns are
ignored; a text without white space is one pre-token.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import rows_in_slices, text_of

WORD_MARK = "▁"
#: Terminals that a worker keeps, and the longest pre-token (bytes) worth keeping.
STORED, STORED_BYTES = 300_000, 48


@lru_cache(maxsize=2)
def unigram_scores(path: str) -> tuple[dict[str, float], float, int]:
    """Piece scores, the score of a fallback byte, and the longest piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = {p: -math.log(rank + 1.0) for rank, p in enumerate(pieces, 1)}
    return scores, -math.log(len(pieces) + 1.0) - 10.0, max(map(len, pieces))


@lru_cache(maxsize=1)
def stored_counts(path: str) -> dict[bytes, int]:
    """Counts at the terminals that this worker has met, kept over its tasks."""
    return {}


def terminal_counts(pretokens, scores: dict[str, float], byte_score: float, longest: int) -> dict[str, int]:
    """Tokens of each distinct pre-token; forward scores are computed once per shared prefix."""
    best, count, out, before = [0.0], [0], {}, ""
    for word in sorted(set(pretokens)):
        shared = 0
        for x, y in zip(before, word):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            width = len(word[end - 1].encode())
            top, n = best[end - 1] + byte_score * width, count[end - 1] + width
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is not None and best[start] + score > top:
                    top, n = best[start] + score, count[start] + 1
            best.append(top)
            count.append(n)
        out[word], before = count[-1], word
    return out


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens (long) of every whole text."""
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        scores, byte_score, longest = unigram_scores(vocabulary)
        stored = stored_counts(vocabulary)
        for batch in batches:
            for part in rows_in_slices(batch):
                words = [t.encode().split() for t in part.column(1).to_pylist()]
                fresh = set().union(*words) - stored.keys()
                counts = terminal_counts((WORD_MARK + w.decode() for w in fresh), scores, byte_score, longest)
                stored.update((w, counts[WORD_MARK + w.decode()]) for w in fresh)
                tokens = [sum(map(stored.__getitem__, ws)) for ws in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])
                if len(stored) > STORED:
                    stored.clear()
                for w in fresh:
                    if len(w) > STORED_BYTES:
                        stored.pop(w, None)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
