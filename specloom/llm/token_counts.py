"""Token counts under a unigram vocabulary: distinct pre-tokens in a trie, forward scores once per shared prefix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import documents, lean, limit_batches

#: Sentencepiece writes a space, and the start of a text, as this character.
SPACE = "▁"
#: Distinct pre-tokens whose counts a worker remembers between batches; it forgets all when there are more.
CACHED_WORDS = 400_000
#: Score of a character that no piece covers, below every piece.
UNKNOWN = -100.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_scores(path: str) -> dict[str, float]:
    """Log probabilities of the pieces: rank r of n has 1 / (r + 2) over the sum of those (Zipf's law).

    The file is a merge vocabulary without probabilities; its pieces come by rank, which is what the law needs.
    Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(pieces)}


class TrieCounter:
    """Counts the pieces of the best segmentation of words.

    The words in order are a walk of their trie: what two neighbours share is a path from the root that both
    pass, and the forward scores of its nodes are kept on a stack. Each node is scored once, from the nodes
    above it at which a piece that ends here begins; ties go to the segmentation with fewer pieces. A word's
    count is stored at its terminal node.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.nodes = 0

    def counts(self, words: list[str]) -> dict[str, int]:
        get, longest = self.scores.get, self.longest
        score, pieces, last, out = [0.0], [0], "", {}
        for word in sorted(words):
            shared, top = 0, min(len(word), len(last))
            while shared < top and word[shared] == last[shared]:
                shared += 1
            del score[shared + 1 :], pieces[shared + 1 :]
            self.nodes += len(word) - shared
            for end in range(shared + 1, len(word) + 1):
                best, few = score[end - 1] + UNKNOWN, pieces[end - 1] + 1
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None and ((s := s + score[start]) > best or s == best and pieces[start] + 1 < few):
                        best, few = s, pieces[start] + 1
                score.append(best)
                pieces.append(few)
            out[word], last = pieces[len(word)], word
        return out


_COUNTERS: dict[str, tuple[TrieCounter, dict[str, int]]] = {}


@lean
def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _COUNTERS:
        _COUNTERS[path] = (TrieCounter(unigram_scores(path)), {})
    trie, known = _COUNTERS[path]
    for b in batches:
        words = pc.ascii_split_whitespace(b.column("text").cast(pa.large_string()))
        offsets, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(known) > CACHED_WORDS:
            known.clear()
        known.update((w[1:], n) for w, n in trie.counts([SPACE + w for w in distinct if w and w not in known]).items())
        per_word = np.array([known[w] if w else 0 for w in distinct], np.int64)
        codes = coded.indices.to_numpy()
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        tokens, full = per_word[codes] if len(codes) else np.zeros(0, np.int64), np.array([bool(w) for w in distinct], bool)
        offsets = offsets - offsets[0]
        cols = [b.column("doc_id"), *(pa.array(np.diff(upto(x)[offsets]).astype(np.int64)) for x in (full[codes].astype(np.int64) if len(codes) else tokens, tokens))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Return (doc_id, n_words, n_tokens), one row for each row of docs.

    Pre-tokens are the words between ASCII white space, each led by the space mark; n_tokens is the sum of
    the pieces of their best segmentations. Each batch's distinct pre-tokens form one trie; what a worker has
    counted before it looks up. Null and empty texts have no tokens; repeated rows are counted as often as
    they come; other columns are ignored. Rows never meet, so nothing is shuffled.
    """
    limit_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _count(it, path), "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
