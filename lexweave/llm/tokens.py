"""Exact token counts under a unigram vocabulary, without building tokens.

Best segmentation by dynamic programming: an Aho-Corasick automaton over the vocabulary reports every piece ending at each
character, and for the prefixes that a piece may still reach only the best score and its number of pieces are carried, nothing to trace back. Ties follow the
unigram tokenizer of the `tokenizers` library: a later candidate must score strictly more, and candidates for a position come by
start, longest piece first; a character without a piece of its own may be unknown, at the least score less 10; a run of
unknown characters is one unknown token, or one token per byte if the vocabulary has every byte. Scores add up in double precision, left to right.

Text is cut before each space mark, as the tokenizer's Metaspace step does, so a word's count doesn't depend on its neighbours and is
remembered (at most REMEMBERED words and REMEMBERED_BYTES of them a worker).
"""

from __future__ import annotations


import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, texts_of, with_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED, REMEMBERED_BYTES = 300_000, 32 << 20
#: Prefixes kept before those out of every piece's reach are let go.
WINDOW = 1 << 14


class UnigramCounter:
    """vocabulary: (piece, score) by id; unknown: the unknown piece's id; the vocabulary falls back to bytes if it has all 256."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        self.floor = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in {p for p, _ in vocabulary} for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=0)
        self.known: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.size = 0

    def segment(self, word: str) -> tuple[float, int]:
        """(score, pieces) of the best segmentation. Keeps at most WINDOW prefixes and the longest piece's length, whatever the word's."""
        n, base, reach = len(word), 0, self.longest + 1
        # By prefix, from `base` on: best score (None: none yet), pieces, and of the run of unknown characters that ends there
        # the pieces before it, its characters and its bytes.
        best, count = [0.0], [0]
        before, chars, size_of = [0], [0], [0]
        matches = self.automaton.iter(word)
        end, item = next(matches, (n, None))
        for stop in range(1, n + 1):
            alone, top, chosen, is_unknown = False, None, 0, False
            while end == stop - 1:
                size, score, unk = item
                alone |= size == 1
                candidate = best[stop - size - base] + score
                if top is None or candidate > top:
                    top, chosen, is_unknown = candidate, stop - size, unk
                end, item = next(matches, (n, None))
            if not alone:
                candidate = best[stop - 1 - base] + self.floor
                if top is None or candidate > top:
                    top, chosen, is_unknown = candidate, stop - 1, True
            best.append(top)
            at = chosen - base
            if is_unknown:
                first = before[at] if chars[at] else count[at]
                run, raw = chars[at] + stop - chosen, size_of[at] + len(word[chosen:stop].encode("utf-8", "surrogatepass"))
                # Unknown characters fuse; a run that is no piece itself is spelled in bytes.
                spelled = self.bytes and (run > self.longest or word[stop - run : stop] not in self.automaton)
                count.append(first + (raw if spelled else 1))
                before.append(first)
                chars.append(run)
                size_of.append(raw)
            else:
                count.append(count[at] + 1)
                before.append(0)
                chars.append(0)
                size_of.append(0)
            if len(best) > WINDOW + reach:
                cut = len(best) - reach
                base += cut
                for held in (best, count, before, chars, size_of):
                    del held[:cut]
        return best[-1], count[-1]

    def _learn(self, words: set[str]) -> None:
        for w in words:
            self.scores[w], self.known[w] = self.segment(MARK + w)
            self.size += len(w)

    def count(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text; none for an empty one."""
        if not text:
            return 0, 0.0
        words = text.replace(MARK, " ").removeprefix(" ").split(" ")
        new = set(words).difference(self.known)
        if new:
            if len(self.known) > REMEMBERED or self.size > REMEMBERED_BYTES:
                self.known.clear()
                self.scores.clear()
                self.size, new = 0, set(words)
            self._learn(new)
        return sum(map(self.known.__getitem__, words)), sum(map(self.scores.__getitem__, words))


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


def counter(path: str) -> UnigramCounter:
    return kept(("counts", path), lambda: UnigramCounter(read_vocabulary(path)))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep, all by default) with n_tokens long and unigram_score double: a unigram model's, whatever kind of model the file was made for.

    A null text is an empty one and has no tokens and score 0. White space other than the space is part of words. Rows pass through one by one,
    repeats included; an input column named n_tokens or unigram_score is replaced. The path must be readable on every worker.
    """

    def add(part: pa.RecordBatch) -> dict[str, pa.Array]:
        count = counter(path).count
        got = [count(x) for x in texts_of(part, text_col)]
        return {"n_tokens": pa.array([x[0] for x in got], pa.int64()), "unigram_score": pa.array(np.array([x[1] for x in got], np.float64))}

    keep = docs.columns if keep is None else keep
    return with_columns(docs.select(*dict.fromkeys([*keep, text_col])), add, "n_tokens long, unigram_score double", keep)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]).select("doc_id", "n_tokens", "unigram_score")
