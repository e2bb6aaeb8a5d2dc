"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton over the vocabulary enumerates every piece that occurs in a text; a Viterbi pass carries, for
each position, the best score and the number of tokens of the path that has it. Ties fall as in the tokenizer: candidates for a
position come in the order of their start, and a later one must be strictly better, so the longest last piece wins.
A character that is no piece itself may be passed as unknown at the least score minus ``UNKNOWN_PENALTY``; it counts as one
byte piece per UTF-8 byte. Blanks are written as U+2581, and one is put in front of a text.

If no piece has U+2581 behind another character, a path always has a border before each run of them. Texts are then
worked through run by run, and a worker remembers the runs it has met (up to ``REMEMBERED``); this changes no result. Scores
are added as 64-bit floats; whole-numbered scores, as in the default vocabulary, thus add up exactly.

Defined cases: a null or empty text has no tokens and score 0. Long texts are worked through run by run, and of a run, however
long, only as many positions are held as the longest piece has characters. Repeated rows
give repeated results, an empty table an empty one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ribeira.llm.common import Emitter, id_and_text, read, rows_of

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 250_000
VOCABULARY = "piece_bpe_32k.model"

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def vocabulary(path: str) -> dict[str, float]:
    """Pieces that match text, with their scores: control, unknown and byte pieces don't."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class Counter:
    def __init__(self, scores: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        ring = 1 << max(map(len, scores)).bit_length()  # more positions than the longest piece has characters
        self.best, self.count_at, self.mask = [0.0] * ring, [0] * ring, ring - 1
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        parted = all(BLANK not in piece.lstrip(BLANK) for piece in scores)
        self.runs = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if parted else "(?s:.+)")
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path. Positions lie in a ring: a piece starts at most its own length before its end."""
        size, mask = len(text), self.mask
        best, count = self.best, self.count_at
        best[0], count[0] = 0.0, 0
        at, top, tokens, single = 0, None, 0, False
        unknown = self.unknown

        def close(end: int) -> None:
            """Settles the best way to ``end``; the unknown character is the candidate with the latest start."""
            nonlocal top, tokens
            if not single:
                score = best[end - 1 & mask] + unknown
                if top is None or score > top:
                    top, tokens = score, count[end - 1 & mask] + len(text[end - 1].encode())
            best[end & mask], count[end & mask] = top, tokens

        for last, (length, piece_score) in self.automaton.iter(text):
            end = last + 1
            while at + 1 < end:
                if at:
                    close(at)
                at, top, single = at + 1, None, False
            if at < end:
                if at:
                    close(at)
                at, top, single = end, None, False
            start = end - length & mask
            score = best[start] + piece_score
            if top is None or score > top:
                top, tokens = score, count[start] + 1
            if length == 1:
                single = True
        while at < size:
            if at:
                close(at)
            at, top, single = at + 1, None, False
        if size:
            close(size)
        return count[size & mask], best[size & mask]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = BLANK + text.replace(" ", BLANK)
        tokens, score, known = 0, 0.0, self.known
        for match in self.runs.finditer(text):
            run = match.group()
            found = known.get(run)
            if found is None:
                found = self.viterbi(run)
                if len(run) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[run] = found
            tokens += found[0]
            score += found[1]
        return tokens, score


_LOADED: dict[str, Counter] = {}


def loaded(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(vocabulary(path))
    return _LOADED[path]


def _counts(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, out = loaded(path), Emitter(COUNTS)
        for doc_id, text in rows_of(batches):
            yield from out.add((doc_id, *counter.count(text.decode("utf-8", "replace"))))
        yield from out.flush()

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, score`` of every whole text."""
    return id_and_text(docs).mapInArrow(_counts(path or public_tokenizers.path(VOCABULARY)), "doc_id long, n_tokens long, score double")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"))
