"""Token counts without tokens: Aho-Corasick matches and a Viterbi pass that carries only counts.

The vocabulary of a unigram tokenizer (pieces with scores) is read from a SentencePiece file. For
every end position all pieces ending there are enumerated; the best score and the piece count
of the best segmentation are carried along. Rules as in unigram tokenizers: among equal scores
the piece that starts first wins; a character that is no piece of its own scores ``lowest - 10``
and counts as its UTF-8 bytes if the vocabulary has byte pieces (else a run of such characters
counts once); blanks are written U+2581 and one is put before the text.

No piece holds a blank behind another character or a line end, so a text falls into units that
can be segmented apart with the same result; their counts are remembered per worker.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from depthframe.llm.common import table

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n+")
#: Units remembered per worker, and the longest that is. Both only save time.
REMEMBERED, LONGEST = 1_000_000, 48
UNKNOWN_PENALTY = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


class UnitCounts(dict):
    """Counts of units by text, filled on demand."""

    def __init__(self, pieces: dict[str, float], byte_pieces: bool):
        super().__init__()
        if any(re.search(f"[^{MARK}]{MARK}|\\n", p) for p in pieces):
            raise ValueError("a piece reaches over a unit's border")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self.has_pieces = bool(pieces)

    @classmethod
    def from_file(cls, path: str) -> UnitCounts:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in plain}, any(sp.is_byte(i) for i in ids))

    def __missing__(self, unit: str) -> int:
        n = self.segment(unit)
        if len(unit) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = n
        return n

    def segment(self, unit: str) -> int:
        size = len(unit)
        ending: list[list] = [[] for _ in range(size)]
        if self.has_pieces:
            for end, match in self.automaton.iter(unit):
                ending[end].append(match)
        score, count, unknown_end = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end in range(size):
            best, start, single = float("-inf"), size, False
            for length, value in ending[end]:
                at = end + 1 - length
                got = score[at] + value
                if got > best or (got == best and at < start):
                    best, start = got, at
                single = single or length == 1
            n = count[start] + 1 if best > float("-inf") else 0
            alone = False
            if not single and score[end] + self.unknown > best:
                best, alone = score[end] + self.unknown, True
                if self.byte_pieces:
                    n = count[end] + len(unit[end].encode("utf-8", "surrogatepass"))
                else:
                    n = count[end] + (not unknown_end[end])
            score[end + 1], count[end + 1], unknown_end[end + 1] = best, n, alone
        return count[size]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, UNITS.findall(MARK + text.replace(" ", MARK))))


_LOADED: dict[str, UnitCounts] = {}


def counter(path: str) -> UnitCounts:
    if path not in _LOADED:
        _LOADED[path] = UnitCounts.from_file(path)
    return _LOADED[path]


def count_tokens(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id and ``n_tokens``. Null and empty texts have none.

    ``vocabulary`` must be readable on every executor. Other columns are ignored.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches):
        count = counter(vocabulary).text
        for batch in batches:
            n = [count(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64())], ["id", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n bigint")
    return out.select(out["id"].alias(id_col), out["n"].alias("n_tokens"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
