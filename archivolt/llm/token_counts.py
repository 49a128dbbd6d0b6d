"""Numbers of unigram pieces of whole texts, without the pieces: Viterbi that counts.

A text is cut before every space, which becomes the mark U+2581, and a mark is
put in front.  In each part an Aho-Corasick automaton finds all vocabulary
pieces that end at a place, longest first; the best score up to the place and
the number of pieces on that path are carried on.  As in the public unigram
tokenizers a later candidate must be strictly better, so of equal scores the
longest piece wins; a character that is no piece costs ten below the least
score; and such characters stand for their bytes where the vocabulary has all
of them, else neighbours are one unknown piece.  Scores are added in double
precision, in the tokenizer's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.tables import map_batches

#: A public vocabulary with its stored scores; any other of this kind can be given.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts whose counts a worker remembers before it forgets all.
REMEMBERED = 1 << 19


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of texts; remembers the counts of parts that it met."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - 10.0
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # A character inside no piece separates: no piece crosses it.
        self.breaks = self.bytes and not any("\n" in p for p in names)
        self.known: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces on the best path through one part."""
        size = len(text)
        best, count, open_end = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        done = 0  # places up to here are final
        single = True

        def unknown(at: int, beside: bool) -> None:
            """The step over the character before ``at`` as an unknown one, after all pieces that end there."""
            score = best[at - 1] + self.unknown
            if not beside or score > best[at]:
                best[at] = score
                more = len(text[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else 0 if open_end[at - 1] else 1
                count[at], open_end[at] = count[at - 1] + more, True

        for last, (length, score) in self.find.iter(text):
            at = last + 1
            if at != done:
                if not single:
                    unknown(done, True)
                for missing in range(done + 1, at):
                    unknown(missing, False)
                done, single, first = at, False, True
            single = single or length == 1
            score += best[at - length]
            if first or score > best[at]:
                best[at], count[at], open_end[at], first = score, count[at - length] + 1, False, False
        if not single:
            unknown(done, True)
        for missing in range(done + 1, size + 1):
            unknown(missing, False)
        return count[size]

    def text(self, text: str | None) -> int:
        """Pieces of a whole text; of no text none."""
        if not text:
            return 0
        total, known = 0, self.known
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        lines = text.split("\n") if self.breaks else [text]
        total += len(lines) - 1
        for k, line in enumerate(lines):
            # Every mark begins a part; a line's head before its first mark goes on from the line above.
            head, *parts = line.split(MARK)
            for part in ([head] if head else []) + [MARK + p for p in parts]:
                n = known.get(part)
                if n is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    n = self.part(part)
                    if len(part) <= 64:
                        known[part] = n
                total += n
        return total


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``doc_id, n_tokens`` of every row: the pieces of its whole text.

    A null or empty text has none.  Repeated rows are counted each, other
    columns are not read, an empty table gives no rows.  The vocabulary is
    bounded by its file and sent to the workers, which need no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if key not in _counters:  # once in a worker's life
            _counters.clear()
            _counters[key] = Counter(shared.value)
        counter = _counters[key]
        counts = [counter.text(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, n_tokens long")
