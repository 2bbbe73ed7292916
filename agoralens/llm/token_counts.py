"""Lengths of texts in word pieces, by a linear longest-match automaton.

The pieces of a vocabulary form a trie.  Greedy longest match cuts a word into the
longest piece that starts it, then the longest that starts the rest, and so on.  Each
node of the trie knows how many pieces are certain once no further character fits
(``popped``) and the node for what is left of it (``failure``), so a word is read once,
character by character, and its pieces are counted without being built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import with_row

KEPT_WORDS = 300_000
FIRST = "▁"  # starts the pieces that start a word


class Automaton(dict):
    """Words, as UTF-8, to the number of their pieces; 0 for a word that has none."""

    def __init__(self, pieces: Iterable[str]):
        super().__init__()
        children: list[dict[str, int]] = [{}]
        final: list[bool] = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][c]
            final[node] = True
        self.children = children
        self.failure: list[int] = [-1] * len(children)
        self.popped: list[int] = [0] * len(children)
        level = [0]
        while level:  # by depth, so that what a node refers to is known
            for node in level:
                for c, child in children[node].items():
                    if final[child]:
                        self.failure[child], self.popped[child] = 0, 1
                        continue
                    at, count = self.failure[node], self.popped[node]
                    while at >= 0 and c not in children[at]:
                        at, count = self.failure[at], count + self.popped[at]
                    if at >= 0:
                        self.failure[child], self.popped[child] = children[at][c], count
            level = [child for node in level for child in children[node].values()]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = self.count(word.decode())
        return found

    def count(self, word: str) -> int:
        """The number of pieces of a word, or 0 if its characters can't be cut into pieces."""
        children, failure, popped = self.children, self.failure, self.popped
        node = total = 0
        for c in FIRST + word:
            while c not in children[node]:
                total += popped[node]
                node = failure[node]
                if node < 0:
                    return 0
            node = children[node][c]
        while node > 0:
            total += popped[node]
            node = failure[node]
        return total if node == 0 else 0


def sentencepiece_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces, and a word's mark only in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    return [p for p in pieces if FIRST not in p[1:]]


def count_tokens(df: DataFrame, pieces: list[str], text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_tokens`` and ``n_unknown`` to each row.

    Words are runs of other than the six ASCII white space characters; each is cut into
    pieces greedily, the longest first, the first one starting with the mark of a word.
    A word with a character that no piece continues with is one unknown token.  Null
    and empty texts have no words.  The results replace columns of their own names;
    other columns stay.  Rows are counted one by one, without a shuffle; repeated rows
    have equal results.

    The vocabulary is broadcast: it is a file of some ten thousand pieces.
    """
    sent = df.sparkSession.sparkContext.broadcast(pieces)
    rest = [F.col(f"`{c}`") for c in df.columns]
    packed = df.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for value in batch["text"].to_pylist():
                counts = [automaton[w] for w in value.split()]
                none = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + none)
                unknown.append(none)
            numbers = {"n_words": words, "n_tokens": tokens, "n_unknown": unknown}
            yield pa.record_batch({"row": batch["row"], **{k: pa.array(v, pa.int64()) for k, v in numbers.items()}})

    names = ["n_words", "n_tokens", "n_unknown"]
    out = packed.mapInArrow(run, with_row(packed, ", ".join(f"{n} long" for n in names)))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in names], *names)
