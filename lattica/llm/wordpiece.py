"""Token counts by a linear longest-match automaton (Song et al., "Fast WordPiece Tokenization", 2021).

A trie of the vocabulary has failure links, as in string search: from a node, the link pops the pieces that greedy
longest match is now sure of and leads to the node of what remains. Each link carries the popped pieces' number, so a
word's count is a sum along one pass over its characters; no pieces are built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, sliced, texts

MARK = "▁"  # stands before each word in the vocabulary


class Automaton:
    """count(word) is the number of pieces of greedy longest match. A character that no piece begins with counts as its UTF-8 bytes."""

    def __init__(self, pieces: list[str], cached: int = 300_000):
        pieces = [p for p in dict.fromkeys(pieces) if p]
        weights = dict.fromkeys(pieces, 1)
        for c in {c for p in pieces for c in p}:  # a character of a piece that is no piece itself
            weights.setdefault(c, len(c.encode()))
        self.children: list[dict[str, int]] = [{}]
        weight = [0]
        for piece, w in weights.items():
            at = 0
            for c in piece:
                down = self.children[at].get(c)
                if down is None:
                    down = self.children[at][c] = len(weight)
                    self.children.append({})
                    weight.append(0)
                at = down
            weight[at] = w
        #: By node: where its link leads, and how much it pops.
        self.link, self.popped = [0] * len(weight), [0] * len(weight)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.children[parent].items():
                queue.append(node)
                if weight[node]:
                    self.popped[node] = weight[node]
                else:
                    at, count = self.link[parent], self.popped[parent]
                    while c not in self.children[at]:  # every character has a child of the root
                        count += self.popped[at]
                        at = self.link[at]
                    self.link[node], self.popped[node] = self.children[at][c], count
        self.known: dict[str, int] = {}
        self.cached = cached

    def count(self, word: str) -> int:
        children, link, popped = self.children, self.link, self.popped
        at = total = 0
        for c in word:
            down = children[at].get(c)
            while down is None and at:
                total += popped[at]
                at = link[at]
                down = children[at].get(c)
            if down is None:
                total += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = down
        while at:
            total += popped[at]
            at = link[at]
        return total

    def lengths(self, text: str, mark: str = MARK) -> list[int]:
        """Pieces of each word; words lie between Unicode white space."""
        known, out = self.known, []
        for word in text.split():
            n = known.get(word)
            if n is None:
                n = self.count(mark + word)
                if len(word) <= 64:
                    if len(known) >= self.cached:
                        known.clear()
                    known[word] = n
            out.append(n)
        return out


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def automaton(path: str) -> Automaton:
    return resident((Automaton, path), lambda: Automaton(read_pieces(path)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, longest_word (most pieces of a word) for every row.

    Null and empty texts have zeros; equal rows all stay; rows with a null id stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = automaton(path).lengths
        for batch in sliced(batches):
            counts = [(len(n), sum(n), max(n, default=0)) for n in map(lengths, texts(batch, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_tokens", "longest_word"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest_word long")
