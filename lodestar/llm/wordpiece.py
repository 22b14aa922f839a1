"""Greedy word-piece token counts by a linear longest-match automaton, without building pieces."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import mapped

#: Runs of letters, digits and marks, or single other signs; white space parts them.
WORDS = re.compile(r"\w+|[^\w\s]").findall
#: Characters of counted words that a worker keeps, and of one that is kept; longer words are counted each time.
KEPT_CHARS, LONG = 4_000_000, 64


class Automaton:
    """A trie of word-initial and continuing pieces with failure links and popped-token counts.

    ``fail[v]`` is where matching goes on when node v has no edge for the next character,
    ``pops[v]`` how many tokens are final by then. A word costs one step per character and
    at most one failure per token. A word that pieces cannot cover counts as one token.
    """

    def __init__(self, initial: list[str], continuing: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: inside a word
        ends = set()
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                v = root
                for c in piece:
                    if c not in self.next[v]:
                        self.next[v][c] = len(self.next)
                        self.next.append({})
                    v = self.next[v][c]
                if piece:
                    ends.add(v)
        self.fail: list[int | None] = [None] * len(self.next)
        self.pops = [0] * len(self.next)
        level = [(root, c, v) for root in (0, 1) for c, v in self.next[root].items()]
        while level:  # breadth first: failure links lead to shorter matches
            for parent, c, v in level:
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at is not None and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[v], self.pops[v] = self.next[at][c], popped
            level = [(v, c, w) for _, _, v in level for c, w in self.next[v].items()]

    def count(self, word: str) -> int:
        """Tokens of one word."""
        edges, fail, pops = self.next, self.fail, self.pops
        v = n = 0
        for c in word:
            while c not in edges[v]:
                n += pops[v]
                v = fail[v]
                if v is None:
                    return 1
            v = edges[v][c]
        while v > 1:
            n += pops[v]
            v = fail[v]
            if v is None:
                return 1
        return n


@cache
def automaton(path: str | None = None) -> Automaton:
    """From a SentencePiece model: pieces led by its blank sign start words, the others continue them."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Automaton([p[1:] for p in plain if p[0] == "▁"], [p for p in plain if p[0] != "▁"])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text.

    Null or empty text: zeros. A null doc_id stays null, repeated rows are counted each,
    other columns are not read. No shuffle; a worker keeps a bounded table of counted words.
    No rows: no rows.
    """

    def count(batches):
        match = automaton(path).count

        class Counts(dict):
            kept = 0

            def __missing__(self, word):
                n = match(word)
                if len(word) <= LONG:
                    self[word] = n
                    self.kept += len(word) + 8
                return n

        known = Counts()
        for b in batches:
            words, tokens = [], []
            for t in b["text"]:
                found = WORDS(t.as_py() or "")
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
                if known.kept > KEPT_CHARS:
                    known.clear()
                    known.kept = 0
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return mapped(docs.select("doc_id", "text"), count, "doc_id long, n_words long, n_tokens long")
