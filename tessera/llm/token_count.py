"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text is cut at blanks into pre-tokens, each with the mark of a word start.
The best segmentation of a pre-token into pieces (the greatest sum of piece
scores; of equal sums the fewest pieces) is a forward recursion over its
characters, and the forward state of a prefix is the same for every pre-token
that starts with it.  The distinct pre-tokens of a batch are therefore walked
as a trie: in sorted order, the states of the prefix shared with the last one
are kept and only the new characters are computed; the count at the end of a
pre-token is stored for it and used for every repetition.  A character that
no piece covers falls back to one piece for each of its bytes.

The vocabulary comes from a public tokenizer file, whose path is a parameter;
nothing is trained.  The file's scores are ranks, so a piece's log-probability
is taken as -log(rank + 1), a Zipf law.  It must be readable where the query
is called; its pieces (a megabyte or so) go to the tasks.

A word of any length takes bounded memory.  A null or empty text has no token.  Repeated rows get equal counts; extra
columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_fields, load

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
#: Distinct pre-tokens, and characters of them, whose counts a task remembers; then it starts anew.
MOST_REMEMBERED, MOST_CHARACTERS = 400_000, 8_000_000
#: Characters of a pre-token up to which states are kept for the next one that shares them.
SHARED = 2048
#: Score of one byte of a character outside the vocabulary.
BYTE_SCORE = -20.0

_PRE_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of a SentencePiece file and their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            out[model.id_to_piece(i)] = -math.log(i + 1.0)
    return out


class Counter:
    """Counts pre-tokens' pieces; what was counted is remembered."""

    def __init__(self, pieces: dict[str, float]):
        self.root: dict = {}
        for piece, score in pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.known: dict[str, int] = {}
        self.characters = 0

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of ``words``, sorted and distinct, with the states of shared prefixes computed once.

        A state is ``best``, (score, -pieces) up to a place, and ``runs``, the
        pieces that may still grow there, as the state where each began and
        its trie node.  It needs the one before it only, so those beyond
        ``SHARED`` characters are not kept and a word of any length takes no
        more memory.
        """
        root, states, last, out = self.root, [((0.0, 0), [])], "", {}
        for word in words:
            shared = 0
            for x, y in zip(WORD_START + word[:SHARED], last):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            best, runs = states[shared]
            for i, c in enumerate((WORD_START + word) if shared == 0 else word[shared - 1 :], shared):
                top, grown = None, []
                for began, node in (*runs, (best, root)):
                    nxt = node.get(c)
                    if nxt is not None:
                        grown.append((began, nxt))
                        score = nxt.get("")
                        if score is not None:
                            s, n = began
                            if top is None or (s + score, n - 1) > top:
                                top = (s + score, n - 1)
                if top is None:
                    size = len(c.encode("utf-8", "surrogatepass"))
                    top = (best[0] + BYTE_SCORE * size, best[1] - size)
                best, runs = top, grown
                if i < SHARED:
                    states.append((best, runs))
            out[word] = -best[1]
            last = (WORD_START + word[:SHARED])[:SHARED]
        return out

    def counts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        cut = [_PRE_TOKEN.findall(x) if x else [] for x in texts]
        if len(self.known) > MOST_REMEMBERED or self.characters > MOST_CHARACTERS:
            self.known.clear()
            self.characters = 0
        fresh = self.learn(sorted(set().union(*cut) - self.known.keys()))
        self.known.update(fresh)
        counted = [sum(map(self.known.__getitem__, words)) for words in cut], [len(words) for words in cut]
        for w in fresh:
            if len(w) > SHARED:
                del self.known[w]
            else:
                self.characters += len(w)
        return counted


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``n_words`` of ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    @F.arrow_udf("struct<n_tokens:bigint,n_words:bigint>")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(sent.value)
        for col in texts:
            tokens, words = [], []
            for a in range(0, len(col), 256):
                t, w = counter.counts(col.slice(a, 256).to_pylist())
                tokens += t
                words += w
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], ["n_tokens", "n_words"])

    return add_fields(docs, count(F.col(text)), ("n_tokens", "n_words"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and word counts of every whole text of ``documents``."""
    return count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "n_words")
