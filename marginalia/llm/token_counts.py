"""Token counts under a unigram model of a public vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. Its best segmentation is the one of the highest total
log probability, ties going to fewer tokens. Each Arrow batch puts its distinct new pre-tokens in a trie, walked in
order: the forward score of a prefix (best log probability, and tokens, of the text up to there) is computed once and
serves all words that share it. A word's end stores its count, and documents add up the counts of their words. Nothing
is shuffled, and memory is bounded by the batch and by `limit`.

The vocabulary file has an order but no probabilities, so a piece of rank r gets the Zipf share 1 / (r + 2); a character
that no piece holds costs one token for each of its UTF-8 bytes, less likely than any piece.

Defined cases: null and empty texts have no words and no tokens; very long texts are counted word by word. Null doc_ids and repeated rows come out once each. Extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import text_batches

MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, float]:
    """Log probability by piece, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (r + 2) for r in range(len(pieces)))
    return {p: -math.log((r + 2) * total) for r, p in enumerate(pieces)}


class Counter:
    """Tokens of words, remembered up to a limit."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.scores = vocabulary(path)
        self.unknown = min(self.scores.values()) - 10
        self.limit = limit
        self.counts: dict[str, int] = {}
        tails: dict[str, set[int]] = {}
        for p in self.scores:  # lengths of the pieces that end in given characters, so that few are tried
            tails.setdefault(p[-2:], set()).add(len(p))
        self.tails = {t: sorted(n) for t, n in tails.items()}

    def learn(self, words: list[str]) -> None:
        """Walk the trie of new words in order: what two neighbours share is scored once."""
        scores, tails, counts, unknown = self.scores, self.tails, self.counts, self.unknown
        best, used, before = [0.0], [0], ""
        for word in sorted(words):
            text = MARK + word
            shared = 0
            for a, b in zip(text, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                top, tokens = -math.inf, 0
                last = text[end - 1]
                for n in tails.get(text[end - 2 : end] if end > 1 else last, ()):
                    if n > end:
                        break
                    if (s := scores.get(text[end - n : end])) is not None:
                        s += best[end - n]
                        t = used[end - n] + 1
                        if s > top or s == top and t < tokens:
                            top, tokens = s, t
                if (s := scores.get(last)) is not None and end > 1:
                    s += best[end - 1]
                    t = used[end - 1] + 1
                    if s > top or s == top and t < tokens:
                        top, tokens = s, t
                elif s is None:
                    n = len(last.encode("utf-8", "surrogatepass"))
                    s = best[end - 1] + n * unknown
                    if s > top:
                        top, tokens = s, used[end - 1] + n
                best.append(top)
                used.append(tokens)
            counts[word] = used[-1]
            before = text

    def count(self, texts: list[list[str]]) -> list[int]:
        if len(self.counts) > self.limit:
            self.counts = {}
        counts = self.counts
        self.learn([w for w in set().union(*texts) if w not in counts])
        return [sum(map(counts.__getitem__, words)) for words in texts]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        counter = Counter(path, limit)
        for batch, texts in text_batches(batches):
            for lo in range(0, len(texts), 2000):
                words = [[w.decode() for w in x.split()] for x in texts[lo : lo + 2000]]
                n = counter.count(words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 2000), pa.array([len(w) for w in words], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
