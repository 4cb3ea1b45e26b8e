"""Token counts by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens go into a trie; the unigram forward scores of a node depend only on the
path to it, so every shared prefix is scored once and a word's count is stored at its
terminal. The trie is walked in sorted order, where a word shares with its predecessor
exactly the path they have in common: the stack of forward scores is the trie's open path.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

_CACHE_WORDS = 1_000_000


def load_pieces(model_path: str) -> dict[str, float]:
    """Piece -> log score: Zipf's law over the vocabulary's rank order, bytes and control pieces apart."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i)] = -math.log(len(pieces) + 2.0)
    return pieces


class TrieCounter:
    """counts(words): tokens of each word's best segmentation (most score, then fewest tokens).

    A character that no piece covers costs `byte_score` and one token for each of its UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = -2.0 * math.log(len(pieces) + 2.0)
        self.nodes_scored = 0

    def counts(self, words) -> dict[str, int]:
        get, longest, out = self.pieces.get, self.longest, {}
        score, tokens, path = [0.0], [0], ""
        for word in sorted(set(words)):
            share = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                share += 1
            del score[share + 1 :], tokens[share + 1 :]
            for i in range(share + 1, len(word) + 1):
                size = len(word[i - 1].encode("utf-8", "surrogatepass"))
                best, n = score[i - 1] + size * self.byte_score, tokens[i - 1] + size
                for j in range(max(0, i - longest), i):
                    s = get(word[j:i])
                    if s is not None:
                        s += score[j]
                        if s > best or s == best and tokens[j] + 1 < n:
                            best, n = s, tokens[j] + 1
                score.append(best)
                tokens.append(n)
                self.nodes_scored += 1
            path = word
            out[word] = tokens[-1]
        return out


def pre_tokens(text: str | None) -> list[str]:
    return ["▁" + w for w in (text or "").split()]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row.

    Null or blank text counts 0; a long text is read whole; repeated rows are kept; an empty
    table gives no rows; other columns are ignored, clashing names too. One pass
    over the input without a shuffle; each worker keeps a bounded table of terminal counts."""

    def run(batches):
        import pyarrow as pa

        counter, known = TrieCounter(load_pieces(model_path)), {}
        for batch in batches:
            ids, n_pre, n_tok = batch.column(0), [], []
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 1000):
                words = [(t or "").split() for t in texts[a : a + 1000]]
                if len(known) > _CACHE_WORDS:
                    known = {}
                new = {w for ws in words for w in ws} - known.keys()
                for w, n in counter.counts("▁" + w for w in new).items():
                    known[w[1:]] = n
                get = known.__getitem__
                n_pre += [len(ws) for ws in words]
                n_tok += [sum(map(get, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
