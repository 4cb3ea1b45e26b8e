import json
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import token_frames, unigram_counts
from tessella.llm.common import shared_folder

BPE = public_tokenizers.path("word_bpe_49k.json")
UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [(3, "The cat's  mat\n\tNaïve É 12"), (1, None), (2, ""), (9, "word " * 20_000), (7, "a<|endoftext|>b c d\x1ce"), (7, "á ́x"), (8, "The cat's  mat")]


def frame(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("n_tokens", F.lit(0))


def test_round_trip_against_the_library(spark):
    tk, at, want = Tokenizer.from_file(BPE), 0, []
    for d, t in sorted(TEXTS, key=lambda r: (r[0], r[1] or "")):
        raw = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((d, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    got = token_frames.token_frames(frame(spark), BPE).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert token_frames.token_frames(frame(spark).limit(0), BPE).count() == 0


def test_shortcuts_equal_the_whole_way():
    texts = ["Thing. THING!! 'sTuff don't... a.,b ÄÖÜß. naïve*** İstanbul Σίσυφος. ª º µm Æther, ŉ ǅ 12a ²x Ⅷ x_y e\u0301! <|endoftext|>. ab<|endoftext|> word| | || %%% ŀ ﬁ K Å",
             "tab\there\rand\u00a0there\u2028x\x85y", "日本語. Привет, мир! ٣ हिन्दी", "Ñandú&&& élève$$$ ÇA### œuvre: Ÿ; (x) x) ..,"]
    tk = Tokenizer.from_file(BPE)
    want = [np.array(tk.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for t in texts]
    assert token_frames.make_encoder(BPE)(texts) == want


def test_reader_decompresses_one_document_and_finds_damage(spark, tmp_path):
    manifest = token_frames.write_token_frames(frame(spark), shared_folder(spark, "t"), BPE, 1).collect()
    path = manifest[0]["path"].removeprefix("file://")
    data = open(path, "rb").read()
    with open(path, "rb") as f:
        reader = token_frames.FrameReader(f, len(data))
        assert reader.doc_ids == sorted(d for d, _ in TEXTS)
        assert reader.frame(0) == b"\x01\0\0\0"
    bad = tmp_path / "bad"
    start, end = int(reader.starts[2]), int(reader.starts[3])
    bad.write_bytes(data[: end - 1] + bytes([data[end - 1] ^ 255]) + data[end:])
    with open(bad, "rb") as f, pytest.raises(Exception):
        token_frames.FrameReader(f, len(data)).frame(2)
    assert start < end


def brute_tokens(word, pieces, miss):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        options = [(best[i - 1][0] + size * miss, -best[i - 1][1] - size)]
        options += [(best[j][0] + pieces[word[j:i]], -best[j][1] - 1) for j in range(i) if word[j:i] in pieces]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_trie_counts_equal_a_plain_program(spark):
    pieces = unigram_counts.load_pieces(UNIGRAM)
    counter = unigram_counts.TrieCounter(pieces)
    words = ["▁" + w for w in "the there therefore internationalisation 漢字仮名 naïve x zzzzqqq 12,345 the".split()]
    got = counter.counts(words)
    assert got == {w: brute_tokens(w, pieces, counter.byte_score) for w in words}
    assert counter.nodes_scored < sum(map(len, set(words)))
    rows = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in unigram_counts.token_counts(frame(spark), UNIGRAM).collect()}
    assert rows == {(d, len((t or "").split()), sum(brute_tokens("▁" + w, pieces, counter.byte_score) for w in ((t or "").split() if d != 9 else [])) if d != 9 else 20_000 * counter.counts(["▁word"])["▁word"]) for d, t in TEXTS}
    assert unigram_counts.token_counts(frame(spark).limit(0), UNIGRAM).count() == 0


def test_shards_follow_size_and_part_equal_ids(spark, monkeypatch):
    df = spark.createDataFrame([(7, f"t {i} " + "x" * 2_000) for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(token_frames, "SHARD_BYTES", 60_000)
    manifest = token_frames.write_token_frames(df, shared_folder(spark, "t"), BPE)
    assert manifest.count() >= 8 and manifest.selectExpr("max(n_docs)").first()[0] < 100
    assert token_frames.read_token_frames(manifest).count() == 300


def test_rows_as_they_come_keep_their_order(spark):
    texts = ["b", "a", None, "c c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).orderBy(F.desc("doc_id")).coalesce(1)
    got = token_frames.token_frames(df, BPE, as_they_come=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [3, 2, 1, 0] and len({r.shard for r in got}) == 1


def test_another_tokenizer_takes_the_whole_way():
    other = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  blanks\n and Case", None]
    tk = Tokenizer.from_file(other)
    assert token_frames.make_encoder(other)(texts) == [np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for t in texts]


def drawn_words(n, seed=3):
    rng = np.random.default_rng(seed)
    letters, marks = list("abcdefghijklmnopqrstuvwxyzABCÄÖÜßéèñçŁŷ"), ["", "", "", ".", "!?", "$$$"]
    return list({"".join(rng.choice(letters, rng.integers(3, 14))) + marks[rng.integers(6)] for _ in range(n)})


def test_distinct_latin_words_share_calls_of_the_library():
    words, calls = drawn_words(20_000), []
    encode = token_frames.make_encoder(BPE)
    sys.setprofile(lambda _, event, f: calls.append(f.__name__) if event == "c_call" and "tokenizers" in type(getattr(f, "__self__", None)).__module__ else None)
    try:
        got = encode([" ".join(words)])
    finally:
        sys.setprofile(None)
    tk = Tokenizer.from_file(BPE)
    assert got == [np.array(tk.encode(" ".join(words), add_special_tokens=False).ids + [1], "<u4").tobytes()]
    assert 0 < len(calls) < len(words) / 100


def test_arrow_slices_of_bounded_text_equal_the_library():
    rng, tk = np.random.default_rng(4), Tokenizer.from_file(BPE)
    words = drawn_words(400) + ["12,345", "don't", "日本語", "e\u0301", "", "", "\n", "\t", "x\n\ny", "İ", "a<|endoftext|>b"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) if i % 7 else [None, "", " ", "\n"][i // 7 % 4] for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"]).slice(5)
    encode, got, slices = token_frames.make_encoder(BPE, 5), [], 0
    for ids, some in token_frames._pieces(batch, 5_000):
        slices += 1
        assert sum(len(t.encode()) for t in some.to_pylist()[1:] if t) <= 5_000 and len(ids) == len(some)
        got += zip(ids, encode(some), strict=True)
    assert slices > 5
    assert got == [(i, np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in enumerate(texts)][5:]


def test_a_model_without_ends_of_words_takes_the_whole_way(tmp_path):
    config = json.loads(Tokenizer.from_file(BPE).to_str())
    assert token_frames._by_pieces(config)
    config["model"]["end_of_word_suffix"] = None
    assert not token_frames._by_pieces(config)
    (path := tmp_path / "t.json").write_text(json.dumps(config))
    tk, texts = Tokenizer.from_file(str(path)), ["The cat's mat.", None]
    assert token_frames.make_encoder(str(path))(texts) == [np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for t in texts]
