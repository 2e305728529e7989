import os
import random

import pytest

from lodestat.llm.tokens import decode_ids, default_tokenizer_dir, encode_column, encode_text, encoding, safe_pieces

FOLDER = default_tokenizer_dir()
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files here")


def texts():
    rng = random.Random(3)
    words = ["pan", "año", "it's", "  ", "\n\n", "12,5%", "<|endoftext|>", "日本", "😀", "\t", "é", "x" * 50, "¿Qué?", "\xa0", "'", "A1b2"]
    return ["", " ", "hola mundo", "<|endoftext|>", "퟿", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(30))]


def test_pieces_encode_as_the_whole_and_decode_exactly():
    enc = encoding(FOLDER, "byte_bpe_50k")
    for t in texts():
        whole = enc.encode_ordinary(t)
        assert [i for p in safe_pieces(t, 40) for i in enc.encode_ordinary(p)] == whole
        assert "".join(safe_pieces(t, 40)) == t and decode_ids(enc, whole) == t


def test_agrees_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    enc = encoding(FOLDER, "byte_bpe_50k")
    for t in texts():
        assert other.encode(t, add_special_tokens=False).ids == encode_text(enc, t)


def test_table(spark):
    long = "palabra larga " * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "hola", "c"), (3, "hola", "c"), (4, long, "d"), (None, "x", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encode_column(df, "doc_id", "text").collect()]
    enc = encoding(FOLDER, "byte_bpe_50k")
    assert sorted(got, key=str) == sorted([(d, enc.encode_ordinary(t or "")) for d, t, _ in rows], key=str)
    counts = {r["doc_id"]: r["n_tokens"] for r in encode_column(df, "doc_id", "text", counts_only=True).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] == len(enc.encode_ordinary(long))
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0
