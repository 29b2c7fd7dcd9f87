import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from trailspan.llm import tokens
from trailspan.shared import shared_folder


def plain(texts):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_join_to_the_tokenizers_ids():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\x0b", " ", " ", "\x85", "\x1c", "the", "'s", "don't", "é", "日本", "12", "!?", "<|endoftext|>", "a.b", "😀", "Word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", " ", "x" * 3000, " a"]
    ids, counts = tokens.encode(tokens.tokenizer_path(), pa.array(texts, pa.string()), 0)
    got = np.split(ids, np.cumsum(counts)[:-1])
    for t, g, p in zip(texts, got, plain(texts)):
        assert g.tolist() == p + [0], repr(t)


def test_files_round_trip(spark):
    rows = [(5, "the heat of it"), (1, None), (3, ""), (3, "twice"), (None, "no id"), (9, "long " * 30000), (2, "Ünï çode 😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", tokens.F.lit(1))
    manifest = tokens.write_tokens(docs, shared_folder(spark, "tok"), shard_docs=3)
    got = sorted(tokens.read_tokens(spark, manifest, arrays=True).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == [None, 1, 2, 3, 3, 5, 9]
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = sorted((i if i is not None else -1, p + [0]) for (i, _), p in zip(rows, plain([t or "" for _, t in rows])))
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in got) == want
    shard = next(s for s in manifest["shards"] if (s["first_id"] or 0) <= 9 <= (s["last_id"] or 0))
    assert tokens.Shard(manifest["folder"], shard["shard"]).document(9).tolist() == plain(["long " * 30000])[0] + [0]
    assert tokens.Shard(manifest["folder"], shard["shard"]).document(777) is None
    empty = tokens.write_tokens(docs.limit(0), shared_folder(spark, "tok"))
    assert tokens.read_tokens(spark, empty).count() == 0


def test_added_tokens_are_those_of_the_untouched_tokenizer(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "the", "é", "12", "<|endoftext|>", "<|endoftext|>", "a.b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(500)]
    want = [e.ids for e in Tokenizer.from_file(tokens.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert want != plain(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokens.read_tokens(spark, tokens.write_tokens(docs, shared_folder(spark, "tok")), arrays=True).collect()
    assert [list(r.ids) for r in sorted(got, key=lambda r: r.doc_id)] == [w + [0] for w in want]
