"""BPE, packing and the token store against the libraries, on odd texts."""

import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from weftline.llm import bpe, packing, pieces, token_store

ODD = [None, "", " ", "a  b", " \n x", "x \n", "it's 'll we'LL I'd", "12 345 6", "\t\ttab  ", "naïve ☃ ❤ ❤️ x", "\x1c \x1d a", "<|endoftext|> hi", "ΣΑΣ Σ", "é ́x", "x" * 3000, "ab" * 3000 + " " + "%$#" * 90, "\r\n\r\n  a", "日本語 テキスト、です。", "\u0085a \u0085", "The quick, Quick. the", "The quick, Quick. the"]
ODD += ["".join(random.Random(k).choice(" \n\tab'%1é  日❤İ") for _ in range(150)) for k in range(60)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe_is_tiktoken_s(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = bpe.encode_decode(docs(list(enumerate(ODD))), path, P.PATTERN, with_ids=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        assert r["ids"] == want.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(r["ids"])


def test_bpe_joins_agree_with_whole_windows():
    tree = bpe.TreeBpe(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    draw = random.Random(1)
    for _ in range(400):
        data = bytes(draw.choice(b"aeinrst ") for _ in range(draw.randint(1, 40)))
        assert tree.reduce(data) == tree.window(data)


def test_histogram_packing():
    draw = random.Random(2)
    lengths = [draw.choice([1, 3, 64, 64, 100, 4096, draw.randint(1, 4096)]) for _ in range(3000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.shortest_pack_first(histogram, 4096)
    held = {}
    for pattern, count in patterns:
        assert sum(n * times for n, times in pattern) <= 4096
        for n, times in pattern:
            held[n] = held.get(n, 0) + times * count
    assert held == histogram and packing.shortest_pack_first({}, 4096) == []


def test_packing_places_every_id_once(spark, docs):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    texts = [*ODD, "word " * 9000, "Some more words. " * 700]
    rows = packing.pack(docs(list(enumerate(texts))), P.path("word_bpe_49k.json")).collect()
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    taken = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(packed(own)) and r["doc_tokens"] == len(ids[r["doc_id"]])
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for pieces in taken.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs([]), P.path("word_bpe_49k.json")).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 5000))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    shard = token_store.Shard(token_store.shard_bytes([None, *keys.tolist()], [packed([k % 7, 1]) for k in range(len(keys) + 1)]))
    assert (shard.find(keys) == np.arange(1, len(keys) + 1)).all() and (shard.find(keys + 1) < 0).mean() > 0.99
    assert shard.ids(int(shard.find(keys[5:6])[0])).tolist() == [6, 1]


def test_store_round_trip(spark, docs):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = token_store.round_trip(docs([(3 * k - 40, t) for k, t in enumerate(ODD)]), P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, ODD, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)


def test_store_with_repeated_and_null_keys(spark, docs):
    rows = token_store.round_trip(docs([(1, "a"), (None, "b c"), (1, "a"), (2, None)]), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"]) for r in rows) == [(False, 0, 0), (True, 1, 3), (True, 1, 5), (True, 2, 7)]
    assert token_store.round_trip(docs([]), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("kind", ["missing", "spoilt"])
def test_spoilt_shards_are_refused(kind):
    with pytest.raises((ValueError, IndexError)):
        token_store.Shard(b"" if kind == "missing" else b"NOTSHARD" + b"\0" * 100)


def test_look_up_of_keys_reads_their_ranges(spark, docs, tmp_path):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = [(5 * k - 60, t) for k, t in enumerate(ODD)] + [(7, "second"), (7, "first"), (None, "no key")]
    manifest = token_store.write(docs(rows), path, f"file://{tmp_path}/shards", shard_mb=0.001)
    got = token_store.lookup(manifest, [7, -60, 45, 46, 10**12, *(5 * k - 60 for k in range(20))]).collect()
    want = [(k, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows if k == 7 or k == 45 or k is not None and k % 5 == 0 and k < 40]
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted(want)
    assert token_store.lookup(manifest, []).count() == 0


def test_words_and_their_parts_are_the_library_s():
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice("aB é'!.#\n\n  0ﬁİ日ß☃\tŉ<|> sS") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += [" ".join("".join(draw.choice("abcdeéÀİıſŉǅ.,'\n1#") for _ in range(draw.randint(1, 7))) for _ in range(20)) for _ in range(1000)]
    for path, vocabulary in ((P.path("byte_bpe_50k.json"), pieces.byte_vocabulary), (P.path("word_bpe_49k.json"), pieces.WordVocabulary)):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        own = vocabulary(path)
        for caches in (10**6, 50):  # so that generations change
            for cache in vars(own).values():
                if isinstance(cache, pieces.WordCache):
                    cache.limit = caches
            for some in (texts[:1500], texts[1500:], []):
                got = own.encode(pa.array(some, pa.string()))
                assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def test_long_matches_take_little_more_than_their_length():
    tree = bpe.TreeBpe(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    draw = random.Random(2)
    for data in (b"a" * 3000, b"ab" * 2000, bytes(draw.choice(b"etaoin") for _ in range(3000))):
        whole = tree._long_window(data)
        assert tree.reduce(data) == whole and b"".join(tree.bytes_of[k] for k in whole) == data
    for _ in range(200):
        data = bytes(draw.choice(b"etaoin ae") for _ in range(draw.randint(1, bpe.LONG)))
        assert tree._long_window(data) == tree.window(data)
    took = {}
    for n in (125_000, 1_000_000):
        data = bytes(draw.choice(b"etaoinshrdlu") for _ in range(n))
        began = time.process_time()
        tree.reduce(data)
        took[n] = time.process_time() - began
    assert took[1_000_000] < 16 * took[125_000] + 1


def test_packing_and_bpe_of_repeated_rows_and_null_ids(spark, docs):
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (2, None)]
    pieces_of = packing.pack(docs(rows), P.path("word_bpe_49k.json")).collect()
    assert len(pieces_of) == 4 and len({(r["sequence_id"], r["offset"]) for r in pieces_of}) == 4 and sum(r["doc_id"] is None for r in pieces_of) == 1
    encoded = bpe.encode_decode(docs(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(encoded) == 4 and sorted(r["n_tokens"] for r in encoded) == [0, 1, 2, 2]
    assert bpe.encode_decode(docs([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing_deals_out_a_length_of_many_pieces(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 20)
    rows = packing.pack(docs([(k, "a b" if k % 3 else "c " * (k % 7)) for k in range(600)]), P.path("word_bpe_49k.json")).collect()
    taken = {}
    for r in rows:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 600 and all(sum(n for _, n in own) <= 4096 for own in taken.values())
    assert all(a + n == b for own in taken.values() for (a, n), (b, _) in zip(sorted(own)[:-1], sorted(own)[1:], strict=True))
