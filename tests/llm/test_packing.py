import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarn.llm import packing

from .helpers import documents

TEXTS = [None, "", "Hello  world\n é 日本 😀", "<|endoftext|> and <| x", "a<|endoftext|><|endoftext|>b", "1234 it's", "x" * 3000, " \t mixed \r\n  "]


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._encoder("byte_bpe_50k")
    r = random.Random(1)
    texts = [x or "" for x in TEXTS] + ["".join(chr(r.choice([32, 97, 233, 0x4E2D, 0x1F600, 10, 39, 48])) for _ in range(60)) for _ in range(200)]
    for x in texts:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


LONG = {"spaces": " " * 1_000_000, "feeds": "\n" * 1_000_000, "letter": "a" * 1_000_000, "signs": "." * 1_000_000, "mixed": " \t\n\u00a0" * 250_000 + "x", "digits": "7" * 300_000}


@pytest.mark.parametrize("name", LONG)
def test_long_runs_keep_their_ids(name):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._encoder("byte_bpe_50k")
    for text in (LONG[name], "word" + LONG[name] + "word<|endoftext|>"):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    for n in (packing._LONG_RUN - 1, packing._LONG_RUN, packing._LONG_RUN + 1):  # both sides of the switch
        text = "a" + LONG[name][:n] + "b"
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check(spark, docs, capacity, **options):
    rows = [r.asDict() for r in packing.pack(documents(spark, docs), capacity=capacity, **options).collect()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_round_trip(spark):
    r = random.Random(2)
    docs = list(enumerate(TEXTS)) + [(None, "no number"), (1, ""), (50, " " * 1_000_000)] + [(100 + i, "word " * r.randint(0, 90)) for i in range(300)]
    used, least = check(spark, docs, 64)
    assert used <= 1.03 * least + 1
    used, least = check(spark, docs, 64, pieces_per_task=60)  # several tasks and a second round
    assert used <= 1.1 * least + 2
    assert packing.pack(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_local_search(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, 100), r.randint(30, 60)]) for _ in range(120)]
    bins = packing.Bins(100)
    bins.best_fit(sizes)
    before = sum(f > 0 for f in bins.fill)
    squares = bins.squares()
    bins.local_search()
    assert sorted(i for b in bins.items for _, i in b) == list(range(120))
    assert all(f == sum(s for s, _ in b) <= 100 for b, f in zip(bins.items, bins.fill, strict=True))
    assert bins.squares() >= squares and sum(f > 0 for f in bins.fill) <= before


def test_exchanges_empty_a_bin():
    bins = packing.Bins(10)
    bins.items = [[(6, 0), (3, 1)], [(5, 2), (4, 3)], [(2, 4)]]  # 9, 9, 2: nothing moves whole
    bins.fill = [9, 9, 2]
    bins.local_search()
    assert sum(f > 0 for f in bins.fill) == 2
