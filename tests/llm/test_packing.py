import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tmaps.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_one(lengths, capacity):
    """Remaining capacities of best-fit decreasing, one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_steps_are_best_fit_decreasing():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([1, 10, 20, 33])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        steps, bins = packing.best_fit_steps(Counter(lengths), capacity)
        fill, seen = defaultdict(list), Counter()
        for n, lo, hi, first, per, base in steps.tolist():
            assert lo == seen[n]
            seen[n] = hi
            for r in range(lo, hi):
                fill[first + (r - lo) // per].append((base + (r - lo) % per * n, n))
        assert seen == Counter(lengths) and len(fill) == bins
        for pieces in fill.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
        assert sorted(capacity - sum(n for _, n in x) for x in fill.values()) == by_one(lengths, capacity)


def test_steps_do_not_grow_with_the_pieces():
    counts = {n: 1_000_000 + n for n in range(1, 2049)}
    steps, _ = packing.best_fit_steps(counts)
    assert len(steps) < 20_000


def test_tightest_open_capacity():
    tree = packing.Capacities(20)
    for n in (3, 9, 17):
        tree.set(n, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 9, 10, 17, 18)] == [3, 3, 9, 9, 17, 17, -1]


def test_ids_equal_the_library():
    from tests.llm.test_bpe import texts
    library, ids = Tokenizer.from_file(PATH), packing.ids_of(PATH)
    for s in texts(2000, 5):
        assert np.frombuffer(ids.of(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_ids_of_very_long_white_space_equal_the_library():
    library, ids = Tokenizer.from_file(PATH), packing.ids_of(PATH)
    n = 1_150_000
    for s in (" " * n + "b", "a " + "\n" * n + "b", "a" + " \n" * (n // 2), " " * n + "<|endoftext|>" + "\n" * n + " x\x1c y",
              "it's\u3000" * 5 + "\t" * n + "\u3000é", "a" + " " * packing.LONG + "b" + "\n" * (packing.LONG - 1) + "c"):
        assert np.frombuffer(ids.of(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s[:9])


def test_rows(docs_of):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "x " * 5000), (3, "x " * 5000), (None, "null id")]
    rows += [(10 + i, " ".join("word%d" % rng.randint(0, 50) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    capacity = 64
    got = packing.pack(docs_of(rows), PATH, capacity).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % capacity + 1
        at = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(d, k, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for x in fill.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(fill) == len(by_one([w[3] for w in want], capacity))
    assert packing.pack(docs_of([]), PATH).count() == 0
