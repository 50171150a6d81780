import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tmaps.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdeé'sStrem ll  \n\t!.<|endoftext|>123²½ 　日本語😀​ÀΩжs've\x85\x1c\r"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        s = "".join(rng.choice(LETTERS) if rng.random() < .9 else chr(rng.randrange(1, 0xD800)) for _ in range(rng.randint(0, 60)))
        yield "<|endoftext|>" + s + "<|endoftext|>" if k % 9 == 0 else s


def test_equal_to_the_library(library):
    e = bpe.Encoder(bpe.Vocabulary(PATH), memo=500)  # small: it is emptied again and again
    for s in texts(4000, 1):
        ids = np.frombuffer(e.encode(s), "<u4")
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)
        assert e.v.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False) == s


def test_backtracking_gives_the_merges_in_order():
    """Against applying the merges by rank, on words of letters that merge in many ways."""
    e = bpe.encoder(PATH)
    rng, v = random.Random(2), bpe.encoder(PATH).v
    for _ in range(3000):
        raw = bytes(rng.choice(b"abestinoh ") for _ in range(rng.randint(1, 25)))
        parts = [v.id_of[bytes([b])] for b in raw]
        while True:
            found = [(v.rank[v.made[p]], i) for i, p in enumerate(zip(parts, parts[1:])) if p in v.made]
            if not found:
                break
            _, i = min(found)
            parts[i:i + 2] = [v.made[parts[i], parts[i + 1]]]
        assert e.word(raw) == parts


def test_long_words_and_texts(library):
    e = bpe.encoder(PATH)
    for s in ("a" * 20000, "ab" * 9000, " " * 5000, "\n" * 999 + "x", "1" * 3000, "word " * 20000):
        assert np.frombuffer(e.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_query_rows(docs_of, rows_of, library):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (1, "Hello  world"), (None, "x"), (4, "<|endoftext|>")]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe.round_trip(docs_of(rows), PATH)) == sorted(want, key=repr)
    assert bpe.round_trip(docs_of([]), PATH).count() == 0
    first = bpe.tokens(docs_of(rows[:1]), PATH).first()
    assert first["decoded"] == "Hello  world" and first["ids"] == library.encode("Hello  world").ids


def test_time_grows_with_the_length_of_a_word(library):
    """One word of two million letters, in seconds, with the library's ids."""
    import time
    rng = random.Random(21)
    text = "".join(rng.choice("abcdeéßtnrs") for _ in range(2_000_000))
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    begin = time.time()
    ids = np.frombuffer(e.encode(text), "<u4")
    assert time.time() - begin < 60
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_memos_change_nothing(library):
    rng = random.Random(22)
    e, texts = bpe.Encoder(bpe.Vocabulary(PATH), memo=8), [" ".join(rng.choice(["the", "of", "x%d" % rng.randrange(40), "\n", "ab"]) for _ in range(60)) for _ in range(30)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
