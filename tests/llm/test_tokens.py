import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gatework.llm.simple8b import decode, encode
from gatework.llm.token_output import Encoder, token_output, tokenizer_json
from tests.llm.helpers import ODD, frame


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_round_trip(values):
    v = np.array(values, np.uint64)
    assert (decode(encode(v)) == v).all()


def test_blocks_and_escapes():
    for n in (0, 1, 1023, 1024, 1025, 200_000):
        v = np.arange(n, dtype=np.uint64) * np.uint64(2**45)
        assert (decode(encode(v)) == v).all()


def test_pieces_give_the_ids_of_whole_texts():
    r = random.Random(3)
    odd = [32, 9, 10, 11, 12, 13, 39, 65, 83, 115, 116, 0x301, 0xE9, 0x130, 0x3A3, 60, 124, 62, 48, 57, 0x85, 0xA0, 0x2028, 0x1C, 46, 35, 0x4E2D, 0x1F600, 0xAD, 0x200D]
    texts = ["".join(chr(r.choice(odd)) for _ in range(40)) for _ in range(500)] + ["a<|endoftext|>b <|ENDOFTEXT|> it's IT'S don't. 'S 's!'s", "", None]
    json = tokenizer_json()
    plain, encoder = Tokenizer.from_str(json), Encoder(json)
    for _ in range(2):  # the second time from the cache
        ids, counts = encoder.ids(pa.array(texts))
        at = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t
            at += n


def test_other_tokenizers_encode_whole_texts():
    texts = ["It's a Test.Of   pieces", "don't<|endoftext|>x", "", None, "\u65e5\u672c word" * 50]
    for json in (tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")), tokenizer_json().replace('{"type":"Lowercase"}', '{"type":"NFD"}')):
        plain, encoder = Tokenizer.from_str(json), Encoder(json)
        assert not encoder.cuts
        ids, counts = encoder.ids(pa.array(texts))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert Encoder(tokenizer_json()).cuts


def test_letters_that_nfc_takes_apart():
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L" and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xD7A4 <= c < 0x17000)]
    texts = ["\u09b9\u09df", "\u0938\u095c\u0915", "\u09b9\u09df \u0938\u095c\u0915 plain words", *(f"x{c}y" for c in letters), *letters]
    json = tokenizer_json()
    plain, encoder = Tokenizer.from_str(json), Encoder(json)
    for part in (texts[:1], texts[:3], texts):
        ids, counts = encoder.ids(pa.array(part))
        want = [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_files_give_back_all_ids(spark):
    got = token_output(frame(spark)).collect()
    plain = Tokenizer.from_str(tokenizer_json())
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_output(frame(spark, [])).count() == 0
