"""The corpus operators' parts against brute force and the libraries."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from wayfern.llm import bpe, decontam, lang_id, line_dedup, near_dup, pii, secret_scan, token_store, topk

ODD = [None, "", " ", "\n\n", "a  b", "x \n y", "\t\r\n", "ab\n\ncd", "end \n\n", "don't we'll 12abé日本!? ", "<|endoftext|>", "\x01\n \x00a", "é" * 3000, "na ïve"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_the_library(codec):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choices(" \n\t\r'\x1cab1²é日!.sSt<|>", k=rnd.randint(0, 16))) for _ in range(1500)] + ["a" * 5000, "ab" * 700]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids.tolist() == e.encode_ordinary(text or "")
        assert codec.decode_bytes(ids) == (text or "").encode()
        assert codec.decimal_ids(ids).decode() == " ".join(map(str, ids.tolist()))


def test_bpe_cache_is_bounded():
    c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, cache_entries=50)
    texts = [f"word{i} other{i * 7}" for i in range(200)]
    assert [c.decode_bytes(x).decode() for x in c.encode_batch(texts)] == texts


def test_words_equal_the_library():
    w = token_store.WordEncoder(P.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choices(" \n\xa0\x85\x1cab1²É日!.'sSſΣς<|>éİ", k=rnd.randint(0, 14))) for _ in range(800)]
    for text, ids in zip(texts, w.encode_batch(texts), strict=True):
        assert ids.tolist() == w.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 10_000])
def test_planes_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << 20, n).astype("<u4")
    assert (token_store.unpack_planes(token_store.pack_planes(ids), n) == ids).all()


def test_token_file_round_trip(tmp_path):
    from wayfern.llm import storage

    rnd = np.random.default_rng(0)
    docs = [(None, rnd.integers(0, 9, 3)), *((i, rnd.integers(0, 50_000, int(rnd.integers(0, 900)))) for i in range(60))]
    docs = [(d, x.astype("<u4")) for d, x in docs]
    with storage.write_atomic(f"{tmp_path}/f") as sink:
        w = token_store.Writer(sink, chunk_ids=1000, block=64)
        for d in docs:
            w.add(*d)
        w.close()
    with storage.open_read(f"{tmp_path}/f") as source:
        r = token_store.Reader(source, block=64)
        assert [(d, x.tolist()) for d, x in r.documents()] == [(d, x.tolist()) for d, x in docs]
        flat = np.concatenate([x for _, x in docs])
        assert (r.ids(990, 2500) == flat[990:2500]).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_brute(t):
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    good = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 16 <= len(digits(x)) <= 19 and pii.luhn(digits(x)),
        "phone": lambda x: 8 <= len(digits(x)) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if good[k](m.group())]


@pytest.mark.parametrize("alphabet", ["a1@.-+ é", "12.", "0123 -", "+1 (2).-a", "a@b.c-d", "0.25 -+()"])
def test_pii_base_spans(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(3000):
        t = "".join(rnd.choices(alphabet, k=rnd.randint(0, 28)))
        assert [s for s in pii.find(t) if s[0] in pii.KINDS] == pii_brute(t)
    card = "4111 1111-1111 1111"
    assert ("card", 2, 2 + len(card)) in pii.find(f"x {card}.")


def test_pii_added_spans():
    assert ("account", 5, 27) in pii.find("IBAN GB82WEST12345698765432 x")
    assert [s for s in pii.find("IBAN GB83WEST12345698765432 x") if s[0] == "account"] == []
    assert ("login", 8, 15) in pii.find("https://me:pass@host/x")


def test_secret_base_spans():
    rnd = random.Random(3)
    for _ in range(4000):
        t = "".join(rnd.choices(["AKIA", "A", "1", "f", "0a1b2c", "secret", "Token", "api_key", "=", ":", " ", '"', "Z9", "ſ"], k=rnd.randint(0, 18)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, t, re.I | re.A) if len(m.group(2)) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
        assert secret_scan.base_spans(t) == [(a, b, secret_scan.KINDS[k]) for a, k, b in sorted(want)]


def test_window_entropy_and_allow_list():
    def brute(s, w):
        return max(-sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) for x in (s[i : i + w] for i in range(max(1, len(s) - w + 1))))

    rnd = random.Random(4)
    for _ in range(300):
        s = "".join(rnd.choices("abcdef0123456789", k=rnd.randint(1, 60)))
        assert abs(secret_scan.window_entropy(s, 20) - brute(s, 20)) < 1e-9
    rule = secret_scan.EntropyRule()
    assert secret_scan.entropy_spans("id 123e4567-e89b-12d3-a456-426614174000 end", rule) == []
    assert secret_scan.entropy_spans("id q7RkX2pLm9ZtW4vBn8YcD3fH6 end", rule) == [(3, 28, "entropy_alnum")]


def test_topk_blocks_equal_brute_force():
    rnd = np.random.default_rng(1)
    m = rnd.integers(-3, 4, (400, 6)).astype(float)
    ids = rnd.permutation(400)
    blocks = [(ids[i : i + 32], m[i : i + 32], m[i : i + 32].max(0), m[i : i + 32].min(0)) for i in range(0, 400, 32)]
    best, _ = topk.search_blocks(ids[:30], m[:30], blocks, 10)
    for q, found in zip(range(30), best, strict=True):
        want = sorted(((int(m[q] @ m[i]), int(ids[i])) for i in range(400) if ids[i] != ids[q]), key=lambda x: (-x[0], x[1]))[:10]
        assert found == want


def test_patience_and_blocks():
    assert line_dedup.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert line_dedup.common_blocks([1, 2, 3], [8, 1, 2, 9], [5, 5, 5, 5]) == [1, 2]
    assert line_dedup.common_blocks([1, 2, 3], [8, 1, 9, 2], [5, 5, 5, 5]) == []
    assert line_dedup.patience([], [1]) == []


def test_sets_and_links():
    a = near_dup.shingle_set("One two three four five six seven eight")
    assert len(a) == 4 and (a == near_dup.shingle_set("one TWO three four five\tsix\nseven eight")).all()
    assert len(near_dup.shingle_set("a b")) == 1 and len(near_dup.shingle_set(" ")) == 0 == len(near_dup.shingle_set(None))
    x, y = np.arange(100, dtype=np.uint64), np.arange(14, 114, dtype=np.uint64)
    assert near_dup.linked(x, y) and not near_dup.linked(x, np.arange(15, 115, dtype=np.uint64))


def test_templates_find_changed_questions():
    import pyarrow as pa

    item = "If a train travels from Paris at 60 km per hour for 3 hours then how far from Paris will the train be"
    other = item.replace("60", "85").replace("Paris", "Lyon")
    t = decontam.Templates()
    a, b = (decontam.windows(*t.canonical(pa.array([x])))[0].tolist() for x in (item, "Some words before it. " + other))
    assert set(a) <= set(b)


def test_allow_list_reads_once_and_whole_parts():
    """Long separator lines in linear time; a word lets a candidate go only as a part of its own; plain paths are none."""
    import time

    rule = secret_scan.EntropyRule()
    for text in ("-" * 100_000 + "9", "_/" * 50_000 + "9", "ab-" * 33_000 + "9", "a9-" * 33_000, "12-" * 33_000 + "x", "/usr1" * 20_000 + "//=9"):
        began = time.perf_counter()
        assert not rule.allowed(text)
        assert time.perf_counter() - began < 0.1
    spans = lambda t: secret_scan.entropy_spans(t, rule)
    assert spans("ThisIsARandomSampleKey9f8g7h6j5k4l") == [(0, 34, "entropy_alnum")]
    assert spans("/usr/local/lib/python3/site-packages/numpy") == [] == spans("key-sample-q7RkX2pLm9ZtW4vBn8YcD3fH6") == spans("Example/q7RkX2pLm9ZtW4vBn8YcD3fH6")
    assert spans("q7RkX2pLm9Zt/W4vBn8YcD3fH6") and spans("/opt/q7RkX2pLm9ZtW4vBn8YcD3fH6")


def test_identifiers_behind_cues():
    found = lambda t: [t[a:b] for k, a, b in pii.find(t) if k == "account"]
    for text, want in (
        ("passport: X1234567", "X1234567"),
        ("passport no. C01X00T47, issued", "C01X00T47"),
        ("Passport number is AB1234567.", "AB1234567"),
        ("passport 12AB34567", "12AB34567"),
        ("Konto-Nr. 12345678", "12345678"),
        ("Kontonummer: 12345678", "12345678"),
        ("account " + "7" * 40, "7" * 40),
        ("account no:" + " " * 40 + "1234-5678", "1234-5678"),
        ("Account number 12 345 678", "12 345 678"),
    ):
        assert found(text) == [want], text
    for text in ("passport HOLDERS", "passport expired 2024", "account manager", "passport none 123456", "passport X12", "Passport X1234567y", "IBAN GB83WEST12345698765432", "IBAN X1234567"):
        assert found(text) == [], text


def test_recall_of_planted_identifiers():
    """Every kind, planted in prose; what stands in README comes from here."""
    rnd = random.Random(12)
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))

    def card():
        body = digits(15)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    def iban():
        body = digits(18)
        return next(x for x in (f"DE{k:02d}{body}" for k in range(2, 99)) if pii.iban(x))

    make = {
        "email": lambda: f"user{digits(3)}@host{digits(2)}.example.org",
        "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+49 {digits(3)} {digits(7)}",
        "account": lambda: rnd.choice([lambda: "IBAN " + iban(), lambda: f"passport no. {rnd.choice('ABCX')}{digits(7)}", lambda: f"Konto-Nr. {digits(8)}", lambda: f"SSN {digits(3)}-{digits(2)}-{digits(4)}"])(),
        "login": lambda: f"https://u{digits(2)}:p{digits(5)}@host.example.org/x",
    }
    for kind, new in make.items():
        hits = sum(any(s[0] == kind for s in pii.find(f"Some words before {new()} and some behind")) for _ in range(300))
        assert hits == 300, (kind, hits)
