from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from weft.llm import ogg, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


HEX = "0123456789abcdef" * 3
TEXTS = [
    "", "password = hunter2hunter", "PassWord:'abc'  token=abcdef. api_key: \"" + HEX + "\"", "AKIA" + "Q" * 16 + " AKIAAKIA" + "1" * 15 + "a AKIAshort", "é" * 9 + " secret= x\nsecret=\U0001f600 secret = y123456",
    "\u212Aey to\u212Aen = abcdefgh \u017Fecret = abcdefgh", HEX + HEX.upper() + " x" + HEX, "token" + " " * 5000 + "= " + "z" * 50, "token token = token=abcdefgh",
]


def test_rules_against_plain_patterns():
    r = random.Random(4)
    bits = ["token", "=", ":", " ", '"', "AKIA", "0a1b2c3d4e5f6a7b8c9d0e1f", "QWERTY12345", "password", "api_key", "\n", "é", "x", "\x1c", "\u3000"]
    for t in TEXTS + ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(500)]:
        assert secrets.rule_spans(t) == brute(t)


@pytest.fixture(scope="module")
def network():
    rows, y = secrets.made_up(random.Random(11))
    return secrets.train(np.array([secrets.window(*r) for r in rows]), np.array(y, float))


def test_network_is_calibrated_on_unseen_findings(network):
    rows, y = secrets.made_up(random.Random(99))
    p = network.score(np.array([secrets.window(*r) for r in rows]))
    y = np.array(y)
    assert (p[y == 1] >= network.threshold).mean() >= 0.95 and (p[y == 0] >= network.threshold).mean() <= 0.05
    assert abs(p.mean() - y.mean()) < 0.1


def test_scan_and_redact(spark, network, odd, none):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (None, "token=abcdefgh")], "doc_id long, text string").withColumn("spans", F.lit("x"))
    for r in secrets.scan(df, network).collect():
        t = next((t for i, t in enumerate(TEXTS) if i == r["doc_id"]), "token=abcdefgh" if r["doc_id"] is None else "")
        b = brute(t)
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in b) for x in range(3)]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("net")] == (joined.split(",") if joined else [])
    assert secrets.scan(odd, network).count() == odd.count() and secrets.scan(none, network).count() == 0
    clean = secrets.redact(odd, network)
    assert rows_of(clean) == rows_of(odd)
    done = secrets.redact(spark.createDataFrame([(1, "a token = abcdefgh b", 20)], "doc_id long, text string, n_chars long"), network).first()
    assert (done["text"], done["n_chars"]) == ("a [SECRET] b", 12)


def test_keys_late_in_a_run(network):
    r = random.Random(9)
    texts, at = [], []
    for n in range(40):
        lead = "path/to/page/" * (4 + n % 5)
        key = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
        texts.append(f"see {lead}{key} there")
        at.append(4 + len(lead))
    got = secrets.net_spans(texts, [[] for _ in texts], network)
    assert sum(any(s <= a and a + 40 <= e for s, e in spans) for a, spans in zip(at, got, strict=True)) >= 38
    # every character is in a window, and those that hold a rule's finding are left out
    assert {i for s, e in secrets.windows(3, 130) for i in range(s, e)} == set(range(3, 130)) and secrets.windows(3, 30) == [(3, 30)]
    # what a rule's span holds is not said again; what it only touches is
    assert secrets.net_spans(texts, [[(0, 2, len(t))] for t in texts], network) == [[] for _ in texts]
    assert secrets.net_spans(texts, [[(a, 2, a + 40)] for a in at], network) == got


def test_fit_on_documents(spark, sample, none):
    n = secrets.fit(sample)
    assert 0 < n.threshold < 1 and 0 < secrets.fit(none).threshold < 1
    # planted in other texts, of findings that no rule decides at least nine tenths are found
    texts = [secrets.plant(f"{r['text'][:400]} unseen") for r in sample.collect() if r["text"] and " " in r["text"]]
    open_ = [(t, s, e) for t, s, e in texts if not secrets.Spans(secrets.rule_spans(t)).meet(s, e)]
    got = secrets.net_spans([t for t, _, _ in open_], [secrets.rule_spans(t) for t, _, _ in open_], n)
    whole = [(s, e) for t, s, e in open_ if any(a <= s and e <= b for a, b in secrets.candidates(t))]
    hits = sum(any(a <= s and e <= b for a, b in spans) for (_, s, e), spans in zip(open_, got, strict=True))
    assert len(open_) > 50 and hits >= 0.9 * len(whole)


def test_spans_against_every_pair():
    r = random.Random(3)
    for _ in range(200):
        spans = sorted((a := r.randrange(60), r.randrange(3), a + r.randrange(1, 12)) for _ in range(r.randrange(8)))
        s = r.randrange(60)
        e = s + r.randrange(1, 9)
        x = secrets.Spans(spans)
        assert x.meet(s, e) == any(a < e and s < b for a, _, b in spans)
        assert x.hold(s, e) == any(a <= s and e <= b for a, _, b in spans)


def test_net_spans_against_one_by_one(network, sample):
    texts = [r["text"] or "" for r in sample.collect()]
    got = secrets.net_spans(texts, [secrets.rule_spans(t) for t in texts], network)
    for t, spans in zip(texts, got, strict=True):
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and not any(a <= m.start() and m.end() <= b for a, _, b in brute(t)):
                if max(network.score(secrets.window(t, x, y)[None])[0] for x, y in secrets.windows(m.start(), m.end())) >= network.threshold:
                    want.append((m.start(), m.end()))
        assert spans == want


def test_texts_full_of_findings(network):
    text = " ".join(f"token=abcdef{i} /p/q/r/s/t/u/v{i}" for i in range(20_000))
    spans = secrets.rule_spans(text)
    start = time.perf_counter()
    secrets.net_spans([text], [spans], network)
    assert len(spans) == 20_000 and time.perf_counter() - start < 60


def slow_crc(b):
    c = 0
    for x in b:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


def test_pages_and_packets():
    for n in (0, 1, 27, 300):
        assert ogg.checksum(b := os.urandom(n)) == slow_crc(b)
    packets = [os.urandom(n) for n in (0, 1, 254, 255, 256, 510, 65_025, 65_026, 200_000)]
    pages = ogg.pages_of(7, packets, list(range(1, 10)))
    others = ogg.pages_of(8, [b"other"] * 3, [5, 6, 7])
    woven = b"".join(x for p in zip(pages, [*others, *[b""] * len(pages)], strict=False) for x in p)
    streams, broken = ogg.demultiplex(b"noise" + woven + b"OggS")
    assert streams[7].packets == packets and streams[8].packets == [b"other"] * 3 and broken == 1 and streams[7].ended
    assert streams[7].times(2)[-1] == 4.5
    hurt = bytearray(woven)
    hurt[len(pages[0]) + 60] ^= 1
    streams, broken = ogg.demultiplex(bytes(hurt))
    assert broken >= 1 and streams[7].packets[: 3] == packets[:3]
    lost = b"".join(p for i, p in enumerate(pages) if i != 2)
    streams, _ = ogg.demultiplex(lost)
    assert streams[7].lost == 1 and set(streams[7].packets) <= set(packets)


def test_media_round_trip(spark, odd, none):
    got = rows_of(ogg.read_media(ogg.media_column(odd.withColumn("media", F.lit("x")))), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "broken_pages")
    want = []
    for r in odd.collect():
        t = (r["text"] or "").encode()
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        want.append((r["doc_id"], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), 0))
    assert got == sorted(want, key=repr)
    assert ogg.read_media(ogg.media_column(none)).count() == 0
    assert ogg.read_samples(b"")[:2] == (b"", 0)


def test_files_of_many_packets():
    for n in (576, 4608, 5184, 57_600, 576 * 997):
        payload = os.urandom(n)
        media = ogg.write(payload, n - 3)
        streams, broken = ogg.demultiplex(media)
        assert broken == 0 and len(streams) == (3) and all(s.ended for s in streams.values())
        got, length, rate, seconds, broken = ogg.read_samples(media)
        assert (got, length, broken) == (payload, n - 3, 0) and seconds == n / rate
        pages = [ogg.HEADER.unpack_from(media, m.start()) for m in re.finditer(b"OggS\x00[\x00-\x07]", media)]
        if n > 57_600:
            assert any(p[2] & ogg.CONTINUED for p in pages) and len({p[4] for p in pages}) == 3
