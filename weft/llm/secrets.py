"""Secret scans: fixed rules, and a character convolution network over every candidate with its surroundings.

Rules give spans of the kinds assign, access and hex. Candidates are all runs of 16 or more letters, digits and `+/_=-`
with a letter and a digit in them; the network, in numpy, sees every one, also those that rules have found, a long one in
windows that overlap, with the characters around, and adds spans of kind `net` where its calibrated score reaches a
threshold, unless a rule's span holds the whole candidate. The threshold is the highest at which it still finds RECALL of
the findings that were held out from training and that no rule decides.

It is trained on labelled findings: keys of many formats that are planted, seeded by the text, between the words of a
bounded sample of the documents, mostly without what a rule looks for; what the rules found there; other candidates there;
and seeded made-up examples of both (so an empty table works as well).

Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows are independent: repeated rows give
repeated results. Columns of other names are kept by redact() and left out by scan().
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, small_batches, strings

KINDS = ("assign", "access", "hex")
# Fixed patterns of the rules, with the least characters of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Documents, found and other candidates, and planted ones, at most that the network is trained on.
SAMPLE_DOCS, SAMPLE_FINDINGS, SAMPLE_OTHERS, SAMPLE_PLANTED = 20_000, 1_500, 1_500, 1_000
# Kinds of what the network is trained on.
OTHER, FOUND, PLANTED = range(3)
MADE_UP = 800
RECALL = 0.98
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Characters from one window of a candidate to the next.
STEP = INSIDE // 2
ALPHABET = string.ascii_letters + string.digits + "+/_=-.:'\"@ "
REDACTED = "[SECRET]"


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that the rules find, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    at = 0
    for piece in text.split():
        if len(piece) < LEAST["access"]:  # no match of these two holds white space
            continue
        at = text.index(piece, at)
        out += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(piece) if m.end() - m.start() >= LEAST["access"]]
        out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(piece) if m.end() - m.start() >= LEAST["hex"]]
        at += len(piece)
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for piece in text.split():
        if len(piece) < 16:
            continue
        at = text.index(piece, at)
        for m in CANDIDATE.finditer(piece):
            run = m[0]
            if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                out.append((at + m.start(), at + m.end()))
        at += len(piece)
    return out


_CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0: beyond the text, 1: any other character


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters before, of the first INSIDE of the candidate, and after it."""
    x = np.zeros(WIDTH, np.uint8)
    for at, part, room in ((BEFORE, text[start : min(end, start + INSIDE)], INSIDE), (BEFORE + INSIDE, text[end : end + AFTER], AFTER)):
        x[at : at + len(part)] = [_CODE.get(c, 1) for c in part][:room]
    left = text[max(0, start - BEFORE) : start]
    x[BEFORE - len(left) : BEFORE] = [_CODE.get(c, 1) for c in left]
    return x


@dataclass
class Network:
    """Embedding, one convolution of 5 characters, largest and mean over the places, and a logistic unit."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.embed[x]  # rows, places, dims
        v = np.lib.stride_tricks.sliding_window_view(e, 5, axis=1)  # rows, places - 4, dims, 5
        v = v.reshape(*v.shape[:2], -1)
        h = np.maximum(v @ self.filters + self.bias, 0)
        return v, h, np.concatenate([h.max(1), h.mean(1)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.hidden(x[i : i + 512])[2] @ self.out + self.shift for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.offset)))


def train(x: np.ndarray, y: np.ndarray, open_: np.ndarray | None = None, seed: int = 7, rounds: int = 12, dims: int = 8, filters: int = 24) -> Network:
    """Adam on the cross entropy; a fifth is held out for calibration and, those that are open_ to it, for the threshold."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    n = Network(rng.normal(0, 0.3, (len(ALPHABET) + 2, dims)), rng.normal(0, 0.2, (dims * 5, filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters), 0.0)
    names = ("embed", "filters", "bias", "out")
    first, second = ({k: np.zeros_like(getattr(n, k)) for k in names} for _ in range(2))
    t = 0
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            xb, yb = x[batch], y[batch]
            v, h, top = n.hidden(xb)
            d = (1 / (1 + np.exp(-(top @ n.out + n.shift))) - yb) / len(yb)
            f = h.shape[2]
            dh = np.broadcast_to((d[:, None] * n.out[f:] / h.shape[1])[:, None, :], h.shape).copy()
            np.put_along_axis(dh, h.argmax(1)[:, None, :], np.take_along_axis(dh, h.argmax(1)[:, None, :], 1) + (d[:, None] * n.out[:f])[:, None, :], 1)
            dh *= h > 0
            de = np.zeros((*xb.shape, dims))
            dv = (dh @ n.filters.T).reshape(*dh.shape[:2], dims, 5)
            for k in range(5):
                de[:, k : k + dh.shape[1]] += dv[..., k]
            embed = np.zeros_like(n.embed)
            np.add.at(embed, xb, de)
            grads = {"embed": embed, "filters": np.einsum("npi,npf->if", v, dh, optimize=True), "bias": dh.sum((0, 1)), "out": top.T @ d}
            t += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                setattr(n, k, getattr(n, k) - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8))
            n.shift -= 0.05 * float(d.sum())
    z, want = n.logits(x[held]), y[held]
    for _ in range(200):  # Platt's scaling
        p = 1 / (1 + np.exp(-(n.scale * z + n.offset)))
        n.scale -= 0.1 * float(np.mean((p - want) * z) / max(1.0, float(np.mean(z * z))))
        n.offset -= 0.5 * float(np.mean(p - want))
    found = np.sort(n.score(x[held][(want == 1) & (True if open_ is None else open_[held])]))
    n.threshold = float(found[int((1 - RECALL) * len(found))]) if len(found) else 0.5
    return n


# Alphabets and beginnings of keys.
ALPHABETS = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits)
BEGINNINGS = ("", "AKIA", "sk-", "ghp_")


def made_key(rng: random.Random) -> str:
    letters = rng.choice(ALPHABETS)
    return rng.choice(BEGINNINGS) + "".join(rng.choice(letters) for _ in range(rng.randint(20, 48)))


def made_up(rng: random.Random) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Seeded findings and others: keys in and out of assignments; words, numbers, addresses and names."""
    rows, labels = [], []
    word = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    around = lambda: " ".join(word(rng.randint(2, 8)) for _ in range(3))
    for _ in range(MADE_UP):
        key = made_key(rng)
        before = around() + rng.choice([" ", " token = \"", " password: ", " api_key=", " secret = '", " key: "])
        other = rng.choice([word(rng.randint(6, 12)) + "-" + word(8) + str(rng.randint(0, 99)), "page" + str(rng.randint(10**12, 10**16)), (word(4) + "/") * 3 + str(rng.randint(0, 2099)), "=" * rng.randint(16, 30) + "x1", word(1) * rng.randint(16, 30) + str(rng.randint(0, 9)), word(9) + "_" + word(9) + "_v" + str(rng.randint(1, 9))])
        for label, value, lead in ((1, key, before), (0, other, around() + " ")):
            rows.append((lead + value + rng.choice([" ", "\"", "'", ".", "\n"]) + around(), len(lead), len(lead) + len(value)))
            labels.append(label)
    return rows, labels


def plant(text: str) -> tuple[str, int, int]:
    """A text with a key between two of its words, seeded by the text, and where it is."""
    rng = random.Random(zlib.crc32(text.encode()))
    at = text.find(" ", rng.randint(0, len(text))) + 1
    lead, key = rng.choice(["", "", "(", '"', "key ", "id: ", "Bearer ", "url/"]), made_key(rng)
    return f"{text[:at]}{lead}{key} {text[at:]}", at + len(lead), at + len(lead) + len(key)


class Spans:
    """Ordered spans, some of which may overlap, that are looked up by one pass over their ends."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends, most = [s for s, _, _ in spans], [], 0
        for _, _, e in spans:
            most = max(most, e)
            self.ends.append(most)

    def hold(self, s: int, e: int) -> bool:
        """Whether some span begins at s or before and ends at e or after."""
        i = bisect_right(self.starts, s)
        return i > 0 and self.ends[i - 1] >= e

    def meet(self, s: int, e: int) -> bool:
        """Whether some span overlaps s to e."""
        i = bisect_left(self.starts, e)
        return i > 0 and self.ends[i - 1] > s


def fit(docs: DataFrame, text: str = "text") -> Network:
    """The network, from a sample of at most SAMPLE_DOCS documents (by the hash of their text)."""
    n = docs.count()
    parts = 1_000_000
    few = docs.select(text).filter(F.pmod(F.xxhash64(text, F.lit(17)), F.lit(parts)) < min(parts, parts * SAMPLE_DOCS // max(1, n)))

    def f(batch: pa.RecordBatch) -> dict:
        seen, kinds, ruled = [], [], []
        for t in strings(batch.column(0)):
            found = Spans(rule_spans(t))
            for s, e in (w for c in candidates(t) for w in windows(*c)):
                seen.append(window(t, s, e).tobytes())
                kinds.append(FOUND if found.meet(s, e) else OTHER)
                ruled.append(kinds[-1])
            if " " in t:
                changed, s, e = plant(t)
                near = changed[max(0, s - 200) : e + 200]  # as far as a window and the rules around it reach
                s, e = s - max(0, s - 200), e - max(0, s - 200)
                seen.append(window(near, s, min(e, s + INSIDE)).tobytes())
                kinds.append(PLANTED)
                ruled.append(int(Spans(rule_spans(near)).meet(s, e)))
        return {"x": seen, "kind": kinds, "ruled": ruled}

    rows = map_batches(few, f, "x binary, kind int, ruled int").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("x"), "x", "ruled"))
    most = F.when(F.col("kind") == FOUND, SAMPLE_FINDINGS).when(F.col("kind") == OTHER, SAMPLE_OTHERS).otherwise(SAMPLE_PLANTED)
    sample = rows.withColumn("nth", nth).filter(F.col("nth") <= most).collect()
    texts, labels = made_up(random.Random(11))
    x = np.array([window(*r) for r in texts] + [np.frombuffer(r["x"], np.uint8) for r in sample])
    open_ = [not any(rule_spans(t)) for t, _, _ in texts] + [not r["ruled"] for r in sample]
    return train(x, np.array(labels + [int(r["kind"] > 0) for r in sample], float), np.array(open_))


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of INSIDE characters, STEP apart, in which every character of the candidate is; the last ends where it ends."""
    starts = [*range(start, max(start, end - INSIDE), STEP), max(start, end - INSIDE)]
    return [(s, min(end, s + INSIDE)) for s in starts]


def net_spans(texts: list[str], found: list[list[tuple[int, int, int]]], network: Network) -> list[list[tuple[int, int]]]:
    """For each text, the candidates that the network takes for secrets, by the best of their windows, and that no rule's span holds."""
    where, rows, first = [], [], []
    for i, t in enumerate(texts):
        for s, e in candidates(t):
            where.append((i, s, e))
            first.append(len(rows))
            rows += [window(t, x, y) for x, y in windows(s, e)]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if rows:
        held = {i: Spans(found[i]) for i in {i for i, _, _ in where}}
        for (i, s, e), p in zip(where, np.maximum.reduceat(network.score(np.array(rows)), first), strict=True):
            if p >= network.threshold and not held[i].hold(s, e):
                out[i].append((s, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    kinds = (*KINDS, "net")
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, network: Network | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts by rule, the digest of the rules' spans, and all spans."""
    network = network or fit(docs, text)
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")

    def f(batch: pa.RecordBatch) -> dict:
        texts = strings(batch.column(1))
        base = [rule_spans(t) for t in texts]
        out: dict = {n: [] for n in names}
        for found, more in zip(base, net_spans(texts, base, network), strict=True):
            kinds = [k for _, k, _ in found]
            row = (*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(found).encode()).hexdigest(), _joined(sorted(found + [(s, 3, e) for s, e in more])))
            for n, value in zip(names, row, strict=True):
                out[n].append(value)
        return out | {key: batch.column(0)}

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), f, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, network: Network | None = None, text: str = "text") -> DataFrame:
    """docs with every span, those that overlap as one, replaced by a mark; n_chars is counted again where it is there."""
    network = network or fit(docs, text)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(t: str, spans: list[tuple[int, int]]) -> str:
        parts, end = [], 0
        for s, e in sorted(spans):
            if s >= end:
                parts += [t[end:s], REDACTED]
            end = max(end, e)
        return "".join([*parts, t[end:]])

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(at))
            base = [rule_spans(t) for t in texts]
            more = net_spans(texts, base, network)
            spans = [[(s, e) for s, _, e in a] + b for a, b in zip(base, more, strict=True)]
            if any(spans):
                given = batch.column(at).to_pylist()
                texts = [clean(t, s) if s else g for t, s, g in zip(texts, spans, given, strict=True)]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if counted is not None:
                    columns[counted] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, columns[counted].to_pylist(), strict=True)], batch.schema.field(counted).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
