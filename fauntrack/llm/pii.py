"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The base finds email, ip, card and phone by pattern. The model, trained in numpy
on labelled spans (bounded number of carrier texts from the table with spans of
known kind set into them), adds spans that the patterns miss: card numbers with
a wrong check digit, phone numbers without a plus sign or with slashes, dashes
and spaces beyond ASCII, addresses without a dot or spelled with "at" and "dot".
A text is read in overlapping windows around every digit, every @ and the words
and brackets of spelled addresses, widened to whole tokens (an address spelled
with a bare "at" and no "dot" is not read). Each character takes the scores of the window in which it is
most central, and one Viterbi pass over the stretch reconciles the windows. What
the model marks is kept by its content alone (numbers of digits, four parts of
an ip, a sign or word for @), whatever its separators are.

Defined results: null or empty texts have no spans; repeated rows are read one
by one; an empty table gives an empty result; extra columns are ignored; work
is linear in the text and memory bounded, also for very long texts of digits
alone, which are decoded in overlapping pieces.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, table

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Carrier texts and the characters used of each (both bound the fitting data only), window and its step.
CARRIERS, CARRIER_CHARS, WINDOW, STEP = 200, 4000, 96, 48
#: Margin around a place where a span can stand, most characters added to end on whole tokens, and characters decoded at once.
MARGIN, TOKEN, LONGEST, OVERLAP = 24, 80, 2048, 256
_SEED = re.compile(r"\d+|@|\b[Dd][Oo][Tt]\b|[(\[{<]\s?[Aa][Tt]\s?[)\]}>]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns by kind: leftmost, not overlapping within a kind, without the failing ones."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1) if start == at else end
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 2 * 19:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
            out["phone"].append(m.span())
    return out


# ---------------------------------------------------------------- model

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_PUNCTUATION = "@.-+()_%/:,;\"'=#*$&|<>[]!? \n"
_LETTERS = "atdo"  # letters of the words that stand for signs in spelled addresses
_CLASSES = 5 + len(_PUNCTUATION) + len(_LETTERS)


def _char_classes() -> np.ndarray:
    """Class of each character of the basic plane: digit, lower, upper, other, other letters, and each sign of its own.

    Digits, spaces and dashes of any script are those of ASCII.
    """
    out = np.full(65537, 4, np.int64)
    out[:128] = 3
    out[48:58], out[97:123], out[65:91] = 0, 1, 2
    for k, c in enumerate(_PUNCTUATION + _LETTERS):
        out[ord(c)] = 5 + k
        out[ord(c.upper())] = 5 + k
    for code in range(128, 65536):
        kind = unicodedata.category(chr(code))
        if kind in ("Nd", "Zs", "Pd"):
            out[code] = 0 if kind == "Nd" else out[32] if kind == "Zs" else out[45]
    return out


_CLASS = _char_classes()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(codes, 65536)]


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Bidirectional LSTM over character classes, a linear layer, and CRF transitions."""

    def __init__(self, hidden: int = 32, width: int = 10, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        f = np.float32
        self.p = {"emb": rng.normal(0, 0.5, (_CLASSES, width)).astype(f), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)).astype(f), "bias": np.zeros(TAGS, f), "trans": np.zeros((TAGS, TAGS), f), "first": np.zeros(TAGS, f)}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.3, (width + hidden, 4 * hidden)).astype(f)
            self.p[f"b{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(f)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: time x batch x width -> time x batch x hidden, in the given direction."""
        t, b, _ = x.shape
        h = c = np.zeros((b, self.h), np.float32)
        w, bias, n = self.p[f"w{d}"], self.p[f"b{d}"], self.h
        inputs = x @ w[: x.shape[2]] + bias
        wh = w[x.shape[2] :]
        out = np.empty((t, b, n), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = inputs[k] + h @ wh
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[k] = h
            if keep is not None:
                keep.append((k, before, i, f, o, g, tc))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: batch x time -> batch x time x tags."""
        x = self.p["emb"][ids.T]
        h = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        return (h @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tag paths, and its gradient."""
        p, n = self.p, self.h
        b, t = ids.shape
        x = p["emb"][ids.T]
        kept = {"f": [], "b": []}
        h = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        e = h @ p["out"] + p["bias"]
        # CRF: forward and backward sums give the marginals
        alpha, beta = np.empty((t, b, TAGS)), np.zeros((t, b, TAGS))
        alpha[0] = e[0] + p["first"]
        soft = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        for k in range(1, t):
            alpha[k] = e[k] + soft(alpha[k - 1][:, :, None] + p["trans"], 1)
        for k in range(t - 2, -1, -1):
            beta[k] = soft(p["trans"] + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = soft(alpha[-1], 1)
        marginal = np.exp(alpha + beta - z[None, :, None])
        rows, path = np.arange(b), tags.T
        loss = z.sum() - p["first"][path[0]].sum() - sum(e[k][rows, path[k]].sum() for k in range(t)) - sum(p["trans"][path[k - 1], path[k]].sum() for k in range(1, t))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        de = marginal.astype(np.float32)
        for k in range(t):
            de[k][rows, path[k]] -= 1
            if k:
                pair = np.exp(alpha[k - 1][:, :, None] + p["trans"] + (e[k] + beta[k])[:, None, :] - z[:, None, None])
                g["trans"] += pair.sum(0).astype(np.float32)
                np.add.at(g["trans"], (path[k - 1], path[k]), -1)
        g["first"] = de[0].sum(0)
        g["out"], g["bias"] = np.einsum("tbh,tbk->hk", h, de), de.sum((0, 1))
        dh_all = de @ p["out"].T
        dx = np.zeros_like(x)
        for d, part in (("f", dh_all[:, :, :n]), ("b", dh_all[:, :, n:])):
            w = p[f"w{d}"]
            width = x.shape[2]
            dh = dc = np.zeros((b, n), np.float32)
            for k, (h0, c0), i, f, o, gg, tc in reversed(kept[d]):
                dh = dh + part[k]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                g[f"w{d}"][:width] += x[k].T @ dz
                g[f"w{d}"][width:] += h0.T @ dz
                g[f"b{d}"] += dz.sum(0)
                dx[k] += dz @ w[:width].T
                dh = dz @ w[width:].T
                dc = dc * f
        np.add.at(g["emb"], ids.T, dx)
        return float(loss) / b, g

    def decode(self, emissions: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tag paths of padded stretches (batch x time x tags)."""
        p = self.p
        b, t, _ = emissions.shape
        score = emissions[:, 0] + p["first"]
        back = np.zeros((t, b, TAGS), np.int8)
        for k in range(1, t):
            step = score[:, :, None] + p["trans"]
            back[k] = step.argmax(1)
            new = step.max(1) + emissions[:, k]
            score = np.where((k < length)[:, None], new, score)
        tags = np.zeros((b, t), np.int8)
        at = score.argmax(1)
        rows = np.arange(b)
        for k in range(t - 1, -1, -1):
            inside = k < length
            tags[:, k] = np.where(inside, at, 0)
            at = np.where(inside & (k > 0), back[k][rows, at], at)
        return tags


def _made_up(rng: np.random.Generator) -> tuple[int | None, str]:
    """A labelled span, or a number or phrase that is none."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 10)))
    one = lambda *x: x[int(rng.integers(0, len(x)))]
    kind = int(rng.integers(0, 9))
    if kind == 0:
        return 0, w() + one(".", "_", "", "-", "+") + (d(2) if rng.random() < 0.6 else w()) + "@" + w() + (d(1) if rng.random() < 0.4 else "") + one(".example.com", ".org", ".example.net", "", ".co.uk")
    if kind == 5:
        at, dot = one((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT "), (" [at] ", "."))
        return 0, w() + one("", d(2), "." + w()) + at + w() + dot + one("com", "org", "net", "de")
    if kind == 1:
        return 1, one(".", ".", ".", " . ", "[.]").join(str(v) for v in rng.integers(0, 256, 4))
    if kind in (2, 4):
        n = one(13, 14, 15, 16, 16, 16, 16, 19)
        x, sep = d(n), one("", "", " ", "-", "\u00a0", "\u2013", ".", "/")
        return 2, sep.join(x[k : k + 4] for k in range(0, n, 4))
    if kind in (3, 6):
        a, b, c, sep = d(3), d(3), d(4), one("-", ".", " ", "\u00a0", "\u2013", "\u2011", "/")
        return 3, one(f"+1 ({a}) {b}{sep}{c}", f"({a}) {b}{sep}{c}", f"{a}{sep}{b}{sep}{c}", f"+{d(2)}{sep}{d(2)}{sep}{d(4)}{sep}{d(4)}", f"+1{sep}{a}{sep}{b}{sep}{c}", sep.join([d(2)] * 5), f"0{d(2)}/{d(7)}", f"+{d(2)}{d(9)}")
    y, m, dd = rng.integers(1900, 2100), rng.integers(1, 13), rng.integers(1, 29)
    hexes = "".join("0123456789abcdef"[v] for v in rng.integers(0, 16, int(rng.integers(16, 41))))
    date = one(f"{y}-{m:02d}-{dd:02d}", f"{m:02d}/{dd:02d}/{y}", f"{dd:02d}.{m:02d}.{y}", f"{y}/{m:02d}/{dd:02d}")
    numbers = one(f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{y}", d(int(rng.integers(1, 9))), f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{y}\u2013{d(4)}", f"{d(2)}/{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{y}{m:02d}{dd:02d}{d(6)}", " ".join(d(1) for _ in range(8)), ", ".join(d(2) for _ in range(6)), f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(int(rng.integers(20, 40))))
    words = one(f"look at the {w()} dot", f"a dot at {w()}", f"{w()} @ {w()} {d(2)}", f"dot {w()} at {w()}", f"token={hexes}", hexes)
    return None, one(date, f"{date} {d(2)}:{d(2)}", f"{date} {date}", numbers, numbers, numbers, words)


def train(carriers: list[str], steps: int = 420, batch: int = 48, seed: int = 17) -> Tagger:
    """A tagger fitted to made-up labelled spans in carrier text; carriers lose their own digits and @ first."""
    rng = np.random.default_rng(seed)
    plain = " ".join(re.sub(r"\S*[0-9@]\S*", "", c)[:CARRIER_CHARS] for c in carriers) or "the quick brown fox jumps over the lazy dog "
    plain = plain * (1 + 400 // len(plain))
    tagger = Tagger()
    first, second = ({k: np.zeros_like(v) for k, v in tagger.p.items()} for _ in range(2))
    size = 96
    for step in range(1, steps + 1):
        ids, tags = np.empty((batch, size), np.int64), np.zeros((batch, size), np.int64)
        for r in range(batch):
            kind, span = _made_up(rng)
            at, cut = int(rng.integers(0, len(plain) - 200)), int(rng.integers(0, 40))
            left, right = str(rng.choice([" ", " ", " ", "\n", '"', "(", ": ", "|"])), str(rng.choice([" ", " ", ", ", ". ", "\n", '"', ")", "!! "]))
            text = (plain[at : at + cut] + left + span + right + plain[at + cut : at + 200])[:size]
            ids[r] = classes_of(text.ljust(size))
            if kind is not None:
                s = cut + len(left)
                e = min(size, s + len(span))
                if s < size:
                    tags[r, s:e] = 2 + 2 * kind
                    tags[r, s] = 1 + 2 * kind
        _, g = tagger.gradients(ids, tags)
        rate = 0.02 * min(1, step / 20) * (0.1 if step > 0.8 * steps else 1)
        for k, v in g.items():
            v = np.clip(v / batch, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            tagger.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


# ---------------------------------------------------------------- spans of the model

_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ](?:0[1-9]|1[0-2])[-./ ](?:[0-2][0-9]|3[01])(?![0-9])")


def _holds(kind: int, span: str) -> bool:
    """Whether a span of the model has the content of its kind, whatever its separators are."""
    numbers = re.findall(r"\d+", span)
    n = sum(map(len, numbers))
    if kind == 0:
        spelled = re.search(r"\b(?:at)\b", span, re.I) and re.search(r"\bdot\b|\.", span, re.I)
        return re.fullmatch(r"\S+@\S+", span) is not None or (spelled is not None and "@" not in span and len(span.split()) <= 7)
    if kind and any(c.isalpha() for c in span):
        return False
    if kind == 1:
        return len(numbers) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in numbers)
    if kind == 2:
        return 13 <= n <= 19
    return 9 <= n <= 15 and (len(numbers) > 1 or "+" in span) and not _DATE.match(span)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Where spans can stand: seeds with a margin out to whole tokens, merged."""
    out: list[list[int]] = []
    for m in _SEED.finditer(text):
        last = out[-1][1] if out else 0
        if out and m.end() + MARGIN <= last:
            continue
        e = min(len(text), m.end() + MARGIN)
        bound = min(len(text), e + TOKEN)
        while e < bound and not text[e].isspace():
            e += 1
        s = max(0, m.start() - MARGIN)
        bound = max(0, last, s - TOKEN)
        while s > bound and not text[s - 1].isspace():
            s -= 1
        if out and s <= last:
            out[-1][1] = max(last, e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _pieces(text: str) -> list[tuple[int, int, int, int]]:
    """Stretches as (start, end, first and last place that a span of the piece may start at); long ones overlap."""
    out = []
    for s, e in _stretches(text):
        at, own = s, s
        while e - at > LONGEST:
            end = at + LONGEST
            out.append((at, end, own, end - OVERLAP // 2))
            own, at = end - OVERLAP // 2, end - OVERLAP
        out.append((at, e, own, e))
    return out


def model_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) found by the model in each text, by start."""
    work = [(k, *x) for k, t in enumerate(texts) for x in _pieces(t)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    work.sort(key=lambda x: x[2] - x[1])
    at = 0
    while at < len(work):
        # pieces of like length together, a bounded number of characters at once
        end = at + 1
        while end < len(work) and (end + 1 - at) * (work[end][2] - work[end][1]) <= 60_000:
            end += 1
        part = work[at:end]
        at = end
        long = max(x[2] - x[1] for x in part)
        ids = [classes_of(texts[k][s:e]) for k, s, e, _, _ in part]
        scores = np.zeros((len(part), long, TAGS), np.float32)
        central = np.full((len(part), long), -1, np.int64)
        windows = [(r, w) for r, x in enumerate(ids) for w in range(0, max(1, len(x) - WINDOW + STEP), STEP)]
        for c in range(0, len(windows), 512):
            some = windows[c : c + 512]
            block = np.full((len(some), WINDOW), _CLASS[32])
            for j, (r, w) in enumerate(some):
                x = ids[r][w : w + WINDOW]
                block[j, : len(x)] = x
            e = tagger.emissions(block)
            for j, (r, w) in enumerate(some):
                n = min(WINDOW, len(ids[r]) - w)
                middle = np.minimum(np.arange(n), np.arange(n)[::-1])
                better = middle > central[r, w : w + n]
                scores[r, w : w + n][better] = e[j, :n][better]
                central[r, w : w + n][better] = middle[better]
        tags = tagger.decode(scores, np.array([len(x) for x in ids]))
        for (k, s, e, low, high), path in zip(part, tags, strict=True):
            path = path[: e - s]
            if not path.any():
                continue
            kinds = (path - 1) // 2
            start = None
            for j in range(len(path) + 1):
                inside = j < len(path) and path[j] > 0
                if start is not None and (not inside or kinds[j] != kinds[start] or path[j] % 2 == 1):
                    if low <= s + start < high:
                        found[k].append((int(kinds[start]), s + start, s + j))
                    start = None
                if inside and start is None:
                    start = j
    return [sorted(x, key=lambda y: y[1:]) for x in found]


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, int]]]]:
    """Base spans of each text, and base and added spans by kind and start."""
    out = []
    for text, extra in zip(texts, model_spans(texts, tagger), strict=True):
        base = base_spans(text)
        spans = [(k, s, e) for k, name in enumerate(KINDS) for s, e in base[name]]
        # starts and furthest ends so far of the base: what begins before an end reaches it only through the furthest one
        taken = sorted((s, e) for _, s, e in spans)
        starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        last = 0
        for kind, s, e in extra:
            while s < e and not (text[s].isalnum() or text[s] in "+("):
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            # a whole token, not the middle of a longer one, clear of the base and of the span before
            if (s and text[s - 1].isalnum() and text[s].isalnum()) or (e < len(text) and text[e].isalnum() and text[e - 1].isalnum()):
                continue
            before = bisect.bisect_left(starts, e) - 1
            if s >= last and _holds(kind, text[s:e]) and (before < 0 or reach[before] <= s):
                spans.append((kind, s, e))
                last = e
        out.append((base, sorted(spans)))
    return out


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def _find(parameters: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = parameters
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, total, digest, spans = np.zeros((4, n), np.int64), np.zeros(n, np.int64), [nothing] * n, [""] * n
            for c in range(0, n, 500):
                rows = range(c, min(n, c + 500))
                texts = [batch.column("text")[r].as_py() or "" for r in rows]
                for r, (base, found) in zip(rows, all_spans(texts, tagger), strict=True):
                    own = [(k, s, e) for k, name in enumerate(KINDS) for s, e in base[name]]
                    for k, name in enumerate(KINDS):
                        counts[k, r] = len(base[name])
                    if own:
                        digest[r] = hashlib.sha256(_join(own).encode()).hexdigest()
                    spans[r], total[r] = _join(found), len(found)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(total)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for every document."""
    rows = hash_sample(docs.where("text is not null"), ["doc_id"], CARRIERS, docs.count()).select(F.substring("text", 1, CARRIER_CHARS).alias("t")).collect()  # carriers only: bounded by CARRIERS
    tagger = train([r["t"] for r in rows])
    return docs.select("doc_id", "text").mapInArrow(_find(tagger.p), _DDL)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(table(spark, sf_dir, "documents"))
