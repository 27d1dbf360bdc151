"""Personal data by patterns and a character tagger.

Patterns find emails, IP addresses, card and phone numbers. Around every digit or at-sign a bidirectional LSTM with CRF
transitions reads the characters in overlapping windows; the windows' emission scores are averaged where they overlap,
weighted towards a window's middle, and one Viterbi pass per stretch of text reconciles them. What the tagger finds
beyond the patterns is added, if its lead over leaving the characters untagged exceeds a margin that is set on windows
kept from training. Every kind of span needs a digit or an at-sign, so text without them needs no window.

The tagger is trained in numpy on a bounded sample: the spans that the patterns find in about ``train_docs`` documents,
some of the phone numbers without their plus sign, and stretches with digits that hold no span.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated rows get equal
results; a document of any length is searched whole; where the sample holds too few spans to train on, the patterns
alone decide. Columns other than the text pass through unread.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.llm.quality import pick
from arbolex.llm.words import tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

# Fixed patterns of the contract; emails are anchored at the at-sign, the others at the start of a run.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TRIGGERS = re.compile(r"[0-9@](?:.{0,64}?[0-9@])*", re.DOTALL)


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last, 0))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and non-overlapping for each kind, by start and kind."""
    found = emails(text) if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# -- the tagger -------------------------------------------------------------------------------------------------------

#: window and step in code points, context around a trigger, labels (outside, then first and inner of each kind)
WINDOW, STEP, CONTEXT, LABELS = 64, 32, 24, 1 + 2 * len(KINDS)
EMBED, HIDDEN = 8, 12
MARKS = " .,;:@+-()%_/\n#*$&!?|=\"'"
CLASSES = 5 + len(MARKS)


def char_classes(text: str) -> np.ndarray:
    """Digit, lower and upper case letter, each mark of its own, other characters; 0 is padding."""
    table = _class_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(points, 127)]


def _class_table() -> np.ndarray:
    table = np.full(128, CLASSES - 1, np.int64)
    table[48:58], table[97:123], table[65:91] = 1, 2, 3
    for k, mark in enumerate(MARKS):
        table[ord(mark)] = 4 + k
    return table


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights of the network; both directions of the LSTM are the two layers of one array."""

    w: dict[str, np.ndarray]
    margin: float = np.inf

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
        return cls({
            "embed": rng.normal(0, 0.5, (CLASSES, EMBED)), "in": draw(2, EMBED, 4 * HIDDEN), "rec": draw(2, HIDDEN, 4 * HIDDEN),
            "bias": np.zeros((2, 1, 4 * HIDDEN)), "out": draw(2 * HIDDEN, LABELS), "out_bias": np.zeros(LABELS),
            "trans": np.zeros((LABELS, LABELS)),
        })

    def states(self, x: np.ndarray):
        """Run both directions over (windows, time) classes; returns hidden states and what the way back needs."""
        w, (n, steps) = self.w, x.shape
        both = np.stack([w["embed"][x], w["embed"][x[:, ::-1]]])
        gates_in = np.einsum("dnte,deh->tdnh", both, w["in"], optimize=True) + w["bias"]
        h, c, kept = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN)), []
        for t in range(steps):
            gates = gates_in[t] + h @ w["rec"]
            ifo = sigmoid(gates[..., : 3 * HIDDEN])
            i, f, o = ifo[..., :HIDDEN], ifo[..., HIDDEN : 2 * HIDDEN], ifo[..., 2 * HIDDEN :]
            g = np.tanh(gates[..., 3 * HIDDEN :])
            kept.append((h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            kept[-1] += (c, h)
        hidden = np.stack([k[-1] for k in kept], 2)  # direction, window, time, unit
        return np.concatenate([hidden[0], hidden[1][:, ::-1]], -1), kept, both

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.states(x)[0] @ self.w["out"] + self.w["out_bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF loss of the windows and its derivative by every weight."""
        w, (n, steps) = self.w, x.shape
        hidden, kept, both = self.states(x)
        e, trans = hidden @ w["out"] + w["out_bias"], w["trans"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = lse(alpha[:, -1], 1)
        rows, times = np.arange(n)[:, None], np.arange(steps)
        gold = e[rows, times, y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - total[:, None, None])
        de[rows, times, y] -= 1
        pair = alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - total[:, None, None, None]
        dtrans = np.exp(pair).sum((0, 1))
        np.add.at(dtrans, (y[:, :-1], y[:, 1:]), -1)
        grad = {"out": np.einsum("nth,ntl->hl", hidden, de, optimize=True), "out_bias": de.sum((0, 1)), "trans": dtrans}
        dh_all = de @ w["out"].T
        dh_all = np.stack([dh_all[..., :HIDDEN], dh_all[:, ::-1, HIDDEN:]])
        dh, dc = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
        drec, dgates = np.zeros_like(w["rec"]), np.zeros((steps, 2, n, 4 * HIDDEN))
        for t in range(steps - 1, -1, -1):
            h0, c0, i, f, o, g, c, _ = kept[t]
            dh = dh + dh_all[:, :, t]
            th = np.tanh(c)
            dc = dc + dh * o * (1 - th * th)
            dgates[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], -1)
            drec += h0.transpose(0, 2, 1) @ dgates[t]
            dh, dc = dgates[t] @ w["rec"].transpose(0, 2, 1), dc * f
        grad |= {"rec": drec, "bias": dgates.sum((0, 2))[:, None], "in": np.einsum("dnte,tdnh->deh", both, dgates, optimize=True)}
        dx = np.einsum("tdnh,deh->dnte", dgates, w["in"], optimize=True)
        grad["embed"] = np.zeros_like(w["embed"])
        np.add.at(grad["embed"], x, dx[0] + dx[1][:, ::-1])
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Best label path of each padded row of emissions; spans as (start, end, kind, lead over no span)."""
        trans, (n, steps, _) = self.w["trans"], e.shape
        best, back = e[:, 0].copy(), np.zeros((n, steps, LABELS), np.int8)
        finals = np.zeros((n, LABELS))
        for t in range(1, steps):
            ended = lengths == t
            finals[ended] = best[ended]
            ways = best[:, :, None] + trans
            back[:, t] = ways.argmax(1)
            best = ways.max(1) + e[:, t]
        finals[lengths == steps] = best[lengths == steps]
        out = []
        for row, length in enumerate(lengths):
            path = np.zeros(length, np.int64)
            path[-1] = finals[row].argmax()
            for t in range(length - 1, 0, -1):
                path[t - 1] = back[row, t, path[t]]
            own, starts = e[row, :length], np.flatnonzero((path % 2 == 1) | ((path > 0) & (np.diff(path, prepend=0) != 0) & (path % 2 == 0) & (np.append(0, path[:-1]) != path - 1)))
            spans = []
            for start in starts:
                kind, end = (path[start] - 1) // 2, start + 1
                while end < length and path[end] == 2 + 2 * kind:
                    end += 1
                part = path[start:end]
                lead = own[np.arange(start, end), part].sum() - own[start:end, 0].sum() + trans[part[:-1], part[1:]].sum() - (end - start - 1) * trans[0, 0]
                if start:
                    lead += trans[path[start - 1], part[0]] - trans[path[start - 1], 0]
                if end < length:
                    lead += trans[part[-1], path[end]] - trans[0, path[end]]
                spans.append((int(start), int(end), int(kind), float(lead)))
            out.append(spans)
        return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Where windows are needed: around runs of digits and at-signs that are near one another."""
    out: list[tuple[int, int]] = []
    for m in TRIGGERS.finditer(text):
        lo, hi = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def tag(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Spans (start, end, kind, lead) of every text: overlapping windows, merged and decoded stretch by stretch."""
    places, windows, index = [], [], []
    for k, text in enumerate(texts):
        found = stretches(text)
        if not found:
            continue
        classes = char_classes(text)
        for lo, hi in found:
            for at in range(lo, max(lo + 1, hi - STEP), STEP):
                window = np.zeros(WINDOW, np.int64)
                part = classes[at : min(at + WINDOW, hi)]
                window[: len(part)] = part
                windows.append(window)
                index.append((len(places), at - lo, len(part)))
            places.append((k, lo, hi))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not places:
        return out
    shape = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])[:, None]
    sums = [np.zeros((hi - lo, LABELS)) for _, lo, hi in places]
    weight = [np.zeros((hi - lo, 1)) for _, lo, hi in places]
    for lo in range(0, len(windows), 512):
        scores = tagger.emissions(np.stack(windows[lo : lo + 512])) * shape
        for (place, at, size), score in zip(index[lo : lo + 512], scores, strict=True):
            sums[place][at : at + size] += score[:size]
            weight[place][at : at + size] += shape[:size]
    order = sorted(range(len(places)), key=lambda p: len(sums[p]))
    for lo in range(0, len(order), 128):
        some = order[lo : lo + 128]
        lengths = np.array([len(sums[p]) for p in some])
        padded = np.zeros((len(some), int(lengths.max()), LABELS))
        for row, p in enumerate(some):
            padded[row, : lengths[row]] = sums[p] / weight[p]
        for p, spans in zip(some, tagger.decode(padded, lengths), strict=True):
            k, start, _ = places[p]
            out[k] += [(start + a, start + b, kind, lead) for a, b, kind, lead in spans]
    return out


def plausible(piece: str, kind: int) -> bool:
    """A span holds what its kind cannot be without."""
    digits = len(DIGITS.findall(piece))
    return ("@" in piece, digits >= 4 and piece.count(".") == 3, digits >= 14, digits >= 7)[kind]


def added(text: str, base: list[Span], tagged: list[tuple[int, int, int, float]], margin: float) -> list[Span]:
    """Tagged spans of enough lead that touch no span of the patterns, without white space at their ends."""
    out = []
    for start, end, kind, lead in sorted(tagged):
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if lead > margin and plausible(text[start:end], kind) and all(end <= a or b <= start for a, b, _ in base):
            out.append((start, end, kind))
    return out


def training_windows(text: str) -> list[tuple[str, str]]:
    """(characters, label of each as a digit) around the patterns' spans, and where digits are no span."""
    spans, out = base_spans(text), []
    for lo, hi in stretches(text):
        inside = [s for s in spans if lo <= s[0] and s[1] <= hi]
        clear = [s for k, s in enumerate(inside) if all(s[1] <= o[0] or o[1] <= s[0] for o in inside[:k])]
        labels = np.zeros(hi - lo, np.int64)
        for a, b, kind in clear:
            labels[a - lo : b - lo] = 2 + 2 * kind
            labels[a - lo] = 1 + 2 * kind
        centres = [(a + b) // 2 for a, b, _ in clear] or [(lo + hi) // 2]
        for c in centres:
            at = max(lo, min(c - WINDOW // 2 + (c * 7) % 17 - 8, hi - WINDOW))
            piece = labels[at - lo : at - lo + WINDOW]
            if len(piece) and (piece[0] == 0 or piece[0] % 2):
                out.append((text[at : min(at + WINDOW, hi)], "".join(map(str, piece))))
                plus = next((a - at for a, b, k in clear if k == 3 and at <= a < at + WINDOW), None)
                if plus is not None and c % 2:  # a number without its plus sign is a number still
                    chars, codes = out[-1]
                    out.append((chars[:plus] + chars[plus + 1 :], codes[:plus] + "7" + codes[plus + 2 :]))
    return out


def train(windows: list[tuple[str, str]], steps: int = 150, batch: int = 48, seed: int = 5) -> Tagger | None:
    """Fit the network by Adam on four fifths of the windows; set the margin on the rest."""
    spans = sum(any(c in "1357" for c in codes) for _, codes in windows)
    if spans < 40:
        return None
    x, y = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for k, (chars, codes) in enumerate(windows):
        x[k, : len(chars)] = char_classes(chars)
        y[k, : len(codes)] = [int(c) for c in codes]
    rng, kept = np.random.default_rng(seed), np.arange(len(x)) % 5 == 0
    tagger, pool = Tagger.fresh(), np.flatnonzero(~kept)
    first, second = ({k: np.zeros_like(v) for k, v in tagger.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = rng.choice(pool, min(batch, len(pool)), replace=False)
        _, grad = tagger.gradients(x[some], y[some])
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, g in grad.items():
            g = np.clip(g, -1, 1)
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            tagger.w[name] -= rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    held = np.flatnonzero(kept)
    lengths = np.array([max(1, len(windows[k][0])) for k in held])
    wrong = [0.0]
    for k, spans_found in zip(held, tagger.decode(tagger.emissions(x[held]), lengths), strict=True):
        for a, b, kind, lead in spans_found:
            if not (y[k, a:b] > 0).any() and plausible(windows[k][0][a:b], kind):
                wrong.append(lead)
    # above every lead that a false find had among the windows kept
    tagger.margin = max(wrong) + 5.0
    return tagger


def fit_tagger(documents: DataFrame, train_docs: int = 3000, per_text: int = 20) -> Tagger | None:
    """Train on about ``train_docs`` documents with a digit or at-sign, picked by a hash of the text, and ``per_text`` windows
    of each at most; at most twice as many windows as documents reach the driver."""
    texts = documents.select("text").where(F.col("text").rlike("[0-9@]"))

    def cut(batches):
        for batch in batches:
            rows = [w for t in batch.column("text").to_pylist() for w in training_windows(t)[:per_text]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["chars", "codes"]
            )

    sample = pick(texts, train_docs, texts.count(), F.col("text")).mapInArrow(cut, "chars string, codes string")
    rows = sample.orderBy(F.xxhash64("chars", "codes"), "chars", "codes").limit(2 * train_docs).collect()
    return train([(r.chars, r.codes) for r in rows])


FOUND_TYPE = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, clean string"


def personal_data(text: Column, tagger: Tagger | None, redact: bool = False) -> Column:
    """Struct of the pattern counts, the digest of the pattern spans, all spans and, if asked for, the redacted text."""

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        held = texts.to_pylist()
        for lo in range(0, len(held), 256):
            part = [t or "" for t in held[lo : lo + 256]]
            tagged = tag(tagger, part) if tagger else [[] for _ in part]
            for raw, t, more in zip(held[lo : lo + 256], part, tagged, strict=True):
                base = base_spans(t)
                extra = added(t, base, more, tagger.margin) if tagger else []
                spans = sorted(base + extra, key=lambda s: (s[0], s[2], s[1]))
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                counts = [sum(s[2] == k for s in base) for k in range(4)]
                rows.append((*counts, digest, joined(spans), len(extra), redacted(raw, spans) if redact else None))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        names = [f.split(" ")[0] for f in FOUND_TYPE.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return F.arrow_udf(tidy(run), FOUND_TYPE).asNondeterministic()(text)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    if not spans:
        return text
    out, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            out.append(text[last:start] + f"<{KINDS[kind].upper()}>")
        last = max(last, end)
    return "".join(out) + text[last:]


def find_personal_data(documents: DataFrame, train_docs: int = 3000) -> DataFrame:
    """doc_id, counts and digest of the pattern spans, and all spans of every document."""
    tagger = fit_tagger(documents, train_docs)
    rows = documents.select("doc_id", personal_data(F.col("text"), tagger).alias("f"))
    return rows.select("doc_id", *[f"f.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")])
