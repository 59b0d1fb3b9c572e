"""Operator 9: personal data by patterns and a character-level BiLSTM-CRF.

Base spans (email, ip, card, phone) come from fixed patterns. A bidirectional LSTM over
characters with a CRF on top is trained in numpy on windows around base spans of a bounded
sample, part of them rewritten in other notations of the same kind, and on windows with digits
or the word "at" that are none. It adds spans that the patterns miss. Overlapping windows cover the whole
text; their scores are blended by the distance from the window's edges and decoded by Viterbi.
Added spans must be plausible (digits, parts, check digit, an ``@`` or "at" between signs or blanks)
and are kept only where no base span is.

Plausible spans hold a digit, an ``@`` or such an "at". From each of these the windows are read
outwards until, on both sides, a place is met at which every best path over the whole text is
outside of spans (``sure_outside``). What lies between is decoded with these ends, which
gives the spans of the whole text without reading all of it, however long they are.

Defined cases: a null text counts as empty and has no spans; without training windows only base
spans are found. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
FIT_TEXTS = 20_000
FIT_WINDOWS = 2_000
EPOCHS = 6
HIDDEN = 16
WINDOW, STRIDE, REACH = 96, 48, 40
BATCH = 1_024

GROUP = 1 << 20  # places of texts that are read at once
PLACES = 1 << 18  # places that are decoded at once

ANCHOR = re.compile(r"[0-9@]")
MARK = re.compile(r"[0-9@]|(?<=[(\[{ ])a(?=t[)\]} ])", re.I)  # every plausible span holds one
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")  # from the start of a run of digits only, so linear
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = re.compile(r"@|[(\[{ ]at[)\]} ]", re.I)

Span = tuple[str, int, int]


# --- base spans ----------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[Span]:
    """One attempt per ``@``: the run of local characters before it, but not before the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[Span]:
    for chain in DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for first in range(0, len(parts) - 3, 4):
            four = parts[first : first + 4]
            end = at + sum(map(len, four)) + 3
            if small_parts(four):
                yield "ip", at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    if not ANCHOR.search(text):
        return []
    spans = [*emails(text), *addresses(text)]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans.extend(("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15)
    return spans


def plausible(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        return bool(AT.search(value)) and len(value) >= 6
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and small_parts(parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


# --- the model ------------------------------------------------------------------------------------

# Characters are read as classes: letters without case, all digits alike, each ASCII sign for itself.
OTHER_LETTER, OTHER = 128, 129
CLASSES = 130
_CODES = np.arange(128)
_CODES[ord("A") : ord("Z") + 1] += 32
_CODES[ord("0") : ord("9") + 1] = ord("0")
LABELS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k continues it
FORBIDDEN = -1e4


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 0x00C0, OTHER, np.where(points < 0x2000, OTHER_LETTER, OTHER))
    low = points < 128
    out[low] = _CODES[points[low]]
    return out


def allowed() -> np.ndarray:
    """0 where a label may follow another, FORBIDDEN where a kind would continue without its begin."""
    rule = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        rule[:, 2 + 2 * k] = FORBIDDEN
        rule[1 + 2 * k, 2 + 2 * k] = rule[2 + 2 * k, 2 + 2 * k] = 0
    return rule


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """BiLSTM with CRF; arrays are (time, batch, ...)."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.hidden = hidden
        self.p = {"out": normal(2 * hidden, LABELS), "bias": np.zeros(LABELS, np.float32), "trans": normal(LABELS, LABELS) * 0.1}
        for d in "fb":
            self.p |= {f"in_{d}": normal(CLASSES, 4 * hidden), f"rec_{d}": normal(hidden, 4 * hidden)}
            self.p[f"in_{d}"][:, hidden : 2 * hidden] += 1  # open forget gates

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction, and what its gradient needs."""
        h_, steps = self.hidden, len(x)
        table, rec = self.p[f"in_{d}"], self.p[f"rec_{d}"]
        h = np.zeros((x.shape[1], h_), np.float32)
        c = np.zeros_like(h)
        out, memory = np.empty((steps, x.shape[1], h_), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[t]] + h @ rec
            gates = _sigmoid(z[:, : 3 * h_])
            i, f, o = gates[:, :h_], gates[:, h_ : 2 * h_], gates[:, 2 * h_ :]
            g = np.tanh(z[:, 3 * h_ :])
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                memory.append((t, before, old, i, f, o, g, tc))
        return out, memory

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], 2)
        return both @ self.p["out"] + self.p["bias"]

    def _back(self, x, d, memory, grad_h, grads):
        h_, rec = self.hidden, self.p[f"rec_{d}"]
        dh = np.zeros((x.shape[1], h_), np.float32)
        dc = np.zeros_like(dh)
        grec, gin = np.zeros_like(rec), np.zeros_like(self.p[f"in_{d}"])
        for t, before, old, i, f, o, g, tc in reversed(memory):
            dh = dh + grad_h[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grec += before.T @ dz
            np.add.at(gin, x[t], dz)
            dh, dc = dz @ rec.T, dc * f
        grads[f"rec_{d}"], grads[f"in_{d}"] = grec, gin

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the label paths, and its gradients."""
        steps, n = x.shape
        (hf, mf), (hb, mb) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate([hf, hb], 2)
        e = both @ self.p["out"] + self.p["bias"]
        trans = self.p["trans"] + allowed().astype(np.float32)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans[None], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - total[None, :, None])
        rows = np.arange(n)
        gold = e[0][rows, y[0]].sum()
        dtrans = np.zeros_like(trans)
        for t in range(steps):
            de[t][rows, y[t]] -= 1
            if t:
                pair = alpha[t - 1][:, :, None] + trans[None] + (e[t] + beta[t])[:, None, :] - total[:, None, None]
                dtrans += np.exp(pair).sum(0)
                np.subtract.at(dtrans, (y[t - 1], y[t]), 1)
                gold += e[t][rows, y[t]].sum() + trans[y[t - 1], y[t]].sum()
        grads = {"trans": dtrans, "bias": de.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", both, de)}
        dboth = de @ self.p["out"].T
        self._back(x, "f", mf, dboth[:, :, : self.hidden], grads)
        self._back(x, "b", mb, dboth[:, :, self.hidden :], grads)
        return float(total.sum() - gold) / n, {k: v / n for k, v in grads.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over (examples, time) arrays; returns the mean loss of each epoch."""
        rng, seen, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            losses = []
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                loss, grads = self.loss(x[rows].T, y[rows].T)
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                pace = rate * (0.5 ** (epoch // 2)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    g = (g * min(1.0, 5 / (norm + 1e-9))).astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (pace * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
            seen.append(float(np.mean(losses)))
        return seen

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label paths of (time, batch, label) scores; what lies beyond a length is outside."""
        steps, n, _ = e.shape
        trans = self.p["trans"] + allowed()
        first = np.where(np.arange(LABELS) % 2 == 0, FORBIDDEN, 0.0)
        first[0] = 0
        value, back = e[0] + first, np.zeros((steps, n, LABELS), np.int8)
        for t in range(1, steps):
            scores = value[:, :, None] + trans[None]
            live = (t < lengths)[:, None]
            back[t] = np.where(live, scores.argmax(1), np.arange(LABELS)[None])
            value = np.where(live, scores.max(1) + e[t], value)
        path, rows = np.zeros((steps, n), np.int64), np.arange(n)
        path[-1] = value.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return np.where(np.arange(steps)[:, None] < lengths[None], path, 0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


# --- windows --------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text within REACH of a digit or ``@``, merged where they touch; training windows are taken from them."""
    found: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def label_row(text: str, start: int, spans: list[Span]) -> np.ndarray:
    labels = np.zeros(WINDOW, np.int64)
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        a, b = a - start, b - start
        if a >= 0 and b <= WINDOW and not labels[a:b].any():
            k = KINDS.index(kind)
            labels[a], labels[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    return labels


def other_notation(kind: str, value: str, rng: np.random.Generator) -> str:
    """The same kind of data in a notation that the patterns do not cover."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        name, _, host = value.partition("@")
        if rng.integers(2):  # names without digits as well
            name, host = (re.sub("[0-9]+", "", part).strip(".-") or part for part in (name, host))
        at = (" at ", " at ", "(at)", " [at] ", "@ ")[rng.integers(5)]  # the form most like prose more often
        return name + at + (host if rng.integers(3) == 0 else host.replace(".", (" dot ", "[.]")[rng.integers(2)]))
    if kind == "ip":
        return value.replace(".", ("[.]", " . ", ",")[rng.integers(3)])
    if kind == "card":
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if rng.integers(2) else "  ".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    ten = digits[-10:]
    return (f"({ten[:3]}) {ten[3:6]}-{ten[6:]}", f"{ten[:3]}-{ten[3:6]}-{ten[6:]}", f"{ten[:3]}.{ten[3:6]}.{ten[6:]}", f"00{digits}")[rng.integers(4)]


def examples(text: str, rng: np.random.Generator) -> Iterator[tuple[str, list[Span]]]:
    """Windows for training: (characters, spans within). Half of the spans change their notation, and emails once more."""
    spans = base_spans(text)
    words = [m.start() for m in MARK.finditer(text) if not ANCHOR.match(m.group())]
    if words and rng.integers(4) == 0:
        start = max(0, words[rng.integers(len(words))] - WINDOW // 2)
        yield text[start : start + WINDOW], [(k, x - start, y - start) for k, x, y in spans]
    for kind, x, y in spans:
        if kind == "email":
            new = other_notation(kind, text[x:y], rng)
            yield (text[max(0, x - 36) : x] + new + text[y : y + 36])[:WINDOW], [(kind, min(x, 36), min(x, 36) + len(new))]
    for a, b in regions(text):
        inside = [s for s in spans if a <= s[1] and s[2] <= b]
        if inside and rng.integers(2):
            kind, x, y = inside[rng.integers(len(inside))]
            new = other_notation(kind, text[x:y], rng)
            yield (text[max(0, x - 36) : x] + new + text[y : y + 36])[:WINDOW], [(kind, min(x, 36), min(x, 36) + len(new))]
        else:
            start = max(0, a + int(rng.integers(0, max(1, b - a - WINDOW + 1))))
            yield text[start : start + WINDOW], [(k, x - start, y - start) for k, x, y in inside]


def fit(docs: DataFrame, fit_texts: int = FIT_TEXTS, fit_windows: int = FIT_WINDOWS, epochs: int = EPOCHS) -> Tagger | None:
    """Train on at most ``fit_windows`` windows of about ``fit_texts`` texts chosen by a hash of the id."""
    schema = pa.schema([("place", pa.int64()), ("window", pa.string()), ("labels", pa.binary())])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(0).to_pylist():
                if MARK.search(text):
                    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:7], "little")
                    rng = np.random.default_rng(seed)
                    for window, spans in list(examples(text, rng))[:8]:
                        out[0].append(int(rng.integers(1 << 62)))
                        out[1].append(window)
                        out[2].append(label_row(window, 0, spans).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    share = min(1.0, fit_texts / max(1, docs.count()))
    some = texts.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    windows = some.mapInArrow(sampled, "place long, window string, labels binary").orderBy("place", "window").limit(fit_windows).collect()
    y = np.array([np.frombuffer(r["labels"], np.int8) for r in windows], np.int64).reshape(-1, WINDOW)
    if not y.any():
        return None
    blank = codes(" ")[0]
    x = np.full((len(windows), WINDOW), blank, np.int64)
    for row, r in zip(x, windows):
        row[: len(r["window"])] = codes(r["window"])
    tagger = Tagger()
    tagger.train(x, y, epochs)
    return tagger


def sure_outside(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Whether the middle of each stretch of scores ``e`` (stretch, place, label) is outside of spans in every best path.

    The best ways from each first label to each label of the middle, and from there to each last label, are
    compared: whatever lies around the stretch, the best way between its ends must be outside in the middle.
    """
    step, middle = (trans + allowed()).astype(np.float32), e.shape[1] // 2
    e = e.astype(np.float32)

    def ways(places: list[int], moves: np.ndarray) -> np.ndarray:
        """(stretch, end label, middle label), without the scores of the middle itself."""
        value = np.where(np.eye(LABELS, dtype=bool), e[:, places[0], :, None], np.float32(FORBIDDEN * 10))
        for t in places[1:]:
            value = (value[:, :, :, None] + moves).max(2) + e[:, t, None, :]
        return (value[:, :, :, None] + moves).max(2)

    left = ways(list(range(middle)), step)
    right = ways(list(range(e.shape[1] - 1, middle, -1)), step.T)
    both = left[:, :, None, :] + right[:, None, :, :] + e[:, middle, None, None, :]
    return (both[..., 0] > both[..., 1:].max(3) + 1e-2).all((1, 2))


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of the model in each text that touch no base span."""
    out: list[list[Span]] = []
    start = size = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= GROUP or end == len(texts):
            out.extend(_added(tagger, texts[start:end], base[start:end]))
            start, size = end, 0
    return out


def _added(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    # texts lie one after another in cells of STRIDE places, an empty cell around each; cell c and the next make window c
    marks, first, cells = [], np.zeros(len(texts), np.int64), 1
    for i, (text, own) in enumerate(zip(texts, base)):
        inside = np.zeros(len(text) + 1, np.int8)
        for _, a, b in own:
            inside[a:b] = 1  # what holds these places touches a base span
        found = [m.start() for m in MARK.finditer(text) if not inside[m.start()]]
        first[i] = cells
        if found:
            marks.extend((i, p) for p in found)
            cells += -(-len(text) // STRIDE) + 1
    if not marks:
        return [[] for _ in texts]
    owner = np.array([i for i, _ in marks])
    place = first[owner] * STRIDE + np.array([p for _, p in marks])
    sizes = np.array([len(text) for text in texts])
    count = -(-sizes // STRIDE)
    cell_text = np.full(cells, -1)
    for i in np.unique(owner):
        cell_text[first[i] : first[i] + count[i]] = i
    trans = tagger.p["trans"].astype(np.float64)
    row = np.full(cells, -1)  # a cell's row in e
    row[cell_text < 0] = 0
    e, used, step = np.zeros((len(marks) + 2, STRIDE, LABELS)), 1, 1
    windows: dict[int, np.ndarray] = {}
    state = np.zeros((cells, STRIDE), np.int8)  # 0 not known, 1 surely outside, 2 perhaps in a span
    state[cell_text < 0] = 1
    for i in np.unique(owner):
        state[first[i] : first[i] + count[i]].reshape(-1)[len(texts[i]) :] = 1
    low, high = first[owner] * STRIDE, first[owner] * STRIDE + sizes[owner]
    wanted = np.unique(np.concatenate([np.maximum(low, place - STRIDE), np.minimum(high - 1, place + STRIDE), place]) // STRIDE)
    runs: set[tuple[int, int, int]] = set()
    waiting = np.arange(len(place))
    while len(waiting):
        new = wanted[row[wanted] < 0]
        while used + len(new) > len(e):
            e = np.concatenate([e, np.zeros_like(e)])
        row[new] = np.arange(used, used + len(new))
        e[row[new]] = _cells(tagger, texts, new, cell_text, first, count, windows)
        used += len(new)
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            state[part] = np.where(state[part] == 1, 1, 2)
            sure = sure_outside(e[row[part]], trans) & ((part - first[cell_text[part]] + 1) * STRIDE <= sizes[cell_text[part]])
            state[part[sure], STRIDE // 2] = 1
        flat = state.reshape(-1)
        stops = np.flatnonzero(flat != 2)
        right = stops[np.searchsorted(stops, place[waiting])]
        left = stops[np.searchsorted(stops, place[waiting], "right") - 1]
        closed = (flat[left] == 1) & (flat[right] == 1)
        for m, a, b in zip(waiting[closed].tolist(), left[closed].tolist(), right[closed].tolist()):
            if b > a:  # else the mark itself is outside
                runs.add((int(owner[m]), a + 1, b))
        # read on, ever further at once
        before, after = left[flat[left] == 0] // STRIDE, right[flat[right] == 0] // STRIDE
        spread = np.arange(step)
        wanted = np.unique(np.concatenate([c[:, None] + way * spread for c, way in ((before, -1), (after, 1))], None))
        wanted = wanted[(wanted > 0) & (wanted < cells)]
        wanted = wanted[cell_text[wanted] >= 0]
        step *= 2
        waiting = waiting[~closed]
    found: list[list[Span]] = [[] for _ in texts]
    todo = sorted(runs, key=lambda r: r[2] - r[1])
    while todo:
        longest = todo[-1][2] - todo[-1][1] + 2
        part = todo[-max(1, min(BATCH, PLACES // longest)) :]
        del todo[-len(part) :]
        scores = np.zeros((longest, len(part), LABELS))
        lengths, starts = np.zeros(len(part), np.int64), []
        for j, (i, a, b) in enumerate(part):
            # the places beside a run are outside, unless the text begins or ends there
            a, b = max(a - 1, first[i] * STRIDE), min(b + 1, first[i] * STRIDE + len(texts[i]))
            at = np.arange(a, b)
            scores[: b - a, j] = e[row[at // STRIDE], at % STRIDE]
            for edge in (a, b - 1):
                if flat[edge] == 1:
                    scores[edge - a, j, 1:] += FORBIDDEN
            lengths[j] = b - a
            starts.append(a - first[i] * STRIDE)
        path = tagger.decode(scores, lengths)
        for j in np.flatnonzero(path.any(0)):
            found[part[j][0]].extend(_spans_of(path[:, j], starts[j]))
    out = []
    for text, spans, own in zip(texts, found, base):
        taken = sorted((a, b) for _, a, b in own)
        keep = []
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            value = text[a:b]
            a, b = a + len(value) - len(value.lstrip()), b - len(value) + len(value.rstrip())
            if plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
                keep.append((kind, int(a), int(b)))
        out.append(keep)
    return out


def _cells(tagger: Tagger, texts: list[str], new: np.ndarray, cell_text: np.ndarray, first: np.ndarray, count: np.ndarray, windows: dict) -> np.ndarray:
    """Scores of the cells ``new``: those of the windows over them, blended by the distance from the windows' edges."""
    over = {}
    for c in new.tolist():
        i = cell_text[c]
        over[c] = [w for w in (c - 1, c) if first[i] <= w <= first[i] + max(0, count[i] - 2)]
    missing = sorted({w for ws in over.values() for w in ws}.difference(windows))
    blank = codes(" ")[0]
    for at in range(0, len(missing), BATCH):
        part = missing[at : at + BATCH]
        x = np.full((len(part), WINDOW), blank, np.int64)
        for line, w in zip(x, part):
            i = cell_text[w]
            piece = texts[i][(w - first[i]) * STRIDE : (w - first[i]) * STRIDE + WINDOW]
            line[: len(piece)] = codes(piece)
        e = tagger.emissions(x.T)
        windows.update((w, e[:, j]) for j, w in enumerate(part))
    centre = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    out = np.zeros((len(new), STRIDE, LABELS))
    for k, c in enumerate(new.tolist()):
        weight = np.zeros((STRIDE, 1))
        for w in over[c]:
            half = slice(0, STRIDE) if w == c else slice(STRIDE, WINDOW)
            out[k] += windows[w][half] * centre[half, None]
            weight += centre[half, None]
        out[k] /= weight
    return out


def _spans_of(path: np.ndarray, base: int) -> Iterator[Span]:
    start = 0
    for t in np.flatnonzero(path):
        if t >= start and path[t] % 2:
            kind, end = (path[t] - 1) // 2, t + 1
            while end < len(path) and path[end] == path[t] + 1:
                end += 1
            yield KINDS[kind], base + int(t), base + int(end)
            start = end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


_FOUND = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)


def personal_data(docs: DataFrame, fit_texts: int = FIT_TEXTS, fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """Per document: counts and digest of its base spans, and all spans, n_added of them by the model."""
    tagger = fit(docs, fit_texts, fit_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, base) if tagger else [[] for _ in texts]
            rows = [batch.column(0)]
            rows += [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            rows.append(pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]))
            rows.append(pa.array([joined(a + b) for a, b in zip(base, more)]))
            rows.append(pa.array([len(b) for b in more], pa.int64()))
            yield pa.RecordBatch.from_arrays(rows, schema=_FOUND)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return texts.mapInArrow(run, schema)
