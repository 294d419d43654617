"""Personal data: exact patterns, and a character-level BiLSTM-CRF for forms that the patterns miss.

The patterns' spans (the base) always stay. The tagger is a bidirectional LSTM over characters with linear-chain CRF
transitions, trained here in numpy from labelled spans that a seeded generator writes: mail addresses with spelt-out
signs, numbers of telephones without the plus sign, addresses and cards with other separators, among prose and
look-alikes. A text is read in overlapping windows; each is decoded by Viterbi, and the windows' spans are reconciled
over the whole text: a span counts where its window sees it farthest from an edge, touching spans of a kind from two
windows merge, and a span that overlaps a base span or an earlier added one is dropped.

Every window of every text is read. A window in which no stretch of tags can be better than staying outside, by an upper
bound of the stretches, has no span and needs no Viterbi.

Defined cases: a null text is an empty one without spans; texts are read whole; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.shared import mapped, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Window of characters in which texts are read, the step from one to the next, and the window of the training.
WINDOW, STEP, LEARNT = 256, 224, 80
#: Least number of digits that an added span of a kind has (a mail address: none).
LEAST_DIGITS = (0, 4, 15, 8)

# --- the base ------------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the patterns, by kind and then start."""
    out = [(0, *x) for x in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


# --- the tagger ----------------------------------------------------------------------------------------------------

#: Tags: 0 outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
#: Characters by class: printable ASCII on its own, one class for other letters, one for the rest, one for padding.
CLASSES, OTHER_LETTER, OTHER, PADDING = 98, 95, 96, 97
#: A mail address by its signs, in every spelling of the labelled forms.
_SPELT = re.compile(r"[^\s@]+(?:\s?@\s?|\s?[\[(]at[\])]\s?|\sat\s)[^\s@]+?(?:(?:\.|\s\.\s|\s?[\[(]dot[\])]\s?|\sdot\s)[^\s@.]+)+", re.IGNORECASE)
HIDDEN, EMBED = 10, 8
#: Labelled windows that the tagger is fitted on.
TRAINED = 8000
#: Windows read at once.
BLOCK = 512


def classes_of(text: str) -> np.ndarray:
    """Class of each character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(code < 0xC0, OTHER, OTHER_LETTER).astype(np.int16)
    ascii_ = (code >= 32) & (code < 127)
    out[ascii_] = (code[ascii_] - 32).astype(np.int16)
    out[(code >= 9) & (code <= 13)] = 0
    return out


def labelled_windows(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows of generated text with a tag for each character; ``n`` bounds the training."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ["an", "er", "the", "in", "on", "ti", "re", "ed", "nd", "ha", "at", "en", "es", "of", "or", "it", "is", "he", "to", "ou", "ea", "ung", "sch", "que", "é", "ä", "os"]
    letters, vowels = [*"bcdfghjklmnpqrstvwxyz"], [*"aeiouy"]
    sound = lambda: pick(syllables) if rng.random() < 0.5 else pick(letters) + pick(vowels) + pick(["", pick(letters)])
    word = lambda: "".join(sound() for _ in range(rng.integers(1, 4)))

    def mail() -> str:
        at, dot = pick(["@", " at ", "[at]", " [at] ", "(at)", " (at) ", " @ "]), pick([".", " dot ", "[dot]", "(dot)", " . "])
        return word() + pick(["", ".", "_"]) + word() + pick(["", digits(2)]) + at + word() + dot + pick(["com", "org", "net", "example", "info"])

    def ip() -> str:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return pick([".", "[.]", "(.)", " . "]).join(parts)

    def card() -> str:
        body = digits(15)
        number = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        return pick(["", " ", "-", ".", "  "]).join(number[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        gap = pick([" ", "-", ".", "/"])
        return pick(["+", "00", "", ""]) + pick([f"({digits(3)}) {digits(3)}-{digits(4)}", gap.join([digits(3), digits(3), digits(4)]), gap.join([digits(2), digits(3), digits(3), digits(2)])])

    def decoy() -> str:
        return pick([lambda: digits(rng.integers(1, 8)), lambda: f"{digits(1)}.{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"({word()})", lambda: f"[{digits(2)}]", lambda: f"{word()}@", lambda: f"{word()} at {word()}", lambda: f"{word()} dot {word()}", lambda: "v" + digits(1) + "." + digits(1), lambda: f"${digits(3)},{digits(3)}", lambda: "".join(pick([*"0123456789abcdef"]) for _ in range(32))])()

    x, y = np.full((n, LEARNT), PADDING, np.int16), np.zeros((n, LEARNT), np.int8)
    makers = (mail, ip, card, phone)
    for row in range(n):
        text, tags, kinds = "", [], pick([14, 14, 100])  # every third window is nearly plain prose
        while len(text) < LEARNT + 40:
            kind = rng.integers(0, kinds)
            piece = makers[kind]() if kind < 4 else decoy() if kind < 7 else word().capitalize() if kind % 7 == 0 else word()
            tags += ([1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if kind < 4 else [0] * len(piece)) + [0]
            gap = pick([" ", " ", " ", ", ", ". "])
            tags += [0] * (len(gap) - 1)
            text += piece + gap
        cut = rng.integers(0, 40)
        x[row], y[row] = classes_of(text)[cut : cut + LEARNT], tags[cut : cut + LEARNT]
    return x, y


class Tagger:
    """BiLSTM-CRF with forward and backward passes written out; ``weights`` is a dict of float32 arrays.

    Gates are hard sigmoids, x + 1/2 held between 0 and 1; cells take x / (1 + |x|) for the hyperbolic tangent. Both are
    a few cheap operations on whole arrays, where exponentials would be most of the reading.
    """

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        w = {"embed": scale(CLASSES, EMBED) * 3}
        # the two directions lie side by side, so that a step takes both
        w |= {"in": np.stack([scale(EMBED, 4 * HIDDEN) for _ in "fb"]), "re": np.stack([scale(HIDDEN, 4 * HIDDEN) for _ in "fb"]), "bias": np.zeros((2, 4 * HIDDEN), np.float32)}
        w["bias"][:, HIDDEN : 2 * HIDDEN] = 0.4
        w |= {"out": scale(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        return cls(w)

    def _lstm(self, x: np.ndarray):
        """x: (time, direction, rows) of classes, in reading order. States, and what the backward pass needs."""
        w, h = self.w, HIDDEN
        gates_in = (w["embed"] @ w["in"] + w["bias"][:, None]).reshape(2 * CLASSES, 4 * h)
        place = x.astype(np.int64) + np.array([[0], [CLASSES]])
        n = x.shape[2]
        s, c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, tape = np.empty((len(x), 2, n, h), np.float32), []
        for t in range(len(x)):
            z = gates_in[place[t]]
            z += s @ w["re"]
            i_f_o = np.clip(z[:, :, : 3 * h] + np.float32(0.5), 0, 1)
            open_ = ((i_f_o > 0) & (i_f_o < 1)).astype(np.float32)
            flat = 1 / (1 + np.abs(z[:, :, 3 * h :]))
            g = z[:, :, 3 * h :] * flat
            i, f, o = i_f_o[:, :, :h], i_f_o[:, :, h : 2 * h], i_f_o[:, :, 2 * h :]
            last_c, last_s = c, s
            c = f * c + i * g
            flat_c = 1 / (1 + np.abs(c))
            tc = c * flat_c
            s = states[t] = o * tc
            tape.append((i, f, o, g, tc, last_c, last_s, open_, flat, flat_c))
        return states, tape

    def _states(self, x: np.ndarray, d: int) -> np.ndarray:
        """The states of ``_lstm`` as (time, feature, row): gates lie apart in memory taken once.

        One product a step takes the last state, the character and the bias.
        """
        w, h = self.w, HIDDEN
        half = np.array([0.5] * (3 * h) + [0] * h, np.float32)
        all_in = np.ascontiguousarray(np.concatenate([w["re"][d], w["in"][d], (w["bias"][d] + half)[None]]).T)
        letters = np.ascontiguousarray(w["embed"].T)
        n = x.shape[1]
        fed, z = np.ones((h + EMBED + 1, n), np.float32), np.empty((4 * h, n), np.float32)
        states, c, a = np.empty((len(x), h, n), np.float32), np.zeros((h, n), np.float32), np.empty((h, n), np.float32)
        fed[:h] = 0
        gates, g = z[: 3 * h], z[3 * h :]
        i, f, o = (z[k * h : (k + 1) * h] for k in range(3))
        for t in range(len(x)):
            np.take(letters, x[t], 1, out=fed[h : h + EMBED], mode="clip")
            np.matmul(all_in, fed, out=z)
            np.minimum(np.maximum(gates, 0, out=gates), 1, out=gates)
            np.abs(g, out=a)
            a += 1
            g /= a
            c *= f
            g *= i
            c += g
            np.abs(c, out=a)
            a += 1
            np.divide(c, a, out=a)
            fed[:h] = np.multiply(o, a, out=states[t])
        return states

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Emission scores (time, tag, row) of windows (rows, time), without what the backward pass needs."""
        xt = np.ascontiguousarray(x.T)
        out = np.ascontiguousarray(self.w["out"].T)
        emit = np.matmul(out[:, :HIDDEN], self._states(xt, 0))
        emit += np.matmul(out[:, HIDDEN:], self._states(xt[::-1], 1))[::-1]
        emit += self.w["out_bias"][:, None]
        return emit

    def scores(self, x: np.ndarray):
        """Emission scores (time, row, tag) of windows (rows, time), and what the backward pass needs."""
        xs = np.stack([x.T, x.T[::-1]], 1)
        states, tape = self._lstm(xs)
        both = np.concatenate([states[:, 0], states[::-1, 1]], 2)
        return both @ self.w["out"] + self.w["out_bias"], (both, tape, xs)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """Best tags (rows, time)."""
        tags, rows, kept = np.zeros(x.shape, np.int8), [], []
        for at in range(0, len(x), BLOCK):
            emit = self.emissions(x[at : at + BLOCK])
            more = np.flatnonzero(self._can_leave(emit))
            rows.append(more + at), kept.append(emit[:, :, more])
        more = np.concatenate(rows)
        emits = np.concatenate(kept, 2)
        for at in range(0, len(more), BLOCK):
            tags[more[at : at + BLOCK]] = self._best_paths(np.ascontiguousarray(emits[:, :, at : at + BLOCK]))
        return tags

    def _can_leave(self, emit: np.ndarray) -> np.ndarray:
        """Rows in which a stretch of other tags may be better than staying outside; false only where none can be.

        Bounds each stretch from above by its best tag at every step, whatever that tag follows, its first move and its last.
        """
        gain = self.w["move"] - self.w["move"][0, 0]
        above = emit[:, 1:] - emit[:, :1]
        begin, go_on = (above + gain[0, 1:, None]).max(1), (above + gain[1:, 1:].max(0)[:, None]).max(1)
        leave = gain[1:, 0].max()
        run = above[0].max(0)
        best = run + leave
        for t in range(1, len(emit)):
            run += go_on[t]
            np.maximum(run, begin[t], out=run)
            np.maximum(best, run + leave, out=best)
        return np.maximum(best, run) >= -1e-3

    def _best_paths(self, emit: np.ndarray) -> np.ndarray:
        move = self.w["move"][:, :, None]
        best = np.empty_like(emit)
        best[0] = emit[0]
        total = np.empty(emit.shape[1:], np.float32)
        for t in range(1, len(emit)):
            into = best[t]
            np.add(best[t - 1][0], move[0], out=into)
            for k in range(1, TAGS):
                np.maximum(into, np.add(best[t - 1][k], move[k], out=total), out=into)
            into += emit[t]
        tags = np.empty((len(emit), emit.shape[2]), np.int8)
        tags[-1] = best[-1].argmax(0)
        for t in range(len(emit) - 1, 0, -1):
            tags[t - 1] = (best[t - 1] + self.w["move"][:, tags[t]]).argmax(0)
        return tags.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a character, and its gradients."""
        emit, (both, tape, xs) = self.scores(x)
        steps, n, _ = emit.shape
        move, yt, rows = self.w["move"], y.T.astype(np.int64), np.arange(n)
        # forward and backward sums of the chain, each step scaled to one
        peak, top = emit.max(2, keepdims=True), move.max()
        near, go = np.exp(emit - peak), np.exp(move - top)
        alpha, beta, total = np.empty_like(emit), np.ones_like(emit), np.empty((steps, n, 1), np.float32)
        for t in range(steps):
            alpha[t] = (alpha[t - 1] @ go) * near[t] if t else near[0]
            total[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= total[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (beta[t + 1] * near[t + 1] / total[t + 1]) @ go.T
        log_z = np.log(total).sum((0, 2)) + peak.sum((0, 2)) + (steps - 1) * top
        gold = emit[np.arange(steps)[:, None], rows, yt].sum(0) + move[yt[:-1], yt[1:]].sum(0)
        scale = 1.0 / (n * steps)
        d_emit = alpha * beta
        d_emit[np.arange(steps)[:, None], rows, yt] -= 1
        d_emit *= scale
        d_move = go * (alpha[:-1].reshape(-1, TAGS).T @ (near * beta / total)[1:].reshape(-1, TAGS))
        np.add.at(d_move, (yt[:-1].ravel(), yt[1:].ravel()), -1)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["move"] = d_move * scale
        g["out"], g["out_bias"] = both.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS), d_emit.sum((0, 1))
        d_both = d_emit @ self.w["out"].T
        ds = np.stack([d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]], 1)
        dz, last = np.empty((steps, 2, n, 4 * HIDDEN), np.float32), np.stack([x[6] for x in tape])
        ds_next, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        back = np.ascontiguousarray(self.w["re"].transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            i, f, o, gg, tc, last_c, _, open_, flat, flat_c = tape[t]
            s_bar = ds[t] + ds_next
            dc = dc + s_bar * o * flat_c * flat_c
            np.concatenate([dc * gg, dc * last_c, s_bar * tc, dc * i * flat * flat], 2, out=dz[t])
            dz[t, :, :, : 3 * HIDDEN] *= open_
            ds_next, dc = dz[t] @ back, dc * f
        for d in range(2):
            own = dz[:, d].reshape(-1, 4 * HIDDEN)
            d_gates_in = (xs[:, d].reshape(-1, 1) == np.arange(CLASSES)).astype(np.float32).T @ own
            g["re"][d] = last[:, d].reshape(-1, HIDDEN).T @ own
            g["bias"][d] = d_gates_in.sum(0)
            g["in"][d] = self.w["embed"].T @ d_gates_in
            g["embed"] += d_gates_in @ self.w["in"][d].T
        return float((log_z - gold).sum() * scale), g


def train(windows: int = TRAINED, epochs: int = 14, seed: int = 5, batch: int = 96, rate: float = 0.03) -> Tagger:
    """Fit by Adam on ``windows`` labelled windows; the same arguments give the same weights."""
    x, y = labelled_windows(windows)
    model, rng = Tagger.fresh(seed), np.random.default_rng(seed)
    m, v, step = {k: 0.0 for k in model.w}, {k: 0.0 for k in model.w}, 0
    total = epochs * (windows // batch)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for at in range(0, windows - batch + 1, batch):
            _, g = model.gradients(x[order[at : at + batch]], y[order[at : at + batch]])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            now = rate * min(1.0, step / 20) * (1 - 0.95 * step / total)
            for k, a in g.items():
                a = a * min(1.0, 1.0 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                model.w[k] = (model.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _runs(tags: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(kind, start, stop) of the tagged runs in each window (rows, time); a run goes on over its kind's second tag."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in tags]
    kind = (tags - 1) // 2
    goes_on = np.zeros(tags.shape, bool)
    goes_on[:, 1:] = (tags[:, 1:] > 0) & (tags[:, 1:] % 2 == 0) & (tags[:, :-1] > 0) & (kind[:, 1:] == kind[:, :-1])
    inside = tags > 0
    ends = inside.copy()
    ends[:, :-1] &= ~goes_on[:, 1:]
    rows, starts = np.nonzero(inside & ~goes_on)
    stops = np.nonzero(ends)[1] + 1
    for row, k, s, e in zip(rows.tolist(), kind[rows, starts].tolist(), starts.tolist(), stops.tolist(), strict=True):
        out[row].append((k, s, e))
    return out


def _checked(kind: int, start: int, piece: str) -> list[tuple[int, int, int]]:
    """The spans of a kind that a tagged piece holds: a mail address has both its signs in some spelling, an ip four parts up
    to 255, a card passes Luhn.
    """
    if kind == 0:
        return [(0, start + m.start(), start + m.end()) for m in _SPELT.finditer(piece)]
    digits = "".join(c for c in piece if "0" <= c <= "9")
    good = len(digits) >= LEAST_DIGITS[kind]
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        good &= len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    elif kind == 2:
        good &= luhn(digits)
    return [(kind, start, start + len(piece))] if good else []


def tagged_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans by the tagger in each text, reconciled over all of its windows."""
    counts = np.array([-(-len(text) // STEP) for text in texts], np.int64)
    windows, at = np.full((int(counts.sum()), WINDOW), PADDING, np.int16), 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        if n:
            code = np.full((n - 1) * STEP + WINDOW, PADDING, np.int16)
            code[: len(text)] = classes_of(text)
            windows[at : at + n] = np.lib.stride_tricks.sliding_window_view(code, WINDOW)[::STEP]
            at += n
    rows = np.repeat(np.arange(len(texts)), counts)
    offs = (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    raw: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # equal windows are decoded once
    met: dict[bytes, int] = {}
    same = np.array([met.setdefault(w.tobytes(), len(met)) for w in windows], np.int64)
    firsts = np.unique(same, return_index=True)[1]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in firsts]
    # the last window of a text is shorter: those of like length are read together, and no farther than they reach
    lengths = np.minimum(np.repeat(np.array([len(t) for t in texts], np.int64), counts) - offs, WINDOW)[firsts]
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), 8 * BLOCK):
        block = order[at : at + 8 * BLOCK]
        found = _runs(model.viterbi(np.ascontiguousarray(windows[firsts[block], : lengths[block[-1]]])))
        for k, own in zip(block.tolist(), found, strict=True):
            runs[k] = own
    for row, off, k in zip(rows.tolist(), offs.tolist(), same.tolist(), strict=True):
        if runs[k]:
            for kind, s, e in runs[k]:
                # in the overlap, the half nearer to a window's edge is the other window's
                low = (WINDOW - STEP) // 2 if off else 0
                high = WINDOW - (WINDOW - STEP) // 2
                if e > low and s < high:
                    raw[row].append((kind, off + s, min(off + e, len(texts[row]))))
    out = []
    for text, spans in zip(texts, raw, strict=True):
        good: list[tuple[int, int, int]] = []
        for of in range(len(KINDS)):
            merged: list[list[int]] = []
            for _, s, e in sorted(x for x in spans if x[0] == of):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            good += (x for s, e in merged for x in _checked(of, s, text[s:e]))
        good.sort(key=lambda x: (x[1], x[2], x[0]))
        good = [x for k, x in enumerate(good) if all(x[1] >= y[2] for y in good[:k])] if len(good) > 1 else good
        out.append(good)
    return out


def find(texts: list[str], model: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and its added spans; added ones overlap no other."""
    added = tagged_spans(texts, model)
    out = []
    for text, more in zip(texts, added, strict=True):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        free = [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]
        out.append((base, free))
    return out


_fitted: dict[int, dict[str, np.ndarray]] = {}


def fitted(spark: SparkSession, windows: int = TRAINED) -> dict[str, np.ndarray]:
    """The weights of ``train(windows)``, fitted in one task and kept in this process; some 10 KB."""
    if windows not in _fitted:

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if any([batch.num_rows for batch in batches]):
                w = train(windows).w
                yield pa.RecordBatch.from_arrays([pa.array(list(w)), pa.array([list(v.shape) for v in w.values()], pa.list_(pa.int32())), pa.array([v.ravel().tolist() for v in w.values()], pa.list_(pa.float32()))], names=["name", "shape", "weights"])

        rows = spark.range(0, 1, 1, 1).mapInArrow(fit, "name string, shape array<int>, weights array<float>").collect()
        _fitted[windows] = {r.name: np.array(r.weights, np.float32).reshape(r.shape) for r in rows}
    return _fitted[windows]


def detect(docs: DataFrame, windows: int = TRAINED) -> DataFrame:
    """Spans of every whole text: doc_id, base and added as arrays of (kind, start, stop) in code points, stop exclusive.

    ``windows`` bounds the labelled windows that the tagger is fitted on, once, in a task; its weights go with the others.
    """
    weights = fitted(docs.sparkSession, windows)
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(kind)), ("added", pa.list_(kind))])

    def make():
        model = Tagger(weights)
        as_rows = lambda spans: [{"kind": k, "start": s, "stop": e} for k, s, e in spans]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = find(texts_of(batch.column(1)), model)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in found], pa.list_(kind)), pa.array([as_rows(a) for _, a in found], pa.list_(kind))], schema=schema)

        return step

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = "array<struct<kind: int, start: long, stop: long>>"
    return mapped(chosen, make, f"doc_id long, base {spans}, added {spans}", "text")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base by kind, the digest of the base spans, and all spans, from ``detect``'s rows."""
    spell = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), spell), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    """The digest of spans as ``digest_columns`` has it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans)).encode()).hexdigest()
