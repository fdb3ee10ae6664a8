"""Personal data in texts: validated patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from four patterns with checks (leftmost, non-overlapping, by kind). The tagger adds spans that the
patterns miss, such as addresses written with spaces or words for signs. It is trained here, in numpy, on labelled
spans: synthetic spans of each kind, plain and disguised, set into windows of the corpus's own text and of
look-alikes (numbers, dates, versions, mentions) that are no personal data.

Every text is read whole by the network (ONNX Runtime, see network.py), in windows of READ characters that overlap by OVERLAP on each side. A window's
emissions count for its middle; overlapping windows are reconciled into one emission sequence of the text, in which each
character is taken from the window where it stands farthest from an edge, and one Viterbi search over that sequence
decides the tags of the whole text, so a span never depends on where a window was cut. The search is exact: only
stretches of characters that can have a tag on a best path are searched, side by side, as none stands before and
after each; a long stretch is cut into lanes, which are chained by what each makes of every tag before it. Time is linear
in the text, whatever stands in it.

Nulls and empty texts have no spans; null doc_ids and repeated rows are kept as they are; very long texts are read
in batches of windows, with some dozens of bytes a character kept for one text. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, network

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match starts a run of digits: the rest of a run fails as the run does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Characters of a window in training and in reading, and of its margins in reading.
WINDOW, READ, OVERLAP = 64, 512, 16
HIDDEN = 12
#: Windows that run through the network together, and characters of texts that are tagged together.
BATCH = 512
TOGETHER = 500_000
#: Windows of a batch end by so many.
STEP = 16
#: Beyond it a sigmoid is 0 or 1; products of two exponentials of it are finite.
FAR = 40.0
#: Lanes whose steps are taken for all tags at once.
FEW = 192
#: Characters that are looked over together, and characters of a lane of the search.
ROWS = 16_384
LANE = 224
TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind
ROW = np.dtype((np.void, 4 * TAGS))  # the emissions of a character, copied as one


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, from each sign outward, in linear time: a local part begins where its run of characters
    or the search after the match before begins."""
    sign, free = text.find("@"), 0
    while sign >= 0:
        if sign > free and (m := DOMAIN.match(text, sign + 1)):
            a = sign
            while a > free and text[a - 1] in LOCAL:
                a -= 1
            if a < sign:
                yield a, m.end()
                free = m.end()
        sign = text.find("@", sign + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; linear in the text."""
    out = [(0, a, b) for a, b in addresses(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = NOT_DIGIT.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


#: Classes of characters: one for each of these, then ranges.
SIGNS = "0123456789 .,@+-()[]{}<>_%:/\n"
OWN = {c: i for i, c in enumerate(SIGNS)}


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class by code point below 0x180; others are letters of one class."""
    t = np.full(0x180, len(SIGNS) + 4, np.uint8)
    for i in range(0x180):
        c = chr(i)
        if c in OWN:
            t[i] = OWN[c]
        elif c in "dotaDOTA":
            t[i] = len(SIGNS)  # the letters of "dot" and "at"
        elif c.isascii() and c.islower():
            t[i] = len(SIGNS) + 1
        elif c.isascii() and c.isupper():
            t[i] = len(SIGNS) + 2
        elif c.isalpha():
            t[i] = len(SIGNS) + 3
    return t


CLASSES = len(SIGNS) + 6  # the last is padding
PAD = CLASSES - 1


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return class_table()[np.minimum(codes, 0x17F)]


class Tagger:
    """A bidirectional LSTM over character classes with a CRF over tags; arrays are (features, batch)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self._made: tuple = (None,)
        g = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"emit": g(TAGS, 2 * HIDDEN), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            # one table of input gates for each class stands for embedding and input weights together
            self.p |= {f"x{d}": g(4 * HIDDEN, CLASSES), f"h{d}": g(4 * HIDDEN, HIDDEN)}
            self.p[f"x{d}"][HIDDEN : 2 * HIDDEN] += 1  # gates that forget start open

    def _half(self, d: str, x: np.ndarray, keep: bool):
        """Hidden states (time, HIDDEN, batch) in one direction; x: (time, batch)."""
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        table, u = self.p[f"x{d}"], self.p[f"h{d}"]
        n = x.shape[1]
        h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
        out, kept = np.empty((len(x), HIDDEN, n), np.float32), {}
        for t in steps:
            z = table[:, x[t]]
            z += u @ h
            z[: 3 * HIDDEN] *= 0.5
            np.tanh(z, out=z)
            z[: 3 * HIDDEN] *= 0.5
            z[: 3 * HIDDEN] += 0.5
            i, f, o, g = z[:HIDDEN], z[HIDDEN : 2 * HIDDEN], z[2 * HIDDEN : 3 * HIDDEN], z[3 * HIDDEN :]
            before = (h, c)
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep:
                kept[t] = (i, f, o, g, th, *before)
        return out, kept

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        """As _half, without what training keeps."""
        out = np.empty((len(x), HIDDEN, x.shape[1]), np.float32)
        for t, h in self._read(d, x, [x.shape[1]] * len(x)):
            out[t] = h.T
        return out

    def _read(self, d: str, x: np.ndarray, live: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Each time and its hidden states (columns, HIDDEN), overwritten by the next, in one direction. Sigmoids are found by
        exponentials, which numpy finds much faster than hyperbolic tangents, and all in place; each gate is (columns,
        HIDDEN), so an input's share is copied in one piece.

        live: at each time, how many of the first columns are read there. The others are padding from there to the end of
        their window; backward they begin with the states of column 0, which is then padding throughout.
        """
        table, u = -self.p[f"x{d}"].reshape(4, HIDDEN, CLASSES), -self.p[f"h{d}"].reshape(4, HIDDEN, HIDDEN)
        table[3] *= 2  # a tanh is two sigmoids of twice its input, less one
        u[3] *= 2
        far = float((np.abs(table).max(axis=2) + np.abs(u).sum(axis=2)).max()) > FAR  # states are below one
        table = np.ascontiguousarray(table.transpose(0, 2, 1)).reshape(4 * CLASSES, HIDDEN)
        u = np.ascontiguousarray(u.transpose(0, 2, 1))
        gate = CLASSES * np.arange(4)[:, None]
        width = x.shape[1]
        room, place = np.empty((2, 4 * width * HIDDEN), np.float32), np.empty(4 * width, np.intp)
        states, cells, spare = (np.zeros((width, HIDDEN), np.float32) for _ in range(3))
        n = 0
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            if live[t] != n:
                if n:  # of columns that begin
                    states[n : live[t]], cells[n : live[t]] = states[0], cells[0]
                n = live[t]
                z, more = room[:, : 4 * n * HIDDEN].reshape(2, 4, n, HIDDEN)
                (i, f, o, g), h, c, q, row = z, states[:n], cells[:n], spare[:n], place[: 4 * n].reshape(4, n)
            np.add(x[t, :n], gate, out=row)
            np.take(table, row, axis=0, out=z, mode="clip")
            z += np.matmul(h, u, out=more)
            if far:
                np.minimum(z, FAR, out=z)
            # sigmoids are 1 / (1 + exp); products of them are divided once
            np.exp(z, out=z)
            z += 1
            i *= g
            np.subtract(2, g, out=g)
            g /= i
            c /= f
            c += g
            np.maximum(c, -10, out=q)  # whose tanh is -1
            q *= -2
            np.exp(q, out=q)
            q += 1
            o *= q
            np.subtract(2, q, out=q)
            np.divide(q, o, out=h)
            yield t, h

    def _network(self):
        """The session of ONNX Runtime for the weights as they are now, or None, and what the backward direction begins
        with (states, cells) for windows of each length, as READ less so many of padding have been read."""
        key = b"".join(self.p[k].tobytes() for k in sorted(self.p))
        if self._made[0] != key:
            states, kept = self._half("b", np.full((READ, 1), PAD), True)
            begin = np.zeros((READ + 1, 2, HIDDEN), np.float32)
            for t, (i, f, _, g, _, _, c) in kept.items():
                begin[t] = states[t, :, 0], (f * c + i * g)[:, 0]
            self._made = key, network.session(network.bilstm(self.p)), begin
        return self._made[1:]

    def emissions(self, x: np.ndarray, live: list[int] | None = None) -> np.ndarray:
        """(time, TAGS, batch) of windows x (time, batch), which are padding from there to READ; outside the middle of a
        window they may be left out.

        live, as in _read: numpy reads whole windows, for (time, batch, TAGS) of their middle.
        """
        if live is not None:
            return self._middle(x, live)
        session, begin = self._network()
        if session is not None:
            none = np.zeros((x.shape[1], HIDDEN), np.float32)
            hb, cb = (np.tile(v, (x.shape[1], 1)) for v in begin[len(x)])
            return session.run(None, {"x": x.astype(np.int32), "hf": none, "cf": none, "hb": hb, "cb": cb})[0].transpose(0, 2, 1)
        ends = len(x) - (x[::-1] != PAD).argmax(axis=0)
        order = np.argsort(-ends, kind="stable")  # long windows first, after one of padding
        whole = np.full((READ, 1 + len(order)), PAD, np.uint8)
        whole[: len(x), 1:] = x[:, order]
        going = 1 + np.searchsorted(-ends[order], -np.arange(READ), "left")  # columns with more characters than a time
        e = self._middle(whole, np.minimum(-(-going // STEP) * STEP, 1 + len(order)).tolist())
        out = np.zeros((READ, len(order), TAGS), np.float32)
        out[OVERLAP : READ - OVERLAP, order] = e[:, 1:]
        return out[: len(x)].transpose(0, 2, 1)

    def _middle(self, x: np.ndarray, live: list[int]) -> np.ndarray:
        """(time, batch, TAGS) of the middle of windows; live: as in _read."""
        x, n = x.astype(np.intp), len(x) - 2 * OVERLAP
        out, more = np.empty((n, x.shape[1], TAGS), np.float32), np.empty((x.shape[1], TAGS), np.float32)
        for d, w in (("f", self.p["emit"][:, :HIDDEN].T), ("b", self.p["emit"][:, HIDDEN:].T)):
            w = np.ascontiguousarray(w)
            for t, h in self._read(d, x, live):
                if 0 <= t - OVERLAP < n:
                    e = out[t - OVERLAP, : len(h)]
                    if d == "f":
                        np.matmul(h, w, out=e)
                        e += self.p["bias"]
                    else:
                        e += np.matmul(h, w, out=more[: len(h)])
        return out

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood a character under the CRF, and its slopes; y: tags (time, batch)."""
        p, (steps, n) = self.p, x.shape
        (hf, kf), (hb, kb) = self._half("f", x, True), self._half("b", x, True)
        w = p["emit"]
        e = w[:, :HIDDEN] @ hf + w[:, HIDDEN:] @ hb + p["bias"][:, None]
        move = p["move"]

        def total(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis=axis))

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + total(alpha[t - 1][:, None, :] + move[:, :, None], 0)
        for t in range(steps - 2, -1, -1):
            beta[t] = total(move[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        z = total(alpha[-1], 0)
        ge = np.exp(alpha + beta - z)
        cols = np.arange(n)
        gold = sum(e[t][y[t], cols] for t in range(steps)) + sum(move[y[t - 1], y[t]] for t in range(1, steps))
        g_move = np.zeros_like(move)
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, None, :] + move[:, :, None] + (e[t] + beta[t])[None] - z)
            g_move += pair.sum(axis=2)
            np.add.at(g_move, (y[t - 1], y[t]), -1)
        for t in range(steps):
            ge[t][y[t], cols] -= 1
        g = {"move": g_move, "bias": ge.sum(axis=(0, 2)), "emit": np.concatenate([np.einsum("tkb,thb->kh", ge, hf), np.einsum("tkb,thb->kh", ge, hb)], axis=1)}
        for d, kept, part in (("f", kf, w[:, :HIDDEN]), ("b", kb, w[:, HIDDEN:])):
            gx, gu = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"])
            dh, dc = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                i, f, o, gg, th, h0, c0 = kept[t]
                dh = dh + part.T @ ge[t]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)])
                gu += dz @ h0.T
                hot = np.zeros((CLASSES, n), np.float32)
                hot[x[t], cols] = 1
                gx += dz @ hot.T
                dh, dc = self.p[f"h{d}"].T @ dz, dc * f
            g |= {f"x{d}": gx, f"h{d}": gu}
        size = steps * n
        return float((z - gold).sum() / size), {k: (v / size).astype(np.float32) for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1200, batch: int = 64, rate: float = 0.02, seed: int = 4) -> list[float]:
        """Adam over windows (time, rows)."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, steps + 1):
            take = rng.integers(0, x.shape[1], batch)
            loss, g = self.loss(x[:, take], y[:, take])
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
        return losses

    def decode(self, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The best tags of each of several emission sequences, none empty, that stand one after the other in flat
        (time, TAGS)."""
        tags = np.zeros(len(flat), np.uint8)
        if not len(flat):
            return tags
        last = np.cumsum(sizes) - 1
        first = last + 1 - np.array(sizes)
        move = self.p["move"].astype(np.float32)
        live = self._live(flat, first, last)
        # stretches that begin after none, or with their text, and end before none, or with their text
        edge = np.diff(live.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = np.setdiff1d(first[live[first]], begin)  # two texts that meet
        begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
        if not len(begin):
            return tags
        count = -(-(end - begin) // LANE)
        whole = np.repeat(np.arange(len(begin)), count)
        own = begin[whole] + LANE * (np.arange(len(whole)) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(own + LANE, end[whole])
        order = np.argsort(own - stop, kind="stable")  # long lanes first
        kept = flat[first].copy()
        flat[first] -= move[0]  # as if none stood before a text, and the step from it cost nothing
        starts = np.full((TAGS, len(own)), -1e9, np.float32)
        starts[0] = 0
        parts = np.flatnonzero(count[whole[order]] > 1)
        if len(parts):  # stretches of several lanes: what each lane makes of every tag before it, one after the other
            lanes = order[parts]
            each = np.full((TAGS, TAGS, len(lanes)), -1e9, np.float32)
            each[np.arange(TAGS), np.arange(TAGS)] = 0
            # all tags of a lane side by side, so that long lanes still come first
            through = self._steps(flat, each.transpose(0, 2, 1).reshape(TAGS, -1), np.repeat(own[lanes], TAGS), np.repeat(stop[lanes], TAGS), None)
            through = through.reshape(TAGS, len(lanes), TAGS)
            s = starts[:, 0]
            for j in np.argsort(lanes).tolist():
                lane = lanes[j]
                if own[lane] == begin[whole[lane]]:
                    s = starts[:, lane]
                else:
                    starts[:, lane] = s = s - s[0]
                s = (s[None, :] + through[:, j, :]).max(axis=1)
        back = np.zeros((int((stop - own).max()), TAGS, len(own)), np.uint8)
        done = self._steps(flat, starts[:, order], own[order], stop[order], back)
        flat[first] = kept
        done += np.where(np.isin(stop[order] - 1, last), 0, move[:, :1])
        rank = np.argsort(order)
        if len(parts):
            self._trace_chained(tags, own, stop, end[whole], done, back, rank)
        alone = order[count[whole[order]] == 1]
        self._trace(tags, own[alone], stop[alone], done[:, rank[alone]].argmax(axis=0), back, rank[alone])
        return tags

    def _live(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Characters that can have a tag on a best path.

        A tag's credit is what it may still gain by its way back to none; so a span gains, over none throughout, at most
        the sum of its steps, each with the credit of the tag it leads to and less that of the tag it leaves. Each step
        is bounded by the best one into and within a span, and a character is live if some span over it could gain.
        """
        move = self.p["move"].astype(np.float64)
        credit = move[:, 0] - move[0, 0]
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        credit[begin] = np.maximum(credit[begin], credit[inside] + move[begin, inside] - move[inside, inside])
        enter = move[0] - move[0, 0] + credit
        within = (move[1:] - credit[1:, None]).max(axis=0) - move[0, 0] + credit
        into, on = np.empty(len(flat), np.float32), np.empty(len(flat), np.float32)
        some = np.empty((TAGS, ROWS), np.float32)
        w = np.empty(ROWS, np.float32)
        for at in range(0, len(flat), ROWS):  # tag by tag, of as many characters as a cache holds
            n = min(ROWS, len(flat) - at)
            e, v = some[:, :n], w[:n]
            e[:] = flat[at : at + n].T
            for best, step in ((into[at : at + n], enter), (on[at : at + n], within)):
                np.add(e[1], np.float32(step[1]), out=best)
                for k in range(2, TAGS):
                    np.add(e[k], np.float32(step[k]), out=v)
                    np.maximum(best, v, out=best)
                best -= e[0]
        into[first] = (flat[first] + credit)[:, 1:].max(axis=1) - flat[first, 0]
        total = np.cumsum(on, dtype=np.float64)
        ahead = np.maximum.accumulate(into - total)  # of a span's begin
        total[last] += max(0.0, -credit[1:].min())  # a text ends without a step to none
        rest = np.maximum.accumulate(total[::-1])[::-1]
        return ahead + rest > -1e-3

    def _steps(self, flat, s, own, stop, back: np.ndarray | None) -> np.ndarray:
        """Scores of each tag at the ends of lanes, long ones first, from scores s (TAGS, lanes) at the character before
        each; and the tags that they come from."""
        move, s = self.p["move"].astype(np.float32), np.array(s)
        size = stop - own
        left = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # lanes with so many characters
        way, better, best = np.empty_like(s), np.empty(s.shape, bool), np.empty_like(s)
        for t, n in enumerate(left.tolist()):
            now, new, w, more = s[:, :n], best[:, :n], way[:, :n], better[:, :n]
            if n <= FEW:  # all tags at once; argmax takes the first of equal ones, too
                if back is None:
                    (now[:, None] + move[:, :, None]).max(axis=0, out=new)
                else:
                    ways = now.T[None] + move.T[:, None]
                    last = ways.argmax(axis=2)
                    back[t, :, :n] = last
                    new[:] = np.take_along_axis(ways, last[:, :, None], axis=2)[:, :, 0]
                new += flat[own[:n] + t].T
                if back is not None:
                    new -= new[0].copy()
                s[:, :n] = new
                continue
            np.add(now[0], move[0][:, None], out=new)
            for k in range(1, TAGS):
                np.add(now[k], move[k][:, None], out=w)
                if back is not None:
                    np.greater(w, new, out=more)
                    np.copyto(back[t, :, :n], k, where=more)
                np.maximum(new, w, out=new)
            new += flat[own[:n] + t].T
            if back is not None:
                new -= new[0].copy()
            s[:, :n] = new
        return s

    def _trace(self, tags, own, stop, tail, back, at) -> np.ndarray:
        """Writes the tags of lanes, long ones first, that end with tail; the tags before them."""
        now, size = tail.astype(np.intp), stop - own
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            n = int(np.searchsorted(-size, -t, "left"))
            tags[own[:n] + t] = now[:n]
            now[:n] = back[t, now[:n], at[:n]]
        return now

    def _trace_chained(self, tags, own, stop, end, done, back, rank) -> None:
        """As _trace, for stretches of several lanes: every tag that a lane can end with is traced, then one is chosen."""
        many = np.flatnonzero((stop != end) | np.append(False, (stop != end)[:-1]))
        many = many[np.argsort(own[many] - stop[many], kind="stable")]
        ways = np.zeros((TAGS, len(tags)), np.uint8)
        each = np.tile(np.arange(TAGS), len(many))
        at = np.repeat(own[many], TAGS) + each * len(tags)
        enter = self._trace(ways.reshape(-1), at, at + np.repeat(stop[many] - own[many], TAGS), each, back, np.repeat(rank[many], TAGS)).reshape(-1, TAGS).T
        tail = 0
        for j in np.argsort(-own[many]).tolist():
            lane = many[j]
            tail = int(done[:, rank[lane]].argmax()) if stop[lane] == end[lane] else tail
            tags[own[lane] : stop[lane]] = ways[tail, own[lane] : stop[lane]]
            tail = int(enter[tail, j])

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans (kind, start, end) of each text."""
        found: list[list[tuple[int, int, int]]] = []
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= TOGETHER:
                size += len(texts[to])
                to += 1
            found += self._tag(texts[at:to])
            at = to
        return found

    def _tag(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        inner = READ - 2 * OVERLAP
        coded = [classes(t) for t in texts]
        # the texts one after the other, each from the start of a window's middle on
        count = [-(-len(c) // inner) for c in coded]
        first = np.cumsum(count) - count
        line = np.full(sum(count) * inner + 2 * OVERLAP, PAD, np.uint8)
        for c, a in zip(coded, first.tolist(), strict=True):
            line[OVERLAP + a * inner : OVERLAP + a * inner + len(c)] = c
        # margins of a window that reach over a text's end are padding, whatever text comes next
        windows = np.lib.stride_tricks.sliding_window_view(line, READ)[::inner].copy() if sum(count) else np.empty((0, READ), np.uint8)
        some = [k for k, n in enumerate(count) if n]
        windows[first[some], :OVERLAP] = PAD
        windows[[first[k] + count[k] - 1 for k in some], READ - OVERLAP :] = PAD
        sizes = np.array([len(c) for c in coded], np.intp)
        flat = np.empty((int(sizes.sum()), TAGS), np.float32)
        rows = flat.view(ROW)[:, 0]
        # characters before a window in its text, and from there to the text's end
        into = inner * (np.arange(len(windows)) - first.repeat(count))
        rest = sizes.repeat(count) - into
        into += (np.cumsum(sizes) - sizes).repeat(count)
        # the last window of a text is padding from the text's end on; long windows first, in batches of one size
        ends = np.minimum(rest + OVERLAP, READ)
        order = np.argsort(-ends, kind="stable")
        for own in np.array_split(order, max(1, round(len(order) / BATCH))) if len(order) else []:
            x = np.ascontiguousarray(windows[own, : ends[own[0]]].T)
            emitted = np.ascontiguousarray(self.emissions(x)[OVERLAP : OVERLAP + inner].transpose(0, 2, 1)).view(ROW)[:, :, 0]
            for j, (to, n) in enumerate(zip(into[own].tolist(), np.minimum(rest[own], inner).tolist(), strict=True)):
                rows[to : to + n] = emitted[:n, j]
        del windows
        tags = self.decode(flat, [len(coded[k]) for k in some])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        at = 0
        for k in some:
            own = tags[at : at + len(coded[k])]
            at += len(own)
            if own.any():
                found[k] = _spans(own)
        return found


def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    kind = (tags.astype(np.int64) + 1) // 2  # 0 is none
    new = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((tags > 0) & (tags % 2 == 1)))
    ends = np.append(new[1:], len(tags))
    return [(int(kind[a]) - 1, a, b) for a, b in zip(new.tolist(), ends.tolist(), strict=True) if kind[a]]


#: How an address may stand for its sign and its points: in brackets, in words, or with white space on both sides; the
#: sign also with it on one side. A point before white space alone ends a sentence.
AT = re.compile(r"\s*[\[({<]\s*(?:@|at)\s*[\])}>]\s*|\s*@\s*|\s+at\s+")
POINT = re.compile(r"\s*[\[({<]\s*(?:\.|dot)\s*[\])}>]\s*|\s+(?:\.|dot)\s+|\.")


def checked(kind: int, span: str) -> bool:
    """Whether a tagged span, read without its disguise, passes the checks of its kind."""
    s = span.lower()
    if kind == 0:
        sign = AT.search(s)
        return sign is not None and EMAIL.fullmatch(POINT.sub(".", s[: sign.start()]) + "@" + POINT.sub(".", s[sign.end() :])) is not None
    digits = NOT_DIGIT.sub("", s)
    if kind == 1:
        parts = POINT.sub(".", re.sub(r"(?<=\d)\.\s+(?=\d)", ".", s)).split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[ ._/-]{0,2}[0-9])+", s) is not None
    # a number without a country code has an area code and groups of three and four, all apart
    return 9 <= len(digits) <= 15 and (re.fullmatch(r"(?:\+ ?[0-9]|\()[ ().0-9/-]+[0-9]", s) is not None or re.fullmatch(r"[2-9][0-9]{2}([-.])[0-9]{3}\1[0-9]{4}", s) is not None)


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng, low: int = 2, high: int = 9) -> str:
    return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(low, high))))


def _card(rng) -> str:
    d = "456"[int(rng.integers(3))] + _number(rng, 14)
    return next(d + str(k) for k in range(10) if luhn(d + str(k)))


def _example(rng, kind: int, words: list[str]) -> str:
    """A synthetic span, plain or disguised; names are made-up words or some of the words given."""
    name = lambda: words[int(rng.integers(len(words)))] if words and rng.random() < 0.5 else _word(rng)
    plain = rng.random() < 0.5
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == 0:
        at, dot = ("@", ".") if plain else pick((" @ ", "."), (" @ ", " . "), ("@ ", "."), (" @", " . "), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" at ", "."), (" at ", "."), ("[at]", "[dot]"), (" {at} ", "."), ("{at}", "{dot}"), (" <at> ", "."), (" <at> ", " <dot> "))
        user = name() + (pick(dot, "_", "", ".") + name() if rng.random() < 0.5 else "") + (_number(rng, int(rng.integers(1, 4))) if rng.random() < 0.3 else "")
        return user + at + name() + dot + pick("com", "org", "net", "example" + dot + "com", "io", "de", "fr", "co" + dot + "uk", "edu")
    if kind == 1:
        sep = "." if plain else pick(" . ", "[.]", ". ", "(.)", " dot ", " dot ")
        return sep.join(str(int(v)) for v in rng.integers(0, 256, 4))
    if kind == 2:
        d, sep = _card(rng), pick(" ", "-", "") if plain else pick(".", "/", "_", "  ")
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    cc = pick("1", "44", "49", "33", "34", "7")
    return f"+{cc} ({a}) {b}-{c}" if plain and rng.random() < 0.6 else pick(f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc}{a}{b}{c}") if plain else pick(f"({a}) {b}-{c}", f"+ {cc} {a} {b} {c}", f"+{cc}/{a}/{b}{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")


def _decoy(rng) -> str:
    """Text that looks alike and is no personal data."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    return pick(
        _number(rng, int(rng.integers(1, 9))), f"20{_number(rng, 2)}-0{_number(rng, 1)}-1{_number(rng, 1)}", f"v{_number(rng, 1)}.{_number(rng, 1)}.{_number(rng, 2)}", f"{_number(rng, 2)}.{_number(rng, 2)}.{_number(rng, 4)}",
        f"{_number(rng, 2)}:{_number(rng, 2)}", f"@{_word(rng)}", f"{_word(rng)} at {_word(rng)}", f"({_number(rng, 4)})", f"{_number(rng, 3)},{_number(rng, 3)}", f"+{_number(rng, 2)} %", f"{_number(rng, 3)}-{_number(rng, 3)}",
        "".join("0123456789abcdef"[int(v)] for v in rng.integers(0, 16, int(rng.integers(8, 41)))), f"{_number(rng, 4)} {_number(rng, 4)}", f"token = \"{_word(rng)}{_number(rng, 6)}\"", f"https://{_word(rng)}.com/{_number(rng, 3)}?a={_number(rng, 2)}",
    )


def training_windows(texts: list[str], n: int = 12_000, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags), each (WINDOW, n): labelled spans in the corpus's own text and in plain words."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t and len(t) > WINDOW]
    words = sorted({w.lower() for t in texts for w in t.split() if w.isascii() and w.isalpha() and 2 < len(w) < 12})
    xs, ys = np.full((WINDOW, n), PAD, np.uint8), np.zeros((WINDOW, n), np.uint8)
    for j in range(n):
        if texts and rng.random() < 0.7:
            t = texts[int(rng.integers(len(texts)))]
            a = int(rng.integers(0, len(t) - WINDOW))
            t = t[max(0, a - 40) : a + 2 * WINDOW]
            text, spans = t, [s for s in base_spans(t) if s[2] < len(t) and (s[1] > 0 or a < 40)]
        else:
            text, spans = " ".join(_word(rng) for _ in range(24)), []
        r = rng.random()
        if r < 0.75:
            cuts = [0] + [m.end() for m in re.finditer(r"\s+", text) if not any(s[1] < m.end() < s[2] for s in spans)]
            at = cuts[int(rng.integers(len(cuts)))]
            # addresses in words have the most forms: they are half of the examples
            kind = max(0, int(rng.integers(-2, 4))) if r < 0.45 else -1
            put = _example(rng, kind, words) if kind >= 0 else _decoy(rng)
            # brackets and marks around it are no part of it
            lead, tail = [("", " "), ("", " "), ("", ". "), ("", ", "), ("(", ") "), ("<", "> "), ('"', '" '), (": ", "\n")][int(rng.integers(8))]
            text = text[:at] + lead + put + tail + text[at:]
            more, head = len(lead) + len(put) + len(tail), at + len(lead)
            spans = [(k, a + more * (a >= at), b + more * (a >= at)) for k, a, b in spans] + ([(kind, head, head + len(put))] if kind >= 0 else [])
            begin = max(0, at - int(rng.integers(0, WINDOW - 8)))
        else:
            begin = int(rng.integers(0, max(1, len(text) - WINDOW)))
        x = classes(text[begin : begin + WINDOW])
        xs[: len(x), j] = x
        for k, a, b in spans:
            for i in range(max(a, begin), min(b, begin + WINDOW)):
                ys[i - begin, j] = 1 + 2 * k + (i > a)
    return xs, ys


#: Texts that lend the training windows their background, pieces of each at most, and characters of a piece.
SAMPLE_TEXTS, PIECES, PIECE = 400, 5, 400


def background(docs: DataFrame) -> list[str]:
    """Pieces of SAMPLE_TEXTS texts: PIECES of each, 2,000 in all, at hashed offsets of the whole text. A piece begins
    after white space or with its text; a text that is not longer than a piece lends itself once."""
    from pyspark.sql import functions as F

    order = F.xxhash64("doc_id", F.substring("text", 1, 64))
    room = F.greatest(F.length("t") - PIECE + 1, F.lit(1)).cast("long")
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda j: (F.pmod(F.xxhash64("o", j), room) + 1).cast("int")))
    cut = lambda a: F.col("t").substr(a, F.lit(PIECE))
    pieces = F.transform(starts, lambda a: F.when(a == 1, cut(a)).otherwise(F.regexp_replace(cut(a), r"^\S+\s*", "")))
    # the hashes are sorted without the texts
    first = docs.select(order.alias("o")).orderBy("o").limit(SAMPLE_TEXTS).collect()
    if not first:
        return []
    some = docs.select(F.col("text").alias("t"), order.alias("o")).where(F.col("o") <= first[-1]["o"])
    rows = some.select("o", pieces.alias("p")).orderBy("o", "p").limit(SAMPLE_TEXTS).collect()
    return [p for r in rows for p in r["p"] or [] if p]


def train(docs: DataFrame) -> Tagger:
    tagger = Tagger()
    tagger.fit(*training_windows(background(docs)))
    return tagger


#: No address, number or card is longer, in whatever disguise.
LONGEST = 320


def found_spans(text: str, tagged: list[tuple[int, int, int]]) -> tuple[list, list]:
    """(base spans, all spans), each by kind, then start. A tagged span is taken to the ends of the words it cuts, and
    added if it has LONGEST characters at most, passes the checks of its kind and touches no base span."""
    base = base_spans(text)
    if not tagged:
        return base, base
    extents = united(base)
    firsts = [a for _, a, _ in extents]
    added, last = [], 0
    run = (0, 0)  # of letters and digits, the last that was walked

    def word(i: int) -> tuple[int, int]:
        nonlocal run
        if not run[0] <= i < run[1]:
            a, b = i, i + 1
            while a and text[a - 1].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum():
                b += 1
            run = a, b
        return run

    for k, a, b in tagged:  # in the order of the text
        while a < b and (text[a].isspace() or text[a] in ",;:!?"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:!?"):
            b -= 1
        if a == b or a < last:
            continue
        # a number that goes on outside the span is all in it
        if text[a].isalnum():
            a = word(a)[0]
        if text[b - 1].isalnum():
            b = word(b - 1)[1]
        if b - a > LONGEST or a < last or text[a - 1 : a].isalnum() and a or text[b : b + 1].isalnum():
            continue
        near = bisect_left(firsts, b) - 1  # the last extent that begins before b ends last, too
        if near >= 0 and extents[near][2] > a:
            continue
        if checked(k, text[a:b]):
            added.append((k, a, b))
            last = b
    return base, sorted(base + added)


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Extents of spans that overlap, by start; the kind is that of the longest span in an extent, then the first of
    KINDS. Spans that only touch stay apart."""
    out: list[list[tuple[int, int, int]]] = []
    end = -1
    for s in sorted(spans, key=lambda s: s[1:]):
        if s[1] < end:
            out[-1].append(s)
        else:
            out.append([s])
        end = max(end, s[2])
    return [(min(g, key=lambda s: (s[1] - s[2], s[0]))[0], g[0][1], max(s[2] for s in g)) for g in out]


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all), n_added, n_spans (all)."""
    # a network of some thousand weights, whatever the corpus
    model = docs.sparkSession.sparkContext.broadcast((tagger or train(docs)).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tagger()
        t.p = model.value
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            rows = []
            for text, tagged in zip(texts, t.tag(texts), strict=True):
                base, spans = found_spans(text, tagged)
                counts = [sum(k == i for k, _, _ in base) for i in range(4)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.lean(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redacted(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, spans that overlap by one, and n_chars where docs has it."""
    model = docs.sparkSession.sparkContext.broadcast((tagger or train(docs)).p)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tagger()
        t.p = model.value
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for text, tagged in zip(texts, t.tag([x or "" for x in texts]), strict=True):
                if text:
                    for k, x, y in reversed(united(found_spans(text, tagged)[1])):
                        text = f"{text[:x]}[{KINDS[k].upper()}]{text[y:]}"
                out.append(text)
            cols = {n: b.column(n) for n in names} | {"text": pa.array(out, pa.string())}
            if "n_chars" in names:
                cols["n_chars"] = pa.array([None if x is None else len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(common.lean(run), docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
