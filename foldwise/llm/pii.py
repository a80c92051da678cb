"""Personal data: rules give base spans, a semi-Markov conditional random field adds the others.

A segment of up to LONGEST tokens is scored as a whole (its shape, check sums, words before it), a kind also by the kind of the
entity before it, and a dynamic program over the tokens around digits and at-signs chooses boundaries and kinds together.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.llm.shared import bounded_batches, only, slices

#: Kinds in the order of the digests; the field may find the last one too, for which there is no rule.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Tokens of a segment at most, and starts whose segments are worked on at once.
LONGEST, STARTS = 20, 512
#: Sentences that the field is trained on, and its passes over them.
SENTENCES, EPOCHS = 700, 12

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_TOKEN = re.compile(r"[^\W_]+|_+|\s+|[^\w\s]")
_HOT = re.compile(r"[0-9@]+")
_SPELT = re.compile(r"[\[( ](?:at|AT)[\]) ] ?[A-Za-z0-9-]+ ?[\[( ](?:dot|DOT)[\]) ]")
_RUN = re.compile(r"[0-9]+")
_IP_RUN = re.compile(r"[0-9.]{7,}")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of _EMAIL in time linear in the text: each at-sign is met from the left."""
    last, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of four numbers with points between, in time linear in the text."""
    for run in _IP_RUN.finditer(text):
        at, got = run.start(), []
        for part in run.group().split("."):
            got = [*got, at] if part else []
            at += len(part) + 1
            if len(got) == 4:
                yield got[0], at - 1
                got = []


def base_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind; leftmost and non-overlapping within a kind."""
    out: list[Span] = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, "ip") for a, b in _ips(text) if _is_ip(text[a:b])]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if _is_card(m.group())]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))



# --- the field ---

_AT = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]+(?:(?: ?[\[(]? ?(?:dot|DOT) ?[\])]? ?|\.)[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}")
_HEX = re.compile(r"[0-9a-f]{32,64}|[0-9A-F]{32,64}")
#: Words that announce a kind, in lower case.
CUES = {
    "email": ("email", "mail", "e-mail", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "host", "address", "server", "login", "adresse"),
    "card": ("card", "visa", "pay", "account", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "key", "secret", "password", "apikey"),
}
_CUE = {w: KINDS.index(k) for k, words in CUES.items() for w in words}
FEATURES = 35


def features(text: str, a: int, b: int) -> list[float]:
    """What the field sees of the segment text[a:b] as a whole."""
    s = text[a:b]
    d = _digits(s)
    before, after = text[max(0, a - 24) : a], text[b : b + 2]
    x = [0.0] * FEATURES
    x[0] = 1.0
    x[1] = float(_EMAIL.fullmatch(s) is not None)
    x[2] = float("@" not in s and _AT.fullmatch(s) is not None)
    x[3] = float(_IP.fullmatch(s) is not None and _is_ip(s))
    x[4] = float(s.count(".") == 3 and not x[3])
    card = _CARD.fullmatch(s) is not None
    x[5] = float(card and 14 <= len(d) <= 19 and luhn(d))
    x[6] = float(card and 12 <= len(d) <= 19 and not luhn(d))
    x[7] = float(_PHONE.fullmatch(s) is not None and 10 <= len(d) <= 15)
    x[8] = float(_NATIONAL.fullmatch(s) is not None and 9 <= len(d) <= 12)
    x[9] = float(_HEX.fullmatch(s) is not None and s.isalnum() and len(d) < len(s))
    x[10] = float(before[-1:].isalnum() or after[:1].isalnum())
    x[11] = float(before[-1:] in "+.-@(" and before != "" or (after[:1] in ".-@" and after[1:].isalnum()))
    x[12] = float(s[0] == "+")
    x[13] = float("@" in s)
    x[14] = float(s.count("(") != s.count(")"))
    x[15] = min(len(d), 20) / 10
    x[16] = float(any(c.isalpha() for c in s))
    x[17] = float(" " in s)
    x[18] = float(before[-1:] in "\"'" and after[:1] in "\"'" and before != "" and after != "")
    x[19] = float(len(d) == len(s))
    x[20] = float(not (x[1] or x[2] or x[3] or x[5] or x[7] or x[8] or x[9]))
    runs = _RUN.findall(s)
    sizes = [len(r) for r in runs]
    x[26] = min(len(runs), 8) / 4
    x[27] = min(max(sizes, default=0), 20) / 10
    x[28] = float(len(runs) > 1 and len(set(sizes)) == 1)
    x[29] = min(len(set(s) - _ALNUM), 4) / 2
    x[30] = sum(c.isalpha() for c in s) / len(s)
    x[31] = float(len(s) >= 20 and s.isalnum() and 0 < len(d) < len(s))
    x[32] = min(len(s), 80) / 40
    x[33] = float(after[:1] in " ,.;:!?\n\"')]" or after == "")
    x[34] = float(len(runs) > 1 and max(sizes) >= 12)
    words = re.findall(r"[^\W\d_]+", before.lower())[-2:]
    for w in words:
        if w in _CUE:
            x[21 + _CUE[w]] = 1.0
    return x


def tokens(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]


def segments(text: str, toks: list[tuple[int, int]], first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """Token ranges [i, j) with first <= i < last that can be an entity, by start: edges are no white space, no line end is within, and a digit, an
    at-sign or a spelt-out address is."""
    last = len(toks) if last is None else last
    out = []
    if first >= last:
        return out
    reach = toks[min(last + LONGEST, len(toks)) - 1][1]
    spelt = [m.span() for m in _SPELT.finditer(text, max(toks[first][0] - 1, 0), min(reach + 1, len(text)))]
    starts = [s[0] for s in spelt]
    for i in range(first, last):
        a = toks[i][0]
        head = text[a]
        if not (head.isalnum() or head in "+("):
            continue
        k = bisect_left(starts, a)
        address = spelt[k][1] if k < len(spelt) else len(text) + 1
        seen = False
        for j in range(i + 1, min(i + LONGEST, len(toks)) + 1):
            c, d = toks[j - 1]
            piece = text[c:d]
            if "\n" in piece or (j > i + 1 and c != toks[j - 2][1]):
                break
            seen = seen or piece == "@" or d >= address or any("0" <= ch <= "9" for ch in piece)
            if seen and piece[-1].isalnum():
                out.append((i, j))
    return out


#: Weights of the field: of features by kind, and of a kind after the kind of the entity before it (row 0: there was none).
Weights = tuple[np.ndarray, np.ndarray]


def _ranges(n: int, segs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Where the segments of each start lie in segs, which is in the order of starts; and the ends of all."""
    at = np.searchsorted(np.array([i for i, _ in segs], np.int64), np.arange(n + 1))
    return at, np.array([j for _, j in segs], np.int64)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _sums(n: int, segs: list[tuple[int, int]], score: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log sum over all segmentations, the probability of each segment by kind, and the expected uses of each transition.

    The state at a token is the kind of the last entity before it; single tokens outside entities score 0 and keep it.
    """
    kinds = trans.shape[1]
    at, ends = _ranges(n, segs)
    alpha = np.full((n + 1, kinds + 1), -1e300)
    alpha[0, 0] = 0.0
    enter = np.zeros((n, kinds))
    for i in range(n):
        alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i])
        if at[i] < at[i + 1]:
            own = slice(at[i], at[i + 1])
            enter[i] = _lse(alpha[i][:, None] + trans, 0)
            alpha[ends[own], 1:] = np.logaddexp(alpha[ends[own], 1:], enter[i] + score[own])
    beta = np.zeros((n + 1, kinds + 1))
    share, used = np.zeros_like(score), np.zeros_like(trans)
    total = float(_lse(alpha[n], 0))
    for i in range(n - 1, -1, -1):
        beta[i] = beta[i + 1]
        if at[i] < at[i + 1]:
            own = slice(at[i], at[i + 1])
            after = score[own] + beta[ends[own], 1:]
            share[own] = np.exp(np.minimum(enter[i] + after - total, 0))
            leave = trans + _lse(after, 0)
            used += np.exp(np.minimum(alpha[i][:, None] + leave - total, 0))
            beta[i] = np.logaddexp(beta[i], _lse(leave, 1))
    return total, share, used


def best(n: int, segs: list[tuple[int, int]], score: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (i, j, kind); segs in the order of starts, score: segment by kind. Ties go to no entity, then the first."""
    if not segs:
        return []
    at, ends = _ranges(n, segs)
    value = np.full((n + 1, trans.shape[1] + 1), -np.inf)
    value[0, 0] = 0.0
    back = np.full(value.shape, -1, np.int64)
    came: dict[int, np.ndarray] = {}
    starts = np.flatnonzero(at[1:] > at[:-1])
    done = 0
    for i in starts:
        _settle(value, back, done, i)
        done = i
        ways = value[i][:, None] + trans
        came[i] = ways.argmax(axis=0)
        enter = ways.max(axis=0)
        for k in range(at[i], at[i + 1]):
            new = enter + score[k]
            better = new > value[ends[k], 1:] + 1e-12
            value[ends[k], 1:][better] = new[better]
            back[ends[k], 1:][better] = k
    _settle(value, back, done, n)
    out, j, state = [], n, int(value[n].argmax())
    while j > 0:
        k = back[j, state]
        if k < 0:
            j -= 1
        else:
            out.append((*segs[k], state - 1))
            j = segs[k][0]
            state = int(came[j][state - 1])
    return out[::-1]


def _settle(value: np.ndarray, back: np.ndarray, a: int, b: int) -> None:
    """Carry the best values on from token to token, where no entity ends that does better."""
    for j in range(a + 1, b + 1):
        stay = value[j - 1] >= value[j] - 1e-12
        value[j][stay] = value[j - 1][stay]
        back[j][stay] = -1


def sentences(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made-up training sentences with their true spans, and look-alikes that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randrange(2, 9)))

    def card(good: bool) -> str:
        k = r.choice((14, 15, 16, 16, 16, 19))
        body = r.choice("23456789") + num(k - 2)
        last = next(c for c in "0123456789" if luhn(body + c))
        if not good:
            last = str((int(last) + r.randrange(1, 10)) % 10)
        s, sep = body + last, r.choice(("", "", "", " ", "-"))
        return sep.join(s[i : i + 4] for i in range(0, k, 4)) if sep else s

    def entity(kind: str) -> str:
        if kind == "email":
            user, host = r.choice((word(), f"{word()}.{num(2)}", f"{word()}_{word()}")).replace("é", "e"), word().replace("é", "e")
            at, dot = r.choice((("@", "."), ("@", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)")))
            return f"{user}{at}{host}{dot}{r.choice(('com', 'org', 'example.com'))}"
        if kind == "ip":
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if kind == "card":
            return card(True)
        if kind == "phone":
            return r.choice((f"+{r.randrange(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(11)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{r.randrange(1, 99)} {num(3)} {num(3)} {num(4)}"))
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))

    def decoy() -> str:
        return r.choice((
            f"{r.randrange(1900, 2100)}", f"{r.randrange(1, 31)}/{r.randrange(1, 13)}/{r.randrange(1990, 2030)}", f"{r.randrange(1990, 2030)}-{r.randrange(10, 13)}-{r.randrange(10, 30)}",
            f"version {r.randrange(9)}.{r.randrange(9)}", f"{r.randrange(9)}.{r.randrange(9)}.{r.randrange(9)}", f"{num(3)},{num(3)}", f"${num(2)}.{num(2)}", card(False), num(r.randrange(1, 12)),
            f"{r.randrange(256, 999)}.{r.randrange(256, 999)}.{num(2)}.{num(3)}", f"{word()} at {word()}", f"at {num(2)}:{num(2)}", f"@{word()}", f"no {num(r.randrange(2, 13))}", f"{num(4)} {num(4)} {num(3)}",
        ))

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            text += " ".join(word() for _ in range(r.randrange(1, 4))) + " "
            if r.random() < 0.5:
                text += decoy() + r.choice((" ", ", ", ". "))
                continue
            kind = r.choice(KINDS)
            quoted = kind == "secret"
            if quoted or r.random() < 0.4:
                text += r.choice(CUES[kind]) + (' = "' if quoted else r.choice((" ", ": ")))
            s = entity(kind)
            spans.append((len(text), len(text) + len(s), kind))
            text += s + ('" ' if quoted else r.choice((" ", ", ", ". ", "\n")))
        out.append((text + word(), spans))
    return out


@lru_cache(2)
def trained(n: int = SENTENCES, seed: int = 11, epochs: int = EPOCHS) -> Weights:
    """Weights by stochastic gradient ascent on the log likelihood of made-up sentences."""
    w, trans = np.zeros((FEATURES, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS)))
    square, square_t = np.full_like(w, 1e-2), np.full_like(trans, 1e-1)
    data = []
    for text, spans in sentences(n, seed):
        toks = tokens(text, 0, len(text))
        segs = segments(text, toks)
        if not segs:
            continue
        x = np.array([features(text, toks[i][0], toks[j - 1][1]) for i, j in segs])
        where = {(toks[i][0], toks[j - 1][1]): k for k, (i, j) in enumerate(segs)}
        gold = [(where[a, b], KINDS.index(kind)) for a, b, kind in spans if (a, b) in where]
        data.append((len(toks), segs, x, gold))
    for epoch in range(epochs):
        rate = 0.5 / (1 + 0.1 * epoch)
        for n_tok, segs, x, gold in data:
            _, share, used = _sums(n_tok, segs, x @ w, trans)
            before = 0
            for k, kind in gold:
                share[k, kind] -= 1
                used[before, kind] -= 1
                before = kind + 1
            g, g_t = x.T @ share + 1e-3 * w, used + 1e-2 * trans
            square += g * g
            square_t += g_t * g_t
            w -= rate * g / np.sqrt(square)
            trans -= 0.2 * rate * g_t / np.sqrt(square_t)
    return w, trans


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of LONGEST tokens on either side of a digit, an at-sign or a spelt-out address, that end at line ends at the latest.

    Outside them no segment can be an entity, and none reaches out of one, so the whole
    text's best segmentation is that of its windows. A stretch begins and ends where a token does, however long that is.
    """
    hot = [m.span() for m in _HOT.finditer(text)]
    if "dot" in text or "DOT" in text:
        hot = sorted(hot + [m.span() for m in _SPELT.finditer(text)])
    out: list[tuple[int, int]] = []
    h = low = 0
    while h < len(hot):
        start = end = _back(text, hot[h][0], low) if hot[h][0] > low else low
        reach, left = start, 1
        for m in _TOKEN.finditer(text, start):
            while h < len(hot) and hot[h][0] < m.end():
                reach, h = max(reach, hot[h][1]), h + 1
            if m.end() <= reach or m.start() < reach or not h:
                left = LONGEST + 1
            elif "\n" in m.group():
                break
            elif reach > start:
                left -= 1
            end = m.end()
            if not left:
                break
        out.append((start, end))
        low = end
    return out


def _back(text: str, at: int, low: int) -> int:
    """The start of the stretch of LONGEST tokens that ends at `at`, or beyond the last line end before; low at the least."""
    kind = lambda c: "s" if c.isspace() else "_" if c == "_" else "w" if c.isalnum() else "" if not c.isidentifier() and not ("a" + c).isidentifier() else "w"
    count, last = 0, None
    while at > low:
        c = text[at - 1]
        now = kind(c)
        if now == "s" and c == "\n":
            break
        if not now or now != last:
            count += 1
            if count > LONGEST + 1:
                break
        last = now
        at -= 1
    return at


def added_spans(text: str, weights: Weights) -> list[Span]:
    """The field's entities in the whole text.

    Segments that can't be part of a best segmentation, whatever stands around them, are left out as soon as they are scored, so
    memory follows the tokens and STARTS.
    """
    w, trans = weights
    toks = [t for a, b in windows(text) for t in tokens(text, a, b)]
    # the most that a kind can gain by what stood before it, and by what may come after it
    gain = trans.max(axis=0) + np.maximum((trans[1:, None, :] - trans[None, :, :]).max(axis=(1, 2)), 0)
    kept: list[tuple[int, int]] = []
    scores: list[np.ndarray] = []
    for first in range(0, len(toks), STARTS):
        segs = segments(text, toks, first, min(first + STARTS, len(toks)))
        if segs:
            score = np.array([features(text, toks[i][0], toks[j - 1][1]) for i, j in segs]) @ w
            good = np.flatnonzero((score + gain > 0).any(axis=1))
            kept += [segs[k] for k in good]
            scores.append(score[good])
    if not kept:
        return []
    return [(toks[i][0], toks[j - 1][1], KINDS[kind]) for i, j, kind in best(len(toks), kept, np.concatenate(scores), trans)]


def all_spans(text: str, weights: Weights, base: list[Span] | None = None) -> list[Span]:
    """Base spans, and those of the field that overlap none of them."""
    base = base_spans(text) if base is None else base
    starts, reach = [s[0] for s in base], [0, *accumulate((s[1] for s in base), max)]
    return ordered(base + [s for s in added_spans(text, weights) if reach[bisect_left(starts, s[1])] <= s[0]])


def find(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Spans of every whole text: (doc_id, base, spans), each an array of (start, stop, kind) in code points.

    A null text counts as empty and has none. Repeated rows are each searched. Other columns are
    ignored. Memory follows one text and its spans. A text without digits and at-signs costs two searches.
    """
    w = trained() if weights is None else weights
    kind = dict(docs.dtypes)["doc_id"]
    shape = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
    row = lambda spans: [{"start": a, "stop": b, "kind": k} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            base = [base_spans(t or "") for t in b.column("text").to_pylist()]
            full = [all_spans(t or "", w, s) for t, s in zip(b.column("text").to_pylist(), base, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([row(s) for s in base], shape), pa.array([row(s) for s in full], shape)], ["doc_id", "base", "spans"])

    spans = "array<struct<start:int,stop:int,kind:string>>"
    return only(bounded_batches(docs), "doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")
