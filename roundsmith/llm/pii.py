"""Personal data: base patterns, and a skip-chain conditional random field for further mentions.

Base spans come from patterns and checks alone and always stay. The field labels candidate tokens as no
data, email, ip, card, phone, secret (a credential) or name. Candidates are the white-space tokens with a
digit, @ or +, those of 20 and more letters without a break, and, where a text has an email address, words
that are its mailbox name or, with a capital, a part of it. Neighbouring candidates share a transition
potential. Distant candidates share a skip potential, learned for each of three kinds of likeness:

- same: the same digits, four numbers, mailbox name or credential;
- written: a base number and the tokens of a number written otherwise that ends in the same digits;
- part: a mailbox name and a word that is a part of it.

Tokens of base spans are observed; loopy message passing carries labels along the skip edges, so that a
bare credential, a surname or a local number takes the label of its like elsewhere in the document. A token
becomes a span where its belief is at least BELIEF. Tokens that are no candidates are fixed to no data.
The potentials are fitted together by pseudo-likelihood, on made-up texts with known data (pii_examples)
and on a bounded sample of documents, with base spans and assigned credentials as labels and unlabelled
likes of these left out. The base patterns themselves are no features.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from roundsmith.llm import chain_crf, pii_examples as made, storage, textkit

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans, in the order in which they are listed.
ALL_KINDS = (*KINDS, "secret", "name")
N_LABELS = 1 + len(ALL_KINDS)
EMAIL, IP_KIND, CARD_KIND, PHONE_KIND, SECRET, PERSON = range(1, N_LABELS)
#: Whole documents, and bytes of all of them, that the field is fitted on; made-up texts beside them.
SAMPLE_DOCS, SAMPLE_BYTES, MADE = 1500, 16 << 20, 2500
BELIEF, ROUNDS, DAMPING, SETTLED = 0.9, 60, 0.3, 1e-3
SAME, WRITTEN, PART = range(3)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@+]|[A-Za-z_]{20}")
NUMERIC, GAP = re.compile(r"[+0-9().,/-]+"), re.compile(r"[\s().,/–-]{1,3}")
EDGE = re.compile(r"^[^0-9A-Za-z+(*]+|[^0-9A-Za-z)]+$")
NAMELIKE, PIECE = re.compile(r"[^\W\d_][\w.%+-]*"), re.compile(r"[^\W\d_]{2,}")
VALUE = re.compile(r"[A-Za-z0-9_/+.=-]{11,}[A-Za-z0-9_/+=-]")
ASSIGNED = re.compile(r"(?i)(?:\b|_)(?:" + "|".join(sorted(made.SECRET_WORDS)) + r")[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_/+.=-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As leftmost matches of local@domain.domain: each @ takes what local part is left before it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def mailboxes(text: str, base: list[tuple[int, int, int]]) -> tuple[set[str], dict[str, set[str]]]:
    """Mailbox names of a text's addresses, and the parts of those that have two and more, each with its names."""
    names: set[str] = set()
    parts: dict[str, set[str]] = {}
    for s, kind, e in base:
        if kind == 0:
            name = text[s : text.index("@", s)].casefold()
            if len(name) >= 4:
                names.add(name)
            own = PIECE.findall(name)
            if len(own) >= 2:
                for p in own:
                    parts.setdefault(p, set()).add(name)
    return names, parts


def candidates(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """The tokens that can be data, in order and without overlap."""
    out, last = [], 0
    for m in MARK.finditer(text):
        if m.start() < last:
            continue
        s, e = m.start(), m.end()
        while s > last and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        out.append((s, e))
        last = e
    names, parts = mailboxes(text, base) if base else ((), {})
    if not names and not parts:
        return out
    more, k = [], 0
    for m in NAMELIKE.finditer(text):
        own = m[0].rstrip(".%+-")
        key = own.casefold()
        if key in names or key in parts and own[0].isupper():
            s, e = m.start(), m.start() + len(own)
            while k < len(out) and out[k][1] <= s:
                k += 1
            if k == len(out) or e <= out[k][0]:
                more.append((s, e))
    return sorted(out + more)


FEATURES = (
    "bias", "at", "at and dot", "plus", "paren", "hyphen", "dots 1", "dots 3", "letters", "hex", "quoted", "only digits", "checksum", "near", "near number",
    *(f"digits {k}" for k in ("0", "1-2", "3-4", "5-7", "8-11", "12-15", "16", "17-")), "long", "symbols",
    "secret word", "assigned", "phone word", "mail word", "card word", "host word", "title", "mixed", "masked digits", "capital word", "mailbox", "near capital", "four numbers", "secret word and value", "phone word and number",
)
_WORDS = (made.SECRET_WORDS, made.PHONE_WORDS, made.MAIL_WORDS, made.CARD_WORDS, made.HOST_WORDS, made.TITLE_WORDS)
MIXED = re.compile(r"[A-Za-z]+[0-9]+[A-Za-z]+[0-9]+")


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows of FEATURES for the candidates of a text, from the whole token and the words before it."""
    x = np.zeros((len(spans), len(FEATURES)))
    ends, capital = -2, False
    for k, (s, e) in enumerate(spans):
        raw = text[s:e]
        own = EDGE.sub("", raw)
        digits, letters = sum("0" <= c <= "9" for c in own), sum(c.isalpha() for c in own)
        row, dots = x[k], own.count(".")
        row[0] = 1
        row[1], row[2], row[3], row[4], row[5] = "@" in own, "@" in own and "." in own.rpartition("@")[2], own[:1] == "+", "(" in own or ")" in own, "-" in own
        row[6], row[7], row[8], row[9] = dots in (1, 2), dots == 3, letters > 0, letters and len(own) >= 16 and all(c in "0123456789abcdef" for c in own)
        row[10], row[11] = '"' in raw or "'" in raw, digits == len(own) > 0
        row[12] = 12 <= digits <= 19 and luhn("".join(c for c in own if "0" <= c <= "9"))
        row[13], row[14] = s == ends + 1, s == ends + 1 and x[k - 1][8] == 0
        row[15 + (0 if not digits else 1 if digits <= 2 else 2 if digits <= 4 else 3 if digits <= 7 else 4 if digits <= 11 else 5 if digits <= 15 else 6 if digits == 16 else 7)] = 1
        row[23], row[24] = len(own) > 24, any(c in "#$%&|<>" for c in raw)
        before = text[max(0, s - 40) : s].casefold()
        head = re.split(r"[=:]", raw, maxsplit=1)[0].casefold() if "=" in raw or ":" in raw else ""
        said = {w.strip(".,:;=()\"'") for w in [*before.split()[-2:], head]}
        for j, words in enumerate(_WORDS):
            row[(25, 27, 28, 29, 30, 31)[j]] = not said.isdisjoint(words)
        row[26] = before.rstrip(" \"'")[-1:] in ("=", ":") or bool(head)
        value = VALUE.search(raw[len(head) + 1 :] if head else raw)
        row[32] = bool(MIXED.search(own)) and len(own) >= 12
        row[33] = digits == 4 and ("**" in raw or "xx" in raw.casefold())
        word = not digits and letters == len(own) and own[:1].isupper()
        row[34], row[35] = word, own.casefold() == own and letters > 0 and not digits and "@" not in own
        row[36] = word and capital and 1 <= s - ends <= 2
        if capital and word and 1 <= s - ends <= 2:
            x[k - 1][36] = 1
        row[37] = len(re.findall("[0-9]{1,3}", own)) == 4 and len(own) <= 20
        row[38], row[39] = row[25] and value is not None and len(value[0]) >= 16, row[27] and 7 <= digits <= 15
        ends, capital = e, bool(word)
    return x


def skip_keys(token: str) -> list[str]:
    """What makes tokens the same: seven and more digits in order, four numbers, a mailbox name, a long value."""
    own = EDGE.sub("", token).casefold()
    digits = "".join(c for c in own if "0" <= c <= "9")
    name = own.partition("@")[0].rstrip(".")
    out = ["d" + digits] * (7 <= len(digits) <= 19) + ["m" + name] * (len(name) >= 4 and name[0].isalpha() and ("@" in own or all(c in LOCAL for c in name)))
    numbers = re.findall("[0-9]+", own) if len(own) <= 20 else []
    if len(numbers) == 4 and all(len(n) <= 3 for n in numbers):
        out.append("i" + ".".join(numbers))
    m = secret_value(token)
    return [*out, "s" + m[0]] if m and len(m[0]) >= 16 else out


def secret_value(token: str) -> re.Match | None:
    """The longest run of a token that can be a credential, what stands before = or : left out."""
    at = 0
    for m in re.finditer(r"[=:][\"']?(?=[A-Za-z0-9])", token):
        at = m.end()
        break
    found = [m for m in VALUE.finditer(token, at)]
    return max(found, key=lambda m: len(m[0])) if found else None


def nearest(places: list[int], k: int) -> set[int]:
    """Of some places in order the first, the last before k and the first after it."""
    i = bisect_left(places, k)
    return {places[0], places[max(0, i - 1)], places[min(i, len(places) - 1)]}


def similar(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of candidates (the last of a base number, elsewhere) that belong to one number in two ways of writing.

    Of numeric tokens side by side each sequence of 7 to 19 digits is compared, of other tokens each by
    itself: a card by all its digits, or the last four where the others are masked, a phone by its last seven and more, without leading zeros (of a
    trunk or exit code), as country and area may be left out. However often a number is there, a mention is linked with the first
    and the nearest of those that it fits, so pairs grow with the text and not with its square."""
    exact: dict[tuple[str, int], list[int]] = {}
    ends: dict[str, list[int]] = {}  # phones by each end of seven digits and more
    cards: dict[str, int] = {}
    taken, k = set(), 0

    def note(table: dict, key, at: int) -> None:
        own = table.setdefault(key, [])
        if not own or own[-1] != at:
            own.append(at)

    for s, kind, e in base:
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        own, j = [], k
        while j < len(spans) and spans[j][0] < e:
            own.append(j)
            j += 1
        taken.update(own)
        if kind >= 2:
            for raw in {text[s:e], text[s:e].replace("(0)", "")}:
                digits = "".join(c for c in raw if "0" <= c <= "9").lstrip("0")
                note(exact, (digits, kind), own[-1])
                if kind == 2:
                    cards.setdefault(digits[-4:], own[-1])
                for n in range(7, len(digits) + 1) if kind == 3 else ():
                    note(ends, digits[-n:], own[-1])
    if not exact:
        return []
    out, run, before = set(), [], -1
    for k, (s, e) in enumerate(spans):
        digits = "".join(c for c in text[s:e] if "0" <= c <= "9")
        if k in taken or not digits:
            run = []
            continue
        if digits in cards and ("**" in text[s:e] or "xx" in text[s:e].casefold()):
            out.add((cards[digits], k))
        plain = NUMERIC.fullmatch(EDGE.sub("", text[s:e]))
        if not plain or not run or before != k - 1 or not GAP.fullmatch(text, spans[k - 1][1], s):
            run = []
        run.append((k, digits if len(digits) < 20 else digits[-20:]))
        before = k if plain else -1
        held = ""
        for i, d in reversed(run):
            held = d + held
            if len(held) > 19:
                break
            own = held.lstrip("0")
            if len(own) < 7:
                continue
            fits = [exact.get((own, 2)), ends.get(own), *(exact.get((own[n:], 3)) for n in range(1, min(3, len(own) - 7) + 1))]
            for places in fits:
                if places:
                    out |= {(at, b) for at in nearest(places, k) for b in range(i, k + 1)}
        while run and sum(len(d) for _, d in run) > 19:
            run.pop(0)
    return sorted(out)


def label_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each candidate by the base spans it overlaps (the longest), 0 for none."""
    out, k = np.zeros(len(spans), np.int64), 0
    held: list[tuple[int, int, int]] = []
    for i, (s, e) in enumerate(spans):
        while k < len(base) and base[k][0] < e:
            held.append(base[k])
            k += 1
        held = [b for b in held if b[2] > s]
        if held:
            out[i] = 1 + max(held, key=lambda b: (min(e, b[2]) - max(s, b[0]), -b[1]))[1]
    return out


class SkipChainField:
    """Weights, transitions between neighbouring candidates, and a skip potential for each kind of likeness."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, skip: np.ndarray):
        self.w, self.trans, self.skip = w, trans, skip

    def beliefs(self, emit: np.ndarray, chain: np.ndarray, skips: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        """Label beliefs by loopy message passing over chain edges (pairs of rows) and skip edges (pairs
        and their kind). doc: the document of each row. A document's messages rest once they have settled,
        so its beliefs do not depend on the others; those that do not settle are damped more and more."""
        n, k = emit.shape
        m = len(chain) + len(skips)
        if not m:
            total = emit
        else:
            doc = np.zeros(n, np.int64) if doc is None else doc
            pots = np.concatenate([np.repeat(self.trans[None], len(chain), 0), self.skip[skips[:, 2]]])
            ends = np.concatenate([chain, skips[:, :2]])
            src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
            pot = np.concatenate([pots, pots.transpose(0, 2, 1)])
            msg, of = np.zeros((2 * m, k)), doc[src]
            back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
            live, damping = np.arange(2 * m), DAMPING
            total = emit.copy()
            for step in range(3 * ROUNDS):
                if step and step % ROUNDS == 0:
                    damping = (1 + damping) / 2
                new = chain_crf._lse((total[src[live]] - msg[back[live]])[:, :, None] + pot[live], 1)
                new -= new.max(axis=1, keepdims=True)
                new = damping * msg[live] + (1 - damping) * new
                moved = np.abs(new - msg[live]).max(axis=1)
                np.add.at(total, dst[live], new - msg[live])
                msg[live] = new
                busy = np.unique(of[live[moved > SETTLED]])
                live = live[np.isin(of[live], busy)]
                if not len(live):
                    break
            total = emit.copy()
            np.add.at(total, dst, msg)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def edges(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> tuple[list, list]:
    """Chain edges between neighbours with one or two characters between them; skip edges (with kind) from each
    token to the one before that is the same and to the first, between ways of writing, and from the first
    address with a mailbox name to the parts of that name (of many names with a part, the first and the nearest)."""
    chain = [(k - 1, k) for k in range(1, len(spans)) if spans[k][0] - spans[k - 1][1] <= 2]
    skips, last, head = set(), {}, {}
    for k, (s, e) in enumerate(spans):
        for key in skip_keys(text[s:e]):
            if key in last:
                skips.add((last[key], k, SAME))
                if head[key] != last[key]:
                    skips.add((head[key], k, SAME))
            last[key] = k
            head.setdefault(key, k)
    skips |= {(a, b, WRITTEN) for a, b in similar(text, spans, base)} if base else set()
    parts = mailboxes(text, base)[1] if base else {}
    # the first address of each name that has the part, in order
    named = {part: sorted({head["m" + name] for name in names if "m" + name in head}) for part, names in parts.items()}
    for k, (s, e) in enumerate(spans) if parts else ():
        own = text[s:e]
        if own[:1].isupper() and named.get(own.casefold()):
            skips |= {(at, k, PART) for at in nearest(named[own.casefold()], k)}
    return chain, sorted(skips)


def find_spans(texts: list[str], field: SkipChainField) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, each (start, kind, end) in order."""
    emits, chain, skips, docs, tokens, bases, n = [], [], [], [], [], [], 0
    for k, text in enumerate(texts):
        base = base_spans(text)
        own = candidates(text, base)
        bases.append(base), tokens.append((own, n))
        if own:
            emit = features(text, own) @ field.w
            seen = label_of(own, base)
            emit[seen > 0] = -30.0
            emit[np.flatnonzero(seen), seen[seen > 0]] = 30.0
            emits.append(emit), docs.append(np.full(len(own), k))
            c, s = edges(text, own, base)
            chain += [(n + a, n + b) for a, b in c]
            skips += [(n + a, n + b, kind) for a, b, kind in s]
            n += len(own)
    p = field.beliefs(np.concatenate(emits), np.array(chain, np.int64).reshape(-1, 2), np.array(skips, np.int64).reshape(-1, 3), np.concatenate(docs)) if n else np.zeros((0, N_LABELS))
    return [(base, sorted(base + spans_of(text, own, label_of(own, base), p[first : first + len(own)]))) for text, base, (own, first) in zip(texts, bases, tokens, strict=True)]


def spans_of(text: str, own: list[tuple[int, int]], seen: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans that beliefs add: sure tokens outside base spans; neighbours of one kind make one."""
    label, sure, more = p.argmax(axis=1), p.max(axis=1) >= BELIEF, []
    for k, (s, e) in enumerate(own):
        kind = int(label[k])
        if not kind or not sure[k] or seen[k]:
            continue
        raw = text[s:e]
        m = secret_value(raw) if kind == SECRET else None
        if m:
            s, e = s + m.start(), s + m.end()
        else:
            part = EDGE.sub("", raw)
            if not part:
                continue
            s += raw.find(part)
            e = s + len(part)
        if more and more[-1][1] == kind - 1 and more[-1][3] == k - 1 and s - more[-1][2] <= 2 and kind != SECRET:
            more[-1] = (more[-1][0], kind - 1, e, k)
        else:
            more.append((s, kind - 1, e, k))
    return [m[:3] for m in more]


def _labelled(text: str, known: list[tuple[int, int, int]] | None = None) -> tuple | None:
    """Features, labels, weights, chain and skip edges of a text's candidates. known: all its data; without
    it base spans and assigned credentials are the labels, and what is like them counts for nothing."""
    base = base_spans(text)
    own = candidates(text, base)
    if not own:
        return None
    chain, skips = edges(text, own, base)
    weight = np.ones(len(own))
    if known is not None:
        y = label_of(own, [(s, label - 1, e) for s, e, label in known])
    else:
        y = label_of(own, base)
        said = label_of(own, [(m.start(1), SECRET - 1, m.end(1)) for m in ASSIGNED.finditer(text)])
        y = np.where(y, y, said)
        for a, b, _ in skips:
            weight[[k for k in (a, b) if not y[k]]] *= 0.0 if y[a] or y[b] else 1.0
    return features(text, own), y, weight, chain, skips


def train(parts: list[tuple], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> SkipChainField:
    """Maximum pseudo-likelihood of all potentials together, by Adam from zero: each token given the labels
    of its neighbours. The same parts give the same field."""
    x, y, weight = (np.concatenate([p[c] for p in parts]) for c in range(3))
    first = np.cumsum([0, *(len(p[1]) for p in parts)])
    chain = np.array([(f + a, f + b) for f, p in zip(first, parts) for a, b in p[3]], np.int64).reshape(-1, 2)
    skips = np.array([(f + a, f + b, kind) for f, p in zip(first, parts) for a, b, kind in p[4]], np.int64).reshape(-1, 3)
    one, total = np.eye(N_LABELS)[y], max(1.0, weight.sum())
    params = [np.zeros((x.shape[1], N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((3, N_LABELS, N_LABELS))]
    moments = [[np.zeros_like(p) for p in params] for _ in range(2)]
    a, b, c, d, kind = chain[:, 0], chain[:, 1], skips[:, 0], skips[:, 1], skips[:, 2]
    for step in range(1, rounds + 1):
        w, trans, skip = params
        score = x @ w
        np.add.at(score, b, trans[y[a]])
        np.add.at(score, a, trans.T[y[b]])
        np.add.at(score, d, skip[kind, y[c]])
        np.add.at(score, c, skip[kind, :, y[d]])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - one) * weight[:, None] / total
        grads = [x.T @ g + ridge * w, ridge * trans, ridge * skip]
        np.add.at(grads[1], y[a], g[b])
        np.add.at(grads[1].T, y[b], g[a])
        np.add.at(grads[2], (kind, y[c]), g[d])
        np.add.at(grads[2].transpose(0, 2, 1), (kind, y[d]), g[c])
        for q, grad, m, v in zip(params, grads, *moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SkipChainField(*params)


@lru_cache(1)
def _made_parts() -> list[tuple]:
    return [p for p in (_labelled(text, known) for text, known, _ in made.examples(MADE, 1)) if p]


def fit(docs: DataFrame | None = None) -> SkipChainField:
    """Fits the field on MADE made-up texts and on a sample of whole documents: of those with the least hash
    at most SAMPLE_DOCS, and SAMPLE_BYTES of text in all. Without documents the made-up texts are all."""
    parts = list(_made_parts())
    if docs is not None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        parts += [_labelled(r["text"]) for r in storage.sample(rows, SAMPLE_DOCS, SAMPLE_BYTES, total=docs.count())]
    field = train([p for p in parts if p])
    textkit.trim()
    return field


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as its kind in brackets; of spans that overlap the first one counts, and
    takes the others' reach."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{ALL_KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, field: SkipChainField, carry: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, masked for documents (doc_id, text).

    A null text is empty and has no spans; rows that repeat are judged each by itself; other columns are
    ignored, and with carry the whole row is handed on as the struct _row; an empty table gives no rows. Offsets are code points, ends exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = find_spans(texts, field)
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(len(KINDS))]
                sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]
                cols = [part.column(0), *counts, pa.array(sha), pa.array([joined(s) for _, s in got]), pa.array([masked(t, s) for t, (_, s) in zip(texts, got, strict=True)]), *([part.column(2)] if carry else [])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked", *(["_row"] if carry else [])])
        textkit.trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *([F.struct("*").alias("_row")] if carry else []))
    schema = T._parse_datatype_string("doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, masked string")
    return rows.mapInArrow(run, T.StructType([*schema.fields, *([rows.schema["_row"]] if carry else [])]))


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = storage.table(spark, sf_dir, "documents")
    return detect(docs, fit(docs)).drop("masked")
