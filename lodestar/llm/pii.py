"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Five kinds of span: email, ip, card, phone, and secret (keys, tokens, passwords). The base patterns of the first four are
certain: their spans (leftmost, not overlapping within a kind) always stay. Wider generators propose further spans, which
may overlap each other: obfuscated e-mail addresses ("name (at) host dot org"), IP addresses with spaced dots, card numbers
with other separators, phone numbers without a plus sign, long runs of mixed characters and whatever is assigned to a name
that sounds secret. Gradient-boosted trees score each proposal by its format (digit counts, grouping, checksum,
separators, entropy) and its context (words and characters around it); a proposal is added if its calibrated probability
reaches the threshold of its kind and it overlaps neither a base span nor a better proposal.

The trees are trained here, on generated sentences with a fixed seed. Half of the sentences of either label use cue words
that the features do not know, so that the trees cannot rest on those alone; among the negatives are ordinary rows of
numbers, years, dates, scores, prices and measures. Probabilities are calibrated on other sentences, and each kind's
threshold is the least with a precision of PRECISION on a third set, whose cue words and formats are partly met in
neither of the others, but never below LEAST. What they give on sentences that no generator made is in the tests.

Offsets count code points, ends are exclusive. Scanning is linear: every pattern is anchored at a character run's start
or at an '@' or '+', and takes runs as a whole.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Trees, boost, calibrate
from .common import blocks, narrow, raw_parts

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
BLOCK_BYTES = 1 << 20
#: What a kind's threshold must give on held-out proposals.
PRECISION = 0.98
#: No proposal that is less likely than this is redacted.
LEAST = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CLUE = re.compile(r"[0-9@+]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")

WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,}+)++", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/ -]{1,2}[0-9]{2,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:00[ -]?[0-9]{1,3}[ ./-]?)?\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_.-]{16,}+=*+"),
}
_NAMED = re.compile(r"(?<![A-Za-z_-])(?:[A-Za-z]++[_-])*+(?:token|key|secret|password|passwd|pwd|auth|bearer)['\"]?+ ?[:=] ?(['\"]?+)([^\s'\",;]{6,}+)", re.I)
_OBFUSCATED = re.compile(r"(?:\(|\[| )(?:at|dot)(?:\)|\]| )", re.I)
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "pay", "credit", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer"),
}
AGAINST = ("version", "section", "isbn", "page", "date", "release", "chapter", "id", "part", "no", "commit", "sha", "md5", "checksum", "path", "file", "uuid")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """What the base patterns match, by kind; matches that fail their test are dropped and not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _CLUE.search(text):
        return out
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out["email"].append((start, end))
        else:
            end = max(end, at + 1) if start == at else end
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """What the wide generators propose: (kind, start, end), overlaps and all. A generator is left out only where it
    can match nothing: without a digit, or without any of the marks that can stand for an '@'."""
    digits = bool(_DIGIT.search(text))
    out = []
    for kind in KINDS:
        if digits if kind != "email" else "@" in text or _OBFUSCATED.search(text):
            out += [(kind, *m.span()) for m in WIDE[kind].finditer(text)]
    secrets = set()
    if digits:
        secrets = {m.span() for m in WIDE["secret"].finditer(text) if _DIGIT.search(s := m.group()) and _LETTER.search(s)}
    if "=" in text or ":" in text:
        secrets |= {m.span(2) for m in _NAMED.finditer(text)}
    return out + [("secret", a, b) for a, b in sorted(secrets)]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    s = text[start:end]
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    d = _digits(s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    words = re.findall(r"[a-z-]+", before.lower())[-3:]
    separators = {c for c in s if not c.isalnum()}
    parts = [g for g in re.split(r"[^0-9]+", s) if g]
    return [
        float(ALL_KINDS.index(kind)),
        len(s),
        len(d),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        float(luhn(d)) if len(d) >= 12 else -1.0,
        len(separators),
        float(all(map(_byte, parts))),
        float(bool(re.search(r"[([]\s*(?:at|dot|\.)\s*[)\]]", s, re.I))),
        float(bool(re.search(r"@", s))),
        float(bool(re.search(r" (?:at|dot) ", s, re.I))),
        float(any(w.startswith(c) for w in words for c in CUES[kind])),
        float(any(w == c for w in words for c in AGAINST)),
        float(before[-1:].isalnum() or before[-1:] in ".-/_+"),
        float(after[:1].isalnum() or after[:1] in "-/_"),
        float(s[:1] == "(" or s[:2] == "00"),
        float(bool(re.fullmatch(r"(?:19|20)\d\d.\d\d?.\d\d?.*|\d\d?.\d\d?.(?:19|20)\d\d.*", s))),
        _entropy(s),
        len(d) / len(s),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
        float(bool(re.search(r"[:=]\s?['\"]?$", before))),
        float(before[-1:] in "'\"" and before != ""),
        float(sum(a.islower() != b.islower() for a, b in pairwise(s))) / len(s),
        max((len(w) for w in re.findall(r"[a-z]+", s)), default=0),
        float(s.count("/") + s.count(".")),
        float(before.lower().endswith(("bearer ", "basic "))),
    ]


#: Cue words of generated sentences that the features do not list, by kind; the last ones only in the held-out set.
OTHER_CUES = {
    "email": ["reach", "inbox", "send", "reply", "correspondence", "ping", "postbox"],
    "ip": ["gateway", "node", "subnet", "peer", "router", "ping", "endpoint"],
    "card": ["plastic", "charge", "billing", "holder", "checkout", "mastercard", "debit"],
    "phone": ["ring", "line", "reach", "sms", "hotline", "desk", "switchboard"],
    "secret": ["credential", "login", "signing", "webhook", "sas", "passphrase", "pin"],
}


def _templates(rng: random.Random, n: int, held_out: bool = False) -> list[tuple[str, str, int]]:
    """(text, kind, label) with one proposal of interest each; the first span that the kind's generator finds counts."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 8)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    run = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def cue(kind: str) -> str:
        other = rng.choice(OTHER_CUES[kind][-2:] if held_out else OTHER_CUES[kind][:-2])
        return rng.choice([rng.choice(CUES[kind]) + rng.choice(["", ":"]), other + rng.choice(["", ":", " " + word()])])

    def card(ok: bool) -> str:
        while True:
            d = rng.choice("3456") + num(15)
            if luhn(d) == ok:
                return d

    def secret() -> str:
        kinds = [run(hexa, rng.choice([32, 40, 64])), run(mixed, rng.randint(20, 44)), run(mixed + "+/", rng.randint(24, 60)) + rng.choice(["", "=", "=="]), "AK" + run(mixed[:26] + mixed[52:], 18)]
        kinds += [run(mixed, 8) + "." + run(mixed, 30) + "." + run(mixed + "_-", 24)] if held_out else [rng.choice(["gp_", "sk-", "xx-"]) + run(mixed, rng.randint(24, 40))]
        return rng.choice(kinds)

    out = []
    for _ in range(n):
        host, tld = word(), rng.choice(["com", "org", "net", "de", "fr"])
        style = rng.choice([("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", ".")])
        out.append((f"{word()} {rng.choice([cue('email'), word()])} {word()}.{word()}{style[0]}{host}{style[1]}{tld} {word()}", "email", 1))
        out.append((f"{word()} {cue('email')} {word()} at {host} dot {tld} {word()}", "email", 1))
        out.append((f"{word()} {word()} at {host}.{word()} {word()}", "email", 0))
        out.append((f"{word()} {word()} at {host} dot {word()} {word()}", "email", 0))
        ip = [str(rng.randint(1, 255)) for _ in range(4)]
        out.append((f"{word()} {rng.choice([cue('ip'), word()])} {rng.choice(['[.]', '(.)']).join(ip)} {word()}", "ip", 1))
        out.append((f"{word()} {rng.choice(AGAINST)} {' . '.join(str(rng.randint(0, 999)) for _ in range(4))} {word()}", "ip", 0))
        out.append((f"{word()} {word()} {'. '.join(str(rng.randint(0, 40)) for _ in range(4))} {word()}", "ip", 0))
        good, bad, sep = card(True), card(False), rng.choice([".", "_", "/", " "])
        out.append((f"{word()} {rng.choice([cue('card'), word()])} {sep.join(good[i : i + 4] for i in (0, 4, 8, 12))} {word()}", "card", 1))
        out.append((f"{word()} {rng.choice([cue('card'), word()])} {sep.join(bad[i : i + 4] for i in (0, 4, 8, 12))} {word()}", "card", 0))
        out.append((f"{word()} {rng.choice(AGAINST)} {num(4)}-{num(2)}-{num(2)} {word()}", "card", 0))
        phone = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0049 {num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])
        out.append((f"{word()} {cue('phone')} {phone} {word()}", "phone", 1))
        out.append((f"{word()} {rng.choice(AGAINST)} {rng.choice([phone, f'{num(2)}.{num(2)}.{num(4)}', f'{num(4)}-{num(2)}-{num(2)}', f'{num(3)} {num(2)} {num(3)}'])} {word()}", "phone", 0))
        out.append((f"{word()} {word()} {rng.choice([f'{num(2)}.{num(2)}.20{num(2)}', f'19{num(2)}-{num(2)}-{num(2)}', f'{num(3)} {num(3)} {num(3)}', f'{num(2)}/{num(2)}/{num(2)}'])} {word()}", "phone", 0))
        for _ in range(3):
            k, row, sep = rng.randint(3, 7), rng.randint(1, 4), rng.choice([" ", " ", "-", "/", ", ", " - ", "."])
            rows = [[num(row) for _ in range(k)], [str(rng.randint(1, 9) * 10**row * (i + 1)) for i in range(k)], [rng.choice(["19", "20"]) + num(2) for _ in range(k)], [f"{num(rng.randint(1, 3))}.{num(2)}" for _ in range(k)], [str(rng.randint(10, 30)) for _ in range(k)], [num(rng.randint(1, 4)) for _ in range(k)]]
            lead = rng.choice([word(), word(), rng.choice(AGAINST), rng.choice(["results", "years", "scores", "cost", "prices", "total", "sizes", "rows", "steps", "match", "values", "table", "figures"])])
            out.append((f"{word()} {lead} {sep.join(rng.choice(rows))} {word()}", rng.choice(["phone", "phone", "card"]), 0))
        out.append((f"{word()} {word()} {rng.choice([' . ', '. ', ' .']).join(str(rng.randint(0, 255)) for _ in range(4))} {word()}", "ip", 0))
        quote, name = rng.choice(["'", '"', ""]), cue("secret").rstrip(":").replace(" ", "_")
        out.append((f"{word()} {name}{rng.choice([' = ', '=', ': ', ':'])}{quote}{secret()}{quote} {word()}", "secret", 1))
        out.append((f"{word()} {rng.choice(['bearer', 'basic'])} {secret()} {word()}", "secret", 1))
        plain = [run(hexa, 40), f"{run(hexa, 8)}-{run(hexa, 4)}-{run(hexa, 4)}-{run(hexa, 12)}", f"/{word()}/{word()}{num(1)}.{num(2)}/{word()}-{word()}", f"{word()}_{num(4)}_{word()}_{word()}", f"{word()}{word()}{word()}{num(2)}{word()}", f"{word()}.{word()}.{word()}/{word()}/{num(5)}.{word()}"]
        out.append((f"{word()} {rng.choice([rng.choice(AGAINST), word()])} {rng.choice(plain)} {word()}", "secret", 0))
        out.append((f"{word()} {word()}{rng.choice([' = ', ': '])}{quote}{rng.choice(plain[1:])}{quote} {word()}", "secret", 0))
    return out


def _described(seed: int, n: int, held_out: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of the proposals of interest in generated sentences."""
    rows = []
    for text, kind, label in _templates(random.Random(seed), n, held_out):
        if spans := [p for p in proposals(text) if p[0] == kind]:
            rows.append((describe(text, *max(spans, key=lambda p: p[2] - p[1])), label, kind))
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), [r[2] for r in rows]


class Model:
    """The trees, and from which probability on a proposal of each kind is redacted."""

    def __init__(self, trees: Trees, x: np.ndarray, y: np.ndarray, kinds: list[str]) -> None:
        self.trees, self.threshold, self.precision, self.recall = trees, {}, {}, {}
        p = trees.probability(x)
        for kind in ALL_KINDS:
            own = np.array([k == kind for k in kinds])
            order = np.argsort(-p[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            enough = np.flatnonzero((right >= PRECISION) & (np.append(np.diff(p[own][order]), -1) < 0))
            last = enough[-1] if len(enough) else -1
            # midway to the next proposal, so that a figure in the middle of a gap decides
            below = p[own][order][last + 1] if 0 <= last < own.sum() - 1 else 0.0
            self.threshold[kind] = max(LEAST, float((p[own][order][last] + below) / 2)) if last >= 0 else 1.1
            chosen = p[own] >= self.threshold[kind]
            self.precision[kind] = float(y[own][chosen].mean()) if chosen.any() else 1.0
            self.recall[kind] = float(y[own][chosen].sum() / max(1, y[own].sum()))


@lru_cache(maxsize=4)
def trained(seed: int = 11, n: int = 250) -> Model:
    """The trees, trained on generated sentences, calibrated on others; thresholds from a third, held-out set."""
    x, y, _ = _described(seed, n)
    cx, cy, _ = _described(seed + 1, n)
    return Model(calibrate(boost(x, y), cx, cy), *_described(seed + 2, n, True))


def find(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, float]]]:
    """The base spans by kind, and the added spans with their probabilities."""
    base = base_spans(text)
    wide = proposals(text)
    if wide:
        wide = _apart(wide, sorted(s for spans in base.values() for s in spans))
    if not wide:
        return base, []
    p = model.trees.probability(np.array([describe(text, *w) for w in wide], float))
    out: list[tuple[str, int, int, float]] = []
    covered = np.zeros(len(text), bool) if len(wide) > 1 else None
    for i in sorted(range(len(wide)), key=lambda i: (-p[i], wide[i][1], ALL_KINDS.index(wide[i][0]))):
        kind, a, b = wide[i]
        if p[i] >= model.threshold[kind] and (covered is None or not covered[a:b].any()):
            if covered is not None:
                covered[a:b] = True
            out.append((kind, a, b, float(p[i])))
    return base, out


def _apart(wide: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The proposals that overlap no base span, by binary search."""
    if not taken:
        return wide
    starts = [a for a, _ in taken]
    furthest = np.maximum.accumulate([b for _, b in taken])
    return [w for w in wide if (k := int(np.searchsorted(starts, w[2]))) == 0 or furthest[k - 1] <= w[1]]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])))


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id; n_email, n_ip, n_card, n_phone (base spans); base (the base spans as
    kind:start:end, comma-joined by kind, then start); spans (base and added ones, likewise, secrets last); n_added;
    redacted (the text with every span replaced by its kind in brackets). Very long texts are searched whole; other
    columns of docs, whatever their names, are not looked at. A null text counts as empty; null ids and repeated rows
    stay as they are; an empty table gives an empty result."""
    trees = docs.sparkSession.sparkContext.broadcast(trained())

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            for at, end in blocks(raw_parts(batch["raw"])[1], BLOCK_BYTES):
                part = batch.slice(at, end - at)
                counts, base_out, all_out, n_added, redacted = [], [], [], [], []
                for raw in part["raw"].to_pylist():
                    text = raw.decode("utf-8", "replace")
                    base, added = find(text, model)
                    counts.append([len(base[k]) for k in KINDS])
                    certain = [(k, a, b) for k in KINDS for a, b in base[k]]
                    every = certain + [x[:3] for x in added]
                    base_out.append(_joined(certain))
                    all_out.append(_joined(every))
                    n_added.append(len(added))
                    redacted.append(redact(text, every) if every else text)
                columns = np.array(counts, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(columns[:, i].copy()) for i in range(4)], pa.array(base_out, pa.string()), pa.array(all_out, pa.string()), pa.array(n_added, pa.int64()), pa.array(redacted, pa.string())], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans", "n_added", "redacted"]
    return narrow(docs).mapInArrow(f, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long, redacted string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])

