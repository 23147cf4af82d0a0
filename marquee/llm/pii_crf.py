"""Personal data: patterns, and a semi-Markov conditional random field for what they miss.

The base spans of four kinds are told by fixed patterns and always stay. Next to them the model looks at
regions, stretches of text that could hold such data: chains of digit groups, and the surroundings of
at-marks, `@` or a spelled one. A region is a row of atoms (digit groups or words). Whole spans of atoms
are candidates and are scored by features of the whole span, such as the Luhn sum, the pattern of group
lengths or what separates the atoms; no label of a single atom could see these. A dynamic program over the
atoms, in which an entity has at most MAX_ATOMS atoms and MAX_DIGITS digits, chooses boundaries and kinds
of a region jointly. Atoms under base spans are blocked, so what is added never overlaps them.

The weights are fitted on regions of a bounded sample of documents: their base spans are the labels, as they
stand and rewritten into forms that the patterns don't know (bare and bracketed numbers, spelled marks,
numbers that run into others), beside the sample's other numbers and numbers that only look alike.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import batch, first_by_hash, tidy

KINDS = ("email", "ip", "card", "phone")
#: The longest entity; card numbers end at 19 digits.
MAX_ATOMS, MAX_DIGITS = 8, 19
#: What stands around an at-mark and may belong to an address.
AROUND = 80
#: The sample that the model is fitted on: documents by a hash of their id, regions of each, and characters of a region.
TRAIN_DOCS, TRAIN_REGIONS, TRAIN_CHARS, SEED = 6000, 1200, 160, 12

Span = tuple[str, int, int]

# base spans

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]++")


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    """From each @ back to where the local part starts, but not into the span before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[Span]:
    """Each four groups of a dotted chain in turn; those with a part over 255 are dropped, not retried."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, groups = m.start(), m[0].split(".")
        for k in range(0, len(groups) - 3, 4):
            end = at + len(".".join(groups[k : k + 4]))
            if all(map(_octet, groups[k : k + 4])):
                yield "ip", at, end
            at = end + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= MAX_DIGITS and luhn(digits):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PLUS.finditer(text):
        kept = m[0].rstrip(" ().-")
        if len(kept) > 3 and 10 <= sum("0" <= c <= "9" for c in kept) <= 15:
            yield "phone", m.start(), m.start() + len(kept)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, leftmost and not overlapping within a kind, in time linear in the text."""
    return ordered([*_emails(text), *_ips(text), *_cards(text), *_phones(text)])


# regions and atoms


class Region(NamedTuple):
    """Atoms by their starts and ends, and the mark before each: what separates it from the one before."""

    kinds: tuple[str, ...]
    starts: list[int]
    ends: list[int]
    marks: list[str]


_CHAIN = re.compile(r"[0-9]++(?:[ ().\-/\[\]]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]++")
_AT = re.compile(r"@|[\[({<] ?at ?[\])}>]| at ", re.IGNORECASE)
_TOKEN = re.compile(r" ?[\[({<] ?(?P<at>at|@) ?[\])}>] ?| ?(?P<sign>@) ?| (?P<bare_at>at) | ?[\[({<] ?(?P<dot>dot|\.) ?[\])}>] ?|(?P<point>\.)| (?P<bare_dot>dot) |(?P<word>[A-Za-z0-9_%+-]+)|(?P<gap>.)", re.IGNORECASE | re.DOTALL)


def _number_regions(text: str) -> Iterator[Region]:
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        starts, ends, marks, last = [], [], [], chain.start()
        for g in _GROUP.finditer(text, chain.start(), chain.end()):
            starts.append(g.start())
            ends.append(g.end())
            marks.append(text[last : g.start()])
            last = g.end()
        yield Region(KINDS[1:], starts, ends, marks)


def _address_regions(text: str) -> Iterator[Region]:
    """Words around at-marks; surroundings that meet are one region."""
    windows: list[list[int]] = []
    for m in _AT.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if windows and lo <= windows[-1][1]:
            windows[-1][1] = hi
        else:
            windows.append([lo, hi])
    for lo, hi in windows:
        starts, ends, marks, mark = [], [], [], ""
        for t in _TOKEN.finditer(text, lo, hi):
            if t.lastgroup == "word":
                starts.append(t.start())
                ends.append(t.end())
                marks.append(mark)
                mark = ""
            else:
                mark = t.lastgroup if not mark else "gap"
        if starts:
            yield Region(KINDS[:1], starts, ends, marks)


def regions(text: str) -> Iterator[Region]:
    yield from _number_regions(text)
    yield from _address_regions(text)


# candidate spans and their features


class Candidate(NamedTuple):
    first: int
    stop: int
    start: int
    end: int
    features: tuple[str, ...]


def _near(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "digit" if "0" <= c <= "9" else "letter" if c.isalpha() or c == "_" else c if c in ".,:+-/@#$%=" else "other"


def _number_features(text: str, start: int, end: int, groups: list[str], marks: list[str], whole: bool) -> tuple[str, ...]:
    digits = "".join(groups)
    between = {m.strip() or " " for m in marks}
    glue = "none" if not between else next(iter(between)) if len(between) == 1 else "round" if between <= {" ", "-", "(", ")", ")-", ") "} else "mixed"
    shape = "-".join(str(len(g)) for g in groups) if len(groups) < 6 else "long"
    checked = luhn(digits) if len(digits) > 11 else "short"
    octets = all(map(_octet, groups)) if len(groups) == 4 else "no"
    lead = "plus" if text[start] == "+" else "round" if text[start] == "(" else "zeros" if digits.startswith("00") else digits[0]
    around = "digit" if "digit" in (_near(text, start - 1), _near(text, end)) else "clear"
    return ("bias", f"n={len(groups)}", f"d={len(digits)}", f"glue={glue}", f"shape={shape}", f"d={len(digits)},luhn={checked}", f"octets={octets},glue={glue}", f"lead={lead}", f"lead={lead},d={len(digits)}", f"glue={glue},d={len(digits)}", f"left={_near(text, start - 1)}", f"right={_near(text, end)}", f"whole={whole}", around)


def _address_features(text: str, start: int, end: int, words: list[str], marks: list[str], whole: bool) -> tuple[str, ...] | None:
    ats = [k for k, m in enumerate(marks) if m in ("at", "sign", "bare_at")]
    if len(ats) != 1 or "gap" in marks or "" in marks:
        return None
    after = marks[ats[0] + 1 :]
    if not after:
        return None
    tail = words[-1]
    known = tail.isascii() and tail.isalpha() and 1 < len(tail) < 7
    dots = "+".join(sorted(set(after)))
    return ("bias", f"at={marks[ats[0]]}", f"dots={dots}", f"at={marks[ats[0]]},dots={dots}", f"tail={known}", f"parts={min(len(after), 4)}", f"local={min(ats[0], 3)}", f"localdots={'+'.join(sorted(set(marks[: ats[0]])))}", f"left={_near(text, start - 1)}", f"right={_near(text, end)}", f"pointleft={text[max(0, start - 1) : start] == '.'}", f"pointright={bool(re.match(r'\.[A-Za-z0-9]', text[end : end + 2]))}")


def candidates(text: str, region: Region, blocked: list[bool]) -> Iterator[Candidate]:
    """The spans of atoms first to stop that could be an entity; none has a blocked atom."""
    n, numbers = len(region.starts), region.kinds != KINDS[:1]
    atoms = [text[a:b] for a, b in zip(region.starts, region.ends)]
    for i in range(n):
        digits = 0
        for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
            if blocked[j - 1]:
                break
            start, end, marks = region.starts[i], region.ends[j - 1], region.marks[i + 1 : j]
            if not numbers:
                found = _address_features(text, start, end, atoms[i:j], marks, j - i == n)
            else:
                digits += len(atoms[j - 1])
                if digits > MAX_DIGITS:
                    break
                if digits < 7 and j - i != 4:
                    continue
                if start and text[start - 1] == "(" and ")" in "".join(marks):
                    start -= 1
                if start and text[start - 1] == "+":
                    start -= 1
                found = _number_features(text, start, end, atoms[i:j], marks, j - i == n)
            if found is not None:
                yield Candidate(i, j, start, end, found)


# the model


class Model(NamedTuple):
    """Weights by kind and feature, and by kind for following another entity directly."""

    weights: dict[tuple[str, str], float]
    follows: dict[str, float]


Scored = list[tuple[int, int, list[float]]]


def best_segmentation(n: int, spans: Scored, follows: list[float]) -> list[tuple[int, int, int]]:
    """(first, stop, kind) of the entities of the best segmentation of n atoms. An atom outside scores 0; of
    equal segmentations the one with fewer entities counts."""
    by_stop: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
    for first, stop, scores in spans:
        by_stop[stop].append((first, scores))
    # best[t][e]: score and way to have read t atoms, the last as part of an entity if e.
    best: list[list[tuple[float, tuple | None]]] = [[(0.0, None), (-math.inf, None)]]
    for t in range(1, n + 1):
        outside, entity = max(best[t - 1], key=lambda x: x[0])[0], (-math.inf, None)
        back = 0 if best[t - 1][0][0] >= best[t - 1][1][0] else 1
        for first, scores in by_stop[t]:
            for kind, s in enumerate(scores):
                for e in (0, 1):
                    total = best[first][e][0] + s + (follows[kind] if e else 0.0)
                    if total > entity[0]:
                        entity = (total, (first, e, kind))
        best.append([(outside, (t - 1, back, None)), entity])
    t, e, out = n, 0 if best[n][0][0] >= best[n][1][0] else 1, []
    while t:
        before, back, kind = best[t][e][1]
        if kind is not None:
            out.append((before, t, kind))
        t, e = before, back
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def marginals(n: int, spans: Scored, follows: list[float]) -> tuple[float, list[list[tuple[float, float]]]]:
    """The log partition, and for each span and kind its probability after an outside atom and after an entity."""
    by_stop: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, stop, _) in enumerate(spans):
        by_stop[stop].append(k)
    forward = [(0.0, -math.inf)]
    for t in range(1, n + 1):
        entity = -math.inf
        for k in by_stop[t]:
            first, _, scores = spans[k]
            o, e = forward[first]
            for kind, s in enumerate(scores):
                entity = _log_add(entity, s + _log_add(o, e + follows[kind]))
        forward.append((_log_add(*forward[t - 1]), entity))
    backward = [(-math.inf, -math.inf)] * n + [(0.0, 0.0)]
    by_first: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (first, _, _) in enumerate(spans):
        by_first[first].append(k)
    for t in range(n - 1, -1, -1):
        after_out = after_entity = backward[t + 1][0]
        for k in by_first[t]:
            _, stop, scores = spans[k]
            for kind, s in enumerate(scores):
                after_out = _log_add(after_out, s + backward[stop][1])
                after_entity = _log_add(after_entity, s + follows[kind] + backward[stop][1])
        backward[t] = (after_out, after_entity)
    total = _log_add(*forward[n])
    out = []
    for first, stop, scores in spans:
        o, e = forward[first]
        out.append([(math.exp(o + s + backward[stop][1] - total), math.exp(e + follows[kind] + s + backward[stop][1] - total)) for kind, s in enumerate(scores)])
    return total, out


Example = tuple[str, list[Span]]


def fit_examples(examples: list[Example], rounds: int = 60, rate: float = 0.3, decay: float = 0.002) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over all examples (text, entities) at once.
    Entities that are no candidate of a region are left out of its labels."""
    index: dict[tuple[str, str], int] = {}
    parts, rows, at = [], [], 0
    for text, gold in examples:
        for region in regions(text):
            found = list(candidates(text, region, [False] * len(region.starts)))
            if not found:
                continue
            own = {(s, e): k for k, s, e in gold if k in region.kinds}
            taken = [(c.first, c.stop, own.get((c.start, c.end))) for c in found]
            parts.append((region, found, taken, at))
            for c in found:
                for k in region.kinds:
                    rows.append([index.setdefault((k, f), len(index)) for f in c.features])
            at += len(found) * len(region.kinds)
    if not rows:
        return Model({}, dict.fromkeys(KINDS, 0.0))
    width = max(map(len, rows))
    # The last weight stays zero: it fills rows of fewer features.
    ids = np.array([r + [len(index)] * (width - len(r)) for r in rows])
    w, follows = np.zeros(len(index) + 1), np.zeros(len(KINDS))
    size = len(w) + len(KINDS)
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        score, slope, other = w[ids].sum(1), np.zeros(len(rows)), np.zeros(len(KINDS))
        for region, found, taken, a in parts:
            k, kinds = len(region.kinds), [KINDS.index(x) for x in region.kinds]
            spans = [(c.first, c.stop, score[a + i * k : a + i * k + k].tolist()) for i, c in enumerate(found)]
            _, p = marginals(len(region.starts), spans, follows[kinds].tolist())
            stops = {t[1] for t in taken if t[2]}
            for i, (first, _, kind) in enumerate(taken):
                for y in range(k):
                    real = region.kinds[y] == kind
                    slope[a + i * k + y] = real - sum(p[i][y])
                    other[kinds[y]] += (real and first in stops) - p[i][y][1]
        gradient = np.zeros(len(w))
        np.add.at(gradient, ids, slope[:, None])
        gradient[-1] = 0
        g = np.concatenate([gradient, other]) / len(parts) - decay * np.concatenate([w, follows])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        move[len(w) - 1] = 0
        w, follows = w + move[: len(w)], follows + move[len(w) :]
    return Model({k: float(w[i]) for k, i in index.items()}, dict(zip(KINDS, follows.tolist())))


# examples


def _rewritten(kind: str, span: str, rng: random.Random) -> list[tuple[str, str, str]]:
    """(before, entity, after): forms of an entity that the patterns don't find, or not in full."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        local, domain = span.split("@")
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), (" @ ", "."), ("@", "[.]"), ("[at]", "."), (" [at] ", " [dot] "), ("{at}", "{dot}")])
        return [("", local + at + domain.replace(".", dot), "")]
    if kind == "ip":
        return [("", span.replace(".", rng.choice(["[.]", "(.)", " . "])), ""), (f"{rng.randint(256, 999)}.", span, "")]
    if kind == "card":
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [("", rng.choice([".", "  ", "/", " - "]).join(four), ""), ("", rng.choice(["", " ", "-"]).join(four), f" {rng.randint(100, 999)}"), (f"{rng.randint(1, 99)} ", " ".join(four), "")]
    own = digits[-10:]
    a, b, c = own[:3], own[3:6], own[6:]
    return [("", rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"]), ""), ("", f"00{digits[:-10] or 1} {a} {b} {c}", ""), ("", f"1-{a}-{b}-{c}", "")]


def _alike(rng: random.Random) -> str:
    """Numbers and words that look like personal data and are none."""
    n = rng.randint
    return rng.choice([
        f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28):02}/{n(1, 12):02}/{n(1900, 2099)}", f"{n(1, 28):02}.{n(1, 12):02}.{n(1900, 2099)}", f"{n(1900, 2030)}-{n(1900, 2030)}", f"{n(0, 9)}.{n(0, 40)}.{n(0, 99)}",
        f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"{n(10**6, 10**9)}", f"{n(10**9, 10**13)}", f"{n(1, 999)} {n(100, 999)} {n(100, 999)}", f"{n(256, 999)}.{n(256, 999)}.{n(0, 255)}.{n(0, 999)}",
        f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}", f"{n(1900, 2099)} {n(1900, 2099)} {n(1900, 2099)}", "see you at noon. Then", "arrived at the station. dot", "look at this", f"{n(1000, 9999)}-{n(1000, 9999)}", f"{n(10**13, 10**17)}", f"({n(1900, 2030)}) {n(1, 400)}-{n(1, 400)}",
    ])


def examples_of(snippets: list[str], seed: int = SEED) -> list[Example]:
    """Labelled texts: the snippets with their base spans, what these become in other forms, near misses and
    numbers that are none. Nothing without base spans to learn from."""
    rng, out, any_span = random.Random(seed), [], False
    last = None
    for text in snippets:
        base = base_spans(text)
        flat = [s for s in base if all(s is o or s[2] <= o[1] or o[2] <= s[1] for o in base)]
        if len(flat) < len(base):
            continue
        any_span = any_span or bool(base)
        out.append((text, base))
        for kind, start, end in base:
            before, after = text[:start].rpartition(" ")[0][-24:] + " ", " " + text[end:].partition(" ")[2][:24]
            if re.search("[0-9@]", before + after):
                before, after = "so ", " it"
            for ahead, entity, rest in _rewritten(kind, text[start:end], rng):
                at = len(before + ahead)
                out.append((before + ahead + entity + rest + after, [(kind, at, at + len(entity))]))
            if kind != "email":
                # Numbers of two entities in a row.
                if last is not None:
                    at, then = len(before), len(before + last[1]) + 1
                    out.append((f"{before}{last[1]} {text[start:end]}{after}", [(last[0], at, then - 1), (kind, then, then + end - start)]))
                last = (kind, text[start:end])
            if kind == "card":
                number = re.sub("[^0-9]", "", text[start:end])
                wrong = number[:-1] + str((int(number[-1]) + rng.randint(1, 9)) % 10)
                out.append((before + wrong + after, []))
            out.append((f"so {_alike(rng)} it", []))
    return out if any_span else []


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_regions: int = TRAIN_REGIONS) -> Model:
    """The model of a bounded sample: the regions, of at most TRAIN_CHARS characters and with a little of what
    stands around them, of the first ``train_docs`` documents by a hash of their id; of these the first
    ``train_regions`` by a hash of the region. Without any base span in it nothing is learned."""
    schema = pa.schema([("snippet", pa.string())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                found = {text[max(0, r.starts[0] - 16) : r.ends[-1] + 16] for r in regions(text or "") if r.ends[-1] - r.starts[0] <= TRAIN_CHARS}
                if found:
                    yield batch(schema, [sorted(found)])

    sample = first_by_hash(docs.select("doc_id", "text"), train_docs, SEED).select("text")
    snippets = sample.mapInArrow(tidy(cut), "snippet string").distinct().orderBy(F.xxhash64("snippet"), "snippet").limit(train_regions)
    found = sorted(r.snippet for r in snippets.collect())
    return fit_examples(examples_of(found))


def _runs(model: Model, kinds: tuple[str, ...], found: Iterator[Candidate]) -> Iterator[list[tuple[Candidate, list[float]]]]:
    """The candidates with their scores, in runs that don't touch: each can be decoded on its own. Those
    that can't be in a best segmentation are left out: without one an atom scores 0, and the entities
    before and after it gain no more than two of ``follows``."""
    bar, run, stop = -2 * max(0.0, *(model.follows[k] for k in kinds)), [], -1
    for c in found:
        scores = [sum(model.weights.get((k, f), 0.0) for f in c.features) for k in kinds]
        if max(scores) <= bar:
            continue
        if c.first > stop and run:
            yield run
            run = []
        run.append((c, scores))
        stop = max(stop, c.stop)
    if run:
        yield run


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """The entities that the model finds beside ``base``."""
    if not model.weights:
        return []
    out, begins, reach = [], [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    for region in regions(text):
        lo, hi = region.starts[0], region.ends[-1]
        near = base[bisect_right(reach, lo) : bisect_left(begins, hi)]
        blocked = _blocked(region, near)
        follows = [model.follows[k] for k in region.kinds]
        for run in _runs(model, region.kinds, candidates(text, region, blocked)):
            first, stop = run[0][0].first, max(c.stop for c, _ in run)
            by_place = {(c.first, c.stop): c for c, _ in run}
            spans = [(c.first - first, c.stop - first, scores) for c, scores in run]
            for i, j, k in best_segmentation(stop - first, spans, follows):
                c = by_place[i + first, j + first]
                out.append((region.kinds[k], c.start, c.end))
    return out


def _blocked(region: Region, near: list[Span]) -> list[bool]:
    """Whether each atom is under one of the spans: by differences at the first and last that a span meets."""
    if not near:
        return [False] * len(region.starts)
    starts, ends = np.array(region.starts), np.array(region.ends)
    change = np.zeros(len(starts) + 1, int)
    np.add.at(change, np.searchsorted(ends, [s[1] for s in near], side="right"), 1)
    np.add.at(change, np.searchsorted(starts, [s[2] for s in near], side="left"), -1)
    return (np.cumsum(change)[:-1] > 0).tolist()


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, end exclusive) of every row of
    ``docs`` (doc_id, text): spans are those of ``base`` and the added ones.

    A null text is empty. Rows that repeat give a row each, an empty table an empty one; other columns
    are not read. Texts are read whole, one at a time, in time linear in their length; memory follows the
    longest chain of numbers of one text, with about 100 bytes a character.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span))])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                own = base_spans(text)
                every = ordered([*own, *added_spans(text, own, model)])
                for out, rows in ((base, own), (spans, every)):
                    out.append([{"kind": k, "start": s, "end": e} for k, s, e in rows])
            yield batch(schema, [b.column(0), base, spans])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "array<struct<kind: string, start: int, end: int>>"
    return rows.mapInArrow(tidy(read), f"doc_id long, base {kind}, spans {kind}")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap the first counts."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])

