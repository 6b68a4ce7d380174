"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for other spellings.

The field labels whole segments of a stretch of text: email, ip, card, phone, or a single unit of
nothing. A segment's score is a sum of weights on what the whole of it looks like (its groups of digits
and what parts them, check digits, the words before it), and a dynamic program over segments of bounded
length chooses boundaries and types together. Weights are trained on generated lines by gradient
ascent on the likelihood. Only stretches around digits, `@` and words for dots are looked at; all else
can't hold a candidate.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersight.llm.flat import parts
from tiersight.llm.sample_private import labelled_lines

KINDS = ("email", "ip", "card", "phone")
DIGIT = re.compile("[0-9]")
# Fixed patterns. Runs are possessive where giving back could not help, so that no text takes quadratic time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _octet(part: str) -> bool:
    return len(bare := part.lstrip("0")) < 4 and int(bare or 0) < 256


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by kind and then start; code points, end exclusive.

    Per kind, matches are leftmost and don't overlap; one that fails its check (octets up to 255, 13
    to 19 digits that pass Luhn's check, 9 to 15 digits) is dropped, and its text not tried again.
    """
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        # what is before an @ is the whole run up to it; whether what follows fits doesn't depend on it
        start = last + len(text[last:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(found := _digits(m[0])) <= 19 and luhn(found):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Stretches that can hold a candidate, and the candidates in them.
UNIT = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
#: What parts groups of digits.
PART = r"(?: ?[.\-/] ?|[  ]{1,2}|\)[ \-/]?| ?\(|\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )"
NUMBER = re.compile(rf"[+(]{{0,2}}[0-9]++(?:{PART}[0-9]++)*+")
AT = r"(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at | AT | ?@ ?)"
DOT = r"(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot | DOT |\.| \. )"
MAIL = re.compile(rf"([A-Za-z0-9._%+-]{{1,64}}+)({AT})([A-Za-z0-9-]{{1,63}}+)(?={DOT})")
CUE = re.compile(r"@|[\[({<] ?(?:at|AT|dot|DOT|\.) ?[\])}>]| (?:AT|dot|DOT) ")
LABEL = re.compile(rf"({DOT})([A-Za-z0-9-]{{1,63}}+)")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,5}::[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,5})(?![0-9A-Za-z:])")
WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Fewest and most digits of a candidate, most groups, and most labels of a host; text before a candidate that is looked at.
FEWEST, MOST, GROUPS, LABELS, BEFORE = 7, 20, 8, 6, 40
#: A name, what stands for @ and a label of a host are no longer than this.
REACH = 144
ENDINGS = frozenset("com org net edu gov int mil info io de fr es it uk us eu ch at nl be pl pt br jp cn ru in ca au co".split())


class Shape(NamedTuple):
    """What a candidate of digits looks like as a whole: lengths of its groups, what parts them, and checks."""

    groups: tuple[int, ...]
    parted: tuple[str, ...]
    octets: bool | None
    check: bool | None
    year: bool
    leads: str
    opens: str

    def looks(self) -> Iterator[str]:
        yield f"digits {sum(self.groups)}"
        yield f"groups {'-'.join(map(str, self.groups))}"
        yield f"parted {' '.join(sorted(set(self.parted)))}"
        yield f"in {len(self.groups)}"
        yield f"leads {self.leads}"
        yield f"opens {self.opens}"
        if self.octets is not None:
            yield f"octets {self.octets} {self.parted[0]}"
        if self.check is not None:
            yield f"check {self.check}"
        if self.year:
            yield "year"


class Looks(NamedTuple):
    """What any other candidate looks like."""

    all: tuple[str, ...]

    def looks(self) -> Iterator[str]:
        yield from self.all


class Side(NamedTuple):
    """What is before a candidate, or after it: the words there, what touches it, whether a number is near."""

    words: tuple[str, ...]
    touch: str
    number: bool
    before: bool

    def looks(self) -> Iterator[str]:
        side = "left" if self.before else "right"
        yield from (f"word {w}" for w in self.words)
        yield f"{side} {self.touch}"
        if self.number:
            yield f"{side} number"


class Candidate(NamedTuple):
    start: int
    end: int
    kinds: tuple[int, ...]
    own: Shape | Looks
    left: Side
    right: Side


def _touch(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-./:#$@,(" else "sign"


NUMBER_BEFORE, NUMBER_AFTER = re.compile(r"[0-9][ .\-/:,]{1,2}\Z"), re.compile(r"[ .\-/:,]{1,2}[0-9]")


def _left(text: str, start: int) -> Side:
    near = text[max(0, start - BEFORE) : start]
    return Side(tuple(WORDS.findall(near.lower())[-2:]), _touch(near[-1:]), bool(NUMBER_BEFORE.search(near[-3:])), True)


def _right(text: str, end: int) -> Side:
    return Side((), _touch(text[end : end + 1]), bool(NUMBER_AFTER.match(text, end)), False)


YEAR = re.compile("(?:19|20)[0-9]{2}")


def _numbers(text: str, m: re.Match) -> Iterator[Candidate]:
    """Candidates among the groups of digits of a match of NUMBER, with each sign before the first that could belong to it."""
    at = [x.span() for x in re.finditer("[0-9]++", m[0])]
    base = m.start()
    groups = [m[0][a:b] for a, b in at]
    parted = [m[0][b:a].strip() or "space" for (_, b), (a, _) in zip(at, at[1:])]
    octets = [_octet(g) for g in groups]
    years = [bool(YEAR.fullmatch(g)) for g in groups]
    lengths = tuple(map(len, groups))
    rights: dict[int, Side] = {}
    for i, first in enumerate(groups):
        start, n, lefts = base + at[i][0], 0, {}
        for j in range(i, min(i + GROUPS, len(groups))):
            n += lengths[j]
            if n > MOST:
                break
            if n < FEWEST and j - i != 3:
                continue
            end = base + at[j][1]
            if j not in rights:
                rights[j] = _right(text, end)
            between = tuple(parted[i:j])
            digits = "".join(groups[i : j + 1]) if 13 <= n <= 19 else first
            shape = Shape(
                lengths[i : j + 1], between, all(octets[i : j + 1]) if j - i == 3 and len(set(between)) == 1 else None, luhn(digits) if 13 <= n <= 19 else None, years[i] or years[j],
                "00" if first.startswith("00") else "0" if first[0] == "0" else "1" if first == "1" else "9", "",
            )
            for k in (0, 1, 2):
                opens = text[start - k : start]
                if k and (start < k or opens[0] not in "+(" or opens[-1] not in "+("):
                    break
                if "(" in opens and ")" not in text[start:end]:
                    continue
                if k not in lefts:
                    lefts[k] = _left(text, start - k)
                yield Candidate(start - k, end, (1, 2, 3), shape._replace(opens=opens) if k else shape, lefts[k], rights[j])


def candidates(text: str, lo: int, hi: int) -> list[Candidate]:
    """All candidate segments that begin in text[lo:hi]."""
    out: list[Candidate] = []
    for m in NUMBER.finditer(text, lo, hi):
        out += _numbers(text, m)
    for m in COLONS.finditer(text, lo, hi):
        looks = (f"colons {min(m[0].count(':'), 7)}", f"gap {'::' in m[0]}", f"letters {any(c.isalpha() for c in m[0])}")
        out.append(Candidate(*m.span(), (1,), Looks(looks), _left(text, m.start()), _right(text, m.end())))
    for m in MAIL.finditer(text, lo, min(len(text), hi + REACH)):
        if m.start() >= hi:
            break
        end, dots, label = m.end(), [], m
        while len(dots) < LABELS and (label := LABEL.match(text, end)):
            dots.append(label[1].strip().lower())
            end = label.end()
            looks = (f"at {m[2].lower()}", f"dot {dots[-1]}", f"ending {label[2].lower() in ENDINGS}", f"labels {len(dots)}", f"host www {m[3].lower() == 'www'}", f"more {bool(LABEL.match(text, end))}", f"name {m[1].lower()}" if len(m[1]) < 3 else "name", f"name parts {bool(re.search('[0-9._]', m[1]))}")
            out.append(Candidate(m.start(), end, (0,), Looks(looks), _left(text, m.start()), _right(text, end)))
    return out


class Lattice(NamedTuple):
    """Of one stretch: its units' edges, and each candidate with the numbers of its own."""

    edges: list[int]
    segments: list[tuple[int, int, Candidate]]


def lattice(text: str, lo: int, hi: int) -> Lattice:
    found = candidates(text, lo, hi)
    hi = max([hi, *(c.end for c in found)])
    lo = min([lo, *(c.start for c in found)])
    edges = {lo} | {m.end() for m in UNIT.finditer(text, lo, hi)}
    edges |= {e for c in found for e in (c.start, c.end)}
    order = sorted(edges)
    at = {e: k for k, e in enumerate(order)}
    return Lattice(order, [(at[c.start], at[c.end], c) for c in found])


NOTHING = len(KINDS)


class Model:
    """Weights by (kind, look), the look "" for the kind itself, and log-potentials (label before, label)."""

    def __init__(self, weights: dict[tuple[int, str], float], follows: np.ndarray):
        self.weights, self.follows = weights, follows
        self._known: dict[Shape | Looks | Side, tuple[float, ...]] = {}

    def __getstate__(self) -> tuple:
        return self.weights, self.follows

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def scores(self, part: Shape | Looks | Side) -> tuple[float, ...]:
        """What a part of a candidate adds to each kind's score; parts met before are remembered, up to a number."""
        found = self._known.get(part)
        if found is None:
            if len(self._known) > 1 << 16:
                self._known.clear()
            looks = list(part.looks())
            found = self._known[part] = tuple(sum(self.weights.get((kind, x), 0.0) for x in looks) for kind in range(len(KINDS)))
        return found


def best_segments(model: Model, found: Lattice) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the segments on the best path; of equal ones the first candidate's."""
    follows = list(zip(*model.follows.tolist()))  # by label, from each label before
    bias = [model.weights.get((kind, ""), 0.0) for kind in range(len(KINDS))]
    ending: list[list[tuple[int, Candidate]]] = [[] for _ in found.edges]
    for a, b, c in found.segments:
        ending[b].append((a, c))
    labels, low = range(NOTHING + 1), float("-inf")
    best = [low] * NOTHING + [0.0]
    # for each edge and next label, the best score up to it and the label before
    entry = [[max((best[y] + follows[x][y], -y) for y in labels) for x in labels]]
    back: list[list[tuple[int, int] | None]] = [[None] * (NOTHING + 1)]
    for b in range(1, len(found.edges)):
        score, y = entry[b - 1][NOTHING]
        best, came = [low] * NOTHING + [score], [None] * NOTHING + [(b - 1, -y)]
        for a, c in ending[b]:
            own, left, right = model.scores(c.own), model.scores(c.left), model.scores(c.right)
            for kind in c.kinds:
                score, y = entry[a][kind]
                score += own[kind] + left[kind] + right[kind] + bias[kind]
                if score > best[kind]:
                    best[kind], came[kind] = score, (a, -y)
        entry.append([max((best[y] + follows[x][y], -y) for y in labels) for x in labels])
        back.append(came)
    at, y, out = len(found.edges) - 1, max(labels, key=lambda y: best[y]), []
    while back[at][y] is not None:
        a, before = back[at][y]
        if y != NOTHING:
            out.append((y, found.edges[a], found.edges[at]))
        at, y = a, before
    return out[::-1]


class Batch(NamedTuple):
    """Lattices of many lines side by side: for each step, the segments that end there."""

    steps: list[np.ndarray]
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    last: np.ndarray


def kinds_of(found: Lattice) -> list[tuple[int, int, int, Candidate]]:
    """The segments of a lattice, one for each kind of a candidate."""
    return [(a, b, kind, c) for a, b, c in found.segments for kind in c.kinds]


def batch_of(found: list[Lattice]) -> Batch:
    rows, depth, first, last, base = [], [], [], [], 0
    for x in found:
        n = len(x.edges)
        first.append(base)
        last.append(base + n - 1)
        own = kinds_of(x)
        rows += [(base + a, base + b, kind) for a, b, kind, _ in own]
        depth += [b for _, b, _, _ in own]
        base += n
    for x, at in zip(found, first):
        rows += [(at + b - 1, at + b, NOTHING) for b in range(1, len(x.edges))]
        depth += range(1, len(x.edges))
    start, end, kind = np.array(rows).T
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(np.array(depth)[order], np.arange(1, max(depth) + 2))
    return Batch([order[a:b] for a, b in zip(cuts, cuts[1:])], start, end, kind, np.array(first), np.array(last))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis, keepdims=True), -1e300)
    return np.log(np.exp(x - top).sum(axis) + 1e-300) + top.squeeze(axis)


def segment_marginals(batch: Batch, scores: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods' normalizers, each segment's marginal, and the expected number of each pair of labels."""
    n, k = batch.last[-1] + 1, NOTHING + 1
    ahead, behind = np.full((n, k), -1e30), np.full((n, k), -1e30)
    ahead[batch.first, NOTHING] = 0
    behind[batch.last] = 0
    for own in batch.steps:
        value = _log_sum(ahead[batch.start[own]] + follows[:, batch.kind[own]].T, 1) + scores[own]
        np.logaddexp.at(ahead, (batch.end[own], batch.kind[own]), value)
    for own in reversed(batch.steps):
        value = follows[:, batch.kind[own]].T + (scores[own] + behind[batch.end[own], batch.kind[own]])[:, None]
        np.logaddexp.at(behind, batch.start[own], value)
    total = _log_sum(ahead[batch.last], 1)
    line = np.searchsorted(batch.last, batch.end)
    pair = ahead[batch.start] + follows[:, batch.kind].T + (scores + behind[batch.end, batch.kind] - total[line])[:, None]
    pair = np.exp(np.minimum(pair, 0))
    pairs = np.zeros((k, k))
    np.add.at(pairs.T, batch.kind, pair)
    return total, pair.sum(1), pairs


def train(lines: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 100, rate: float = 0.3, prior: float = 0.02) -> Model:
    """Gradient ascent (Adam) on the likelihood of lines whose spans are (kind, start, end)."""
    cases = [(spans, lattice(text, *x)) for text, spans in lines for x in stretches(text)]
    found = [x for _, x in cases]
    batch = batch_of(found)
    index: dict[tuple[int, str], int] = {}
    segments = [s for x in found for s in kinds_of(x)]
    flat = [[index.setdefault((kind, look), len(index)) for look in (*c.own.looks(), *c.left.looks(), *c.right.looks(), "")] for _, _, kind, c in segments]
    owner = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    flat = np.array([x for own in flat for x in own])
    truth = np.zeros(len(batch.start))
    at, seen = 0, np.zeros((NOTHING + 1, NOTHING + 1))
    plain = len(segments)
    for spans, x in cases:
        want = {(KINDS.index(kind), a, b) for kind, a, b in spans}
        inside, labels, ends = set(), {}, {}
        own = kinds_of(x)
        for k, (a, b, kind, _) in enumerate(own):
            if (kind, x.edges[a], x.edges[b]) in want:
                truth[at + k] = 1
                ends[a] = (b, kind)
                inside.update(range(a, b))
        before, here = NOTHING, 0
        while here < len(x.edges) - 1:
            here, label = ends.get(here, (here + 1, NOTHING))
            seen[before, label] += 1
            before = label
        for b in range(1, len(x.edges)):
            truth[plain] = b - 1 not in inside
            plain += 1
        at += len(own)
    n = len(segments)
    w, mean, square = np.zeros(len(index) + (NOTHING + 1) ** 2), 0.0, 0.0
    for t in range(1, rounds + 1):
        follows = w[len(index) :].reshape(NOTHING + 1, -1)
        scores = np.concatenate([np.bincount(owner, w[flat], n), np.zeros(len(batch.start) - n)])
        _, marginal, pairs = segment_marginals(batch, scores, follows)
        gradient = np.concatenate([np.bincount(flat, (truth - marginal)[:n][owner], len(index)), (seen - pairs).ravel()]) - prior * w
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model(dict(zip(index, w.tolist())), w[len(index) :].reshape(NOTHING + 1, -1))


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained once a session on the generated lines of this package."""
    return train(labelled_lines())


def stretches(text: str) -> list[tuple[int, int]]:
    """Where candidates can begin: numbers of enough digits, colons between hexadecimal groups, names before `@` and its spellings."""
    found = []
    if DIGIT.search(text):
        found += [m.span() for m in NUMBER.finditer(text) if m.end() - m.start() >= FEWEST and (len(_digits(m[0])) >= FEWEST or len(re.findall("[0-9]++", m[0])) >= 4)]
    if "::" in text or re.search(r":[0-9A-Fa-f]{1,4}:", text):
        found += [m.span() for m in COLONS.finditer(text)]
    if "@" in text or any(x in text for x in ("dot", "DOT", "[.]", "(.)", "at]", "at)", "at}", "at>", " AT ")):
        cues = [m.start() for m in CUE.finditer(text)]
        hi = 0
        for cue in cues:
            lo, hi = max(hi, cue - REACH), cue + 1
            found += [m.span() for m in MAIL.finditer(text, lo, min(len(text), hi + REACH)) if m.start() < hi]
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def added_spans(model: Model, text: str, base: list[Span]) -> list[Span]:
    """What the field finds beside the fixed patterns; nothing that overlaps theirs, or what it found before."""
    starts, ends, out, last = [], [], [], 0
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for lo, hi in stretches(text):
        for kind, a, b in best_segments(model, lattice(text, lo, hi)):
            k = bisect_left(starts, b)
            if a >= last and (not k or ends[k - 1] <= a):
                out.append((kind, a, b))
                last = b
    return out


def private_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text, spans, n_base): spans is an array of (kind, start, end, base) in order of kind and start.

    kind is email, ip, card or phone; start and end are code points, end exclusive; base tells the
    fixed patterns' spans (`base_spans`) from those that the field adds, which overlap none of them.
    Null texts count as empty and stay null; every row is looked at for itself, also under null or
    repeated doc_ids; other columns are not looked at. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                both = sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(shared.value, text or "", base)])
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in both])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(span))], ["doc_id", "text", "spans"])

    schema = "doc_id long, text string, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, schema)


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in brackets; where spans overlap, the first one's kind."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                out, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        out += [text[at : s["start"]], f"[{s['kind']}]"]
                    at = max(at, s["end"])
                texts.append(None if text is None else "".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return private_spans(docs, model).mapInArrow(each, "doc_id long, text string")


def span_digests(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: how many fixed-pattern spans of each kind, the SHA-256 of their list, and all spans as text."""
    found = private_spans(docs, model)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.expr(f"filter(spans, s -> s.base and s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
