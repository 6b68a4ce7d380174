import hashlib
import random
import re
import time

import numpy as np
import pytest

from tiersight.llm import private, queries
from tiersight.llm.sample_private import labelled_lines

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"),
    r"\+[0-9][ ().0-9-]+[0-9]",
]


def checked(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(int(x) <= 255 for x in found.split("."))
    if kind == 2:
        doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, *m.span()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if checked(k, m[0])]


def shown(spans):
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def model():
    return private.default_model()


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op13_personal_data(spark, sf)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        found = [x for x in r.spans.split(",") if x]
        assert set(shown(base).split(",")) - {""} <= set(found) and len(set(found)) == len(found)
        assert found == sorted(found, key=lambda x: (private.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


@pytest.mark.parametrize("seed", range(4))
def test_fixed_patterns_on_random_texts(seed):
    r = random.Random(seed)
    for _ in range(4000):
        text = "".join(r.choices("01259+.-@ ()aZ_%é\n٣", weights=[8, 8, 6, 6, 6, 4, 12, 5, 6, 8, 2, 2, 5, 3, 1, 1, 1, 1, 1], k=r.randint(0, 40)))
        assert private.base_spans(text) == plain_spans(text), text


def test_fixed_patterns_on_known_texts():
    cases = ["a@b.c@d.e", "x@y.z.", "@a.b", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "01.002.3.4", "4111 1111-1111 1111", "4111111111111111 4111111111111111", "+1 (803) 555-5351", "+12345678", "+1 23456789 +1-", "+1 (826) 555-4081 190.137.2.1", "0" * 3000 + "1.1.1.1", "", "a" * 100 + "@" * 50]
    for text in cases:
        assert private.base_spans(text) == plain_spans(text), text


def test_held_out_lines(model):
    right = wrong = missed = 0
    for text, spans in labelled_lines(400, seed=500):
        base = private.base_spans(text)
        known = {(private.KINDS[k], a, b) for k, a, b in base}
        got = known | {(private.KINDS[k], a, b) for k, a, b in private.added_spans(model, text, base)}
        right += len(got & set(spans))
        wrong += len(got - set(spans) - known)
        missed += len(set(spans) - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.96


def test_spellings_and_look_alikes(model):
    def found(text):
        base = private.base_spans(text)
        return [(private.KINDS[k], text[a:b]) for k, a, b in private.added_spans(model, text, base)]

    assert found("write to jane.roe [at] example [dot] com today") == [("email", "jane.roe [at] example [dot] com")]
    assert found("call (212) 555-0187 or") == [("phone", "(212) 555-0187")]
    assert found("server 192[.]168[.]1[.]20 is down") == [("ip", "192[.]168[.]1[.]20")]
    assert found("host fe80::1a2b:3c4d up") == [("ip", "fe80::1a2b:3c4d")]
    for text in ("on 2021-03-04 12:30:45 we", "version 1.12.2034", "order 83927461", "invoice 7264519283746152", 'token = "08813ad77930c5f691325605b62c9dfd1b407297"', "look at the dot product", "from 1990-2005", "12 45 88 102 7 5 66 91 23"):
        assert found(text) == [], text


def all_paths(found):
    """Every way through a lattice, as lists of (start, end, label, candidate)."""
    steps = [(a, b, k, c) for a, b, k, c in private.kinds_of(found)] + [(b - 1, b, private.NOTHING, None) for b in range(1, len(found.edges))]

    def walk(at):
        if at == len(found.edges) - 1:
            yield []
        for s in steps:
            if s[0] == at:
                for rest in walk(s[1]):
                    yield [s, *rest]

    return steps, list(walk(0))


def test_marginals_and_best_path_by_all_paths(model):
    rng = np.random.default_rng(3)
    texts = ["a@b dot c", "555 1234567", "+1 2345 67"]
    lattices = [private.lattice(t, 0, len(t)) for t in texts]
    batch = private.batch_of(lattices)
    follows = rng.normal(0, 1, (5, 5))
    n = sum(len(private.kinds_of(x)) for x in lattices)
    scores = np.concatenate([rng.normal(0, 2, n), np.zeros(len(batch.start) - n)])
    total, marginal, pairs = private.segment_marginals(batch, scores, follows)
    at, want_pairs, plain = 0, np.zeros((5, 5)), n
    for k, x in enumerate(lattices):
        steps, paths = all_paths(x)
        own = len(private.kinds_of(x))
        score = {id(s): scores[at + i] for i, s in enumerate(steps[:own])}
        value = np.array([sum(score.get(id(s), 0.0) + follows[a[2], s[2]] for a, s in zip([(0, 0, private.NOTHING), *p], p)) for p in paths])
        assert np.isclose(np.logaddexp.reduce(value), total[k])
        weight = np.exp(value - np.logaddexp.reduce(value))
        for i, s in enumerate(steps):
            want = sum(w for w, p in zip(weight, paths) if any(s is q for q in p))
            assert np.isclose(marginal[at + i] if i < own else marginal[plain + i - own], want, atol=1e-9)
        for w, p in zip(weight, paths):
            for a, s in zip([(0, 0, private.NOTHING), *p], p):
                want_pairs[a[2], s[2]] += w
        at, plain = at + own, plain + len(steps) - own
    assert np.allclose(pairs, want_pairs)
    for text in ["5551234567 or a at b dot com", "1 (555) 123-4567"]:
        x = private.lattice(text, 0, len(text))
        bias = lambda k: model.weights.get((k, ""), 0.0)
        cost = lambda s: 0.0 if s[3] is None else bias(s[2]) + sum(model.scores(part)[s[2]] for part in s[3][3:])
        _, paths = all_paths(x)
        best = max(paths, key=lambda p: sum(cost(s) + model.follows[a[2], s[2]] for a, s in zip([(0, 0, private.NOTHING), *p], p)))
        assert private.best_segments(model, x) == [(s[2], x.edges[s[0]], x.edges[s[1]]) for s in best if s[3]]


def test_odd_rows_and_masks(spark, model):
    """Nulls, empties, repeats, clashing columns, and code points beyond 16 bits."""
    rows = [(1, None), (None, ""), (2, "😀 é a.b@c.de, +1 (803) 555-5351"), (2, "😀 é a.b@c.de, +1 (803) 555-5351"), (3, "mail jane at example dot com")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, n_email string")
    got = sorted((tuple(r) for r in private.span_digests(table, model).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    both = "email:4:12,phone:14:31"
    assert got == sorted([(1, 0, 0, 0, 0, empty, ""), (None, 0, 0, 0, 0, empty, ""), *[(2, 1, 0, 0, 1, hashlib.sha256(both.encode()).hexdigest(), both)] * 2, (3, 0, 0, 0, 0, empty, "email:5:28")], key=str)
    masked = {(r.doc_id, r.text) for r in private.masked(table, model).collect()}
    assert masked == {(1, None), (None, ""), (2, "😀 é [email], [phone]"), (3, "mail [email]")}
    assert private.span_digests(table.where("false"), model).count() == 0


def test_long_texts_take_linear_time(model):
    began = time.time()
    for text in ("1" * 300_000, "1." * 30_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "a@" * 30_000, "1 " * 30_000, ":1" * 100_000, "[at]" * 50_000):
        private.added_spans(model, text, private.base_spans(text))
    assert time.time() - began < 60
