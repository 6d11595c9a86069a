import hashlib
import re

from hypothesis import given, settings, strategies as st

from lodestrata.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()%é\n", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.ordered(pii.base_spans(text)) == brute(text)


CASES = ["mail a.b@c.org or x@y@z.de", "ip 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 not 4111 1111 1111 1112", "call +44 20 7946 0958, again 020 7946 0958.", "x" * 3000 + "1" * 3000, "@" * 2000, ""]


def test_cases_and_digests(documents):
    docs = documents([(k, t) for k, t in enumerate(CASES)] + [(50, None), (None, CASES[0]), (1, CASES[1])])
    got = pii.find_pii(docs, keep_text=True).collect()
    assert len(got) == len(CASES) + 3
    texts = dict(enumerate(CASES)) | {50: "", None: CASES[0]}
    for r in got:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert set("%s:%d:%d" % s for s in want) <= set(filter(None, r.spans.split(",")))
    by = {r.doc_id: r for r in got}
    assert by[50].redacted is None and "4111 1111 1111 1111" not in by[2].redacted and "<email>" in by[0].redacted
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_repeats_are_found_by_skip_links():
    texts = [f"call +44 20 7946 {n:04d} or 020 7946 {n:04d} at noon; year 1999" for n in range(950, 990)] + [f"the year {y} came" for y in range(1900, 1990)]
    model = pii.train(texts)
    t = texts[3]
    base = pii.base_spans(t)
    added = pii.added_spans(t, base, model)
    assert added and all(k == "phone" for k, _, _ in added)
    assert all(t[a:b] != "1999" for _, a, b in added)
    assert pii.added_spans(texts[-1], pii.base_spans(texts[-1]), model) == []


def test_messages_agree_with_enumeration():
    """On a graph without cycles, message passing gives exact marginals."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    model = pii.Model(rng.normal(size=(pii.FEATURES + 1, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)), rounds=200)
    g = pii.Graph([(0, 1), (2, 3), (4, 5)], np.array([-1, 2, -1]), np.array([[1], [2], [3]]), np.array([[0, 1]]), np.array([[1, 2]]), ["a", "b", "c"])
    node = model.weights[g.features].sum(axis=1) + model.weights[-1]
    total = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        if y[1] == 2:
            w = np.exp(node[0, y[0]] + node[2, y[2]] + model.chain[y[0], y[1]] + model.skip[y[1], y[2]])
            for k in range(3):
                total[k, y[k]] += w
    assert np.allclose(model.posteriors(g), total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_redaction():
    assert pii.redact("a b c", [("ip", 2, 3)]) == "a <ip> c"
    assert pii.redact("abcdef", [("card", 0, 4), ("phone", 2, 6)]) == "<card>"


def test_gradient_by_finite_differences():
    import numpy as np

    texts = ["call +44 20 7946 0958 or 020 7946 0958 now", "ip 10.0.0.1 then 10.0.0.1 and 17 or 18", "a@b.org 5 a@b.org"]
    g = pii.union([pii.graph(t, pii.base_spans(t)) for t in texts])
    rng = np.random.default_rng(2)
    skip = rng.normal(size=(5, 5))
    model = pii.Model(rng.normal(size=(pii.FEATURES + 1, 5)), rng.normal(size=(5, 5)), skip + skip.T)
    label = rng.dirichlet(np.ones(5), len(g.spans))
    known = np.arange(len(g.spans)) % 4 != 1
    _, grads = pii.gradient(model, g, label, known)
    for part, grad, at in ((model.weights, grads[0], (g.features[0, 0], 2)), (model.weights, grads[0], (-1, 1)), (model.chain, grads[1], (0, 4)), (model.chain, grads[1], (4, 4)), (model.skip, grads[2], (4, 0))):
        places = {at, at[::-1]} if part is model.skip else {at}
        values = []
        for step in (1e-6, -1e-6):
            for p in places:
                part[p] += step
            values.append(pii.gradient(model, g, label, known)[0])
            for p in places:
                part[p] -= step
        assert abs((values[0] - values[1]) / 2e-6 - len(places) * grad[at]) < 1e-6


def brute_query(texts, model, least=0.7):
    """Spans by the definition: patterns, then message passing, for every text by itself."""
    out = []
    for t in texts:
        base = brute(t or "")
        out.append(",".join("%s:%d:%d" % s for s in pii.ordered(base + (pii.added_spans(t, base, model, least) if base else []))))
    return out


def test_the_query_against_the_definition(documents):
    texts = [f"call +44 20 7946 {n:04d} or 020 7946 {n:04d} at noon; year 1999" for n in range(950, 970)] + CASES + [None, "word " * 50_000 + "ip 10.1.2.3 x@y.org"]
    docs = documents([(k, t) for k, t in enumerate(texts)], g=1, h=2, c0=3)
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_query(texts, pii.fit(docs))


def test_the_field_tells_linked_tokens_apart(documents):
    """An order number that ends like a phone number is linked to it, but stands where order numbers stand."""
    rng = __import__("random").Random(5)
    texts = []
    for _ in range(200):
        n = rng.randint(10_000_000, 99_999_999)
        texts.append(f"phone +4420{n} today, then phone 020{n} later; order 88{rng.randint(1000000, 9999999)} came")
        texts.append(f"phone +4420{n} soon, order 990{n} came")
    texts += [f"order 99{rng.randint(1000000, 9999999)} came" for _ in range(300)]
    model = pii.train(texts)
    found = [[t[a:b] for _, a, b in pii.added_spans(t, pii.base_spans(t), model)] for t in texts[:400]]
    phones = sum(any(x.startswith("020") for x in f) for f in found)
    orders = sum(any(x.startswith("99") for x in f) for f in found)
    assert phones > 180 and orders < 20
