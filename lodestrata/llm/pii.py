"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (e-mail, IP address, card, phone). Tokens with a digit
or an @ then form a graph over the whole document: neighbours in the text share a
chain potential, and tokens that repeat or resemble each other - the same digits,
or one's digits at the end of the other's - share a skip potential wherever they
stand. Base tokens are observed; loopy message passing carries their kind to the
others. A token gets a kind of its own if its posterior is high enough and a skip
link supports it, so a number once written as +44 20 7946 0958 is also found where
it reads 020 7946 0958.

All potentials - node weights of shape features, chain and skip tables - are fitted
together on a bounded sample of texts that the patterns label, by the gradient of the
pseudo-likelihood: each token's label given its neighbours'. Tokens that resemble an
entity but match no pattern are latent: in turns their posteriors come from message
passing and the potentials from the gradient.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import sampling, worker
from .columns import numbered, place
from .hashing import column, slices
from .pairs import forest

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ so that long runs cost no more than their length."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by kind, then start."""
    out: list[Span] = list(emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@dataclass
class Graph:
    """Candidate tokens of one document: spans, observed labels (-1: none), features, edges."""

    spans: list[tuple[int, int]]
    observed: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    words: list[str]


def shape(token: str) -> str:
    squeezed = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", token))
    return squeezed[:12]


FEATURES = 512


def _features(token: str, before: str, after: str) -> list[int]:
    digits = sum(c.isdigit() for c in token)
    names = [f"shape={shape(token)}", f"digits={min(digits, 20)}", f"before={before.lower()[-12:]}", f"after={shape(after)}", f"at={'@' in token}", f"plus={token.startswith('+')}", f"dots={min(token.count('.'), 4)}"]
    return [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest(), "little") % FEATURES for n in names]


def graph(text: str, base: list[Span]) -> Graph:
    """Edges are linear in the tokens: repeats are linked to the one before."""
    marks = sorted((a, b, LABELS.index(kind)) for kind, a, b in base)
    spans, words, observed, features, order = [], [], [], [], []
    all_tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    k = 0
    firsts: dict[int, int] = {}  # the first token of each base span
    for n, (a, b) in enumerate(all_tokens):
        word = text[a:b]
        while k < len(marks) and marks[k][1] <= a:
            k += 1
        if not DIGIT.search(word) and "@" not in word:
            continue
        core = word.strip(".,;:!?#$%&*<>[]{}\"'=")
        low = a + word.find(core) if core else a
        before = text[slice(*all_tokens[n - 1])] if n else ""
        after = text[slice(*all_tokens[n + 1])] if n + 1 < len(all_tokens) else ""
        label = -1
        for m in range(k, len(marks)):
            x, y, kind = marks[m]
            if x >= b:
                break
            if y > a:
                label = kind if label < 0 else label
                firsts.setdefault(m, len(spans))
        spans.append((low, low + len(core) if core else b))
        words.append(core or word)
        observed.append(label)
        features.append(_features(core or word, before, after))
        order.append(n)
    chain = [(i, i + 1) for i in range(len(order) - 1) if order[i + 1] - order[i] == 1]
    skip, last = [], {}
    # a base span of several tokens lends its digits to its first token
    whole = {i: re.sub(r"\D", "", text[marks[m][0] : marks[m][1]]) for m, i in firsts.items()}
    for i, w in enumerate(words):
        digits = re.sub(r"\D", "", w)
        keys = {w.lower()}
        for d in {digits, whole.get(i, "")}:
            if len(d) >= 7:
                keys |= {d, d[-7:]}
        # digits spread over the next tokens, as in 020 7946 0958
        joined, j = digits, i
        while j + 1 < len(words) and order[j + 1] - order[j] == 1 and j < i + 4 and "@" not in words[j + 1] and len(joined) < 16:
            j += 1
            joined += re.sub(r"\D", "", words[j])
            if len(joined) >= 9:
                keys.add(joined[-7:])
        for key in keys:
            if key in last and last[key] != i:
                skip.append((last[key], i))
            last[key] = i
    pairs = lambda x: np.array(sorted(set(x)), dtype=np.int64).reshape(-1, 2)
    return Graph(spans, np.array(observed, dtype=np.int64), np.array(features, dtype=np.int64).reshape(len(spans), -1), pairs(chain), pairs(skip), words)


@dataclass
class Model:
    weights: np.ndarray  # features and a bias, by label
    chain: np.ndarray
    skip: np.ndarray
    rounds: int = 12

    def posteriors(self, g: Graph) -> np.ndarray:
        """Marginals of loopy sum-product message passing with damping."""
        n, k = len(g.spans), len(LABELS)
        node = self.weights[g.features].sum(axis=1) + self.weights[-1]
        seen = g.observed >= 0
        node[seen] = -50.0
        node[seen, g.observed[seen]] = 0.0
        edges = np.concatenate([g.chain, g.skip])
        if not len(edges):
            return np.exp(node - np.logaddexp.reduce(node, axis=1, keepdims=True))
        pair = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), k))
        for _ in range(self.rounds):
            total = node.copy()
            np.add.at(total, target, message)
            out = np.logaddexp.reduce((total[source] - message[back])[:, :, None] + pair, axis=1)
            out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
            change = np.abs(out - message).max()
            message = 0.5 * message + 0.5 * out
            if change < 1e-4:
                break
        total = node.copy()
        np.add.at(total, target, message)
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


def union(graphs: list[Graph]) -> Graph:
    """Several documents' graphs as one."""
    starts = np.cumsum([0] + [len(g.spans) for g in graphs])
    moved = lambda name: np.concatenate([getattr(g, name) + k for g, k in zip(graphs, starts, strict=False)])
    return Graph([s for g in graphs for s in g.spans], np.concatenate([g.observed for g in graphs]), np.concatenate([g.features for g in graphs]), moved("chain"), moved("skip"), [w for g in graphs for w in g.words])


def gradient(model: Model, g: Graph, label: np.ndarray, known: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log pseudo-likelihood of the known tokens' labels, and its gradient by weights, chain and skip. ``label`` has a distribution a token."""
    (ca, cb), (sa, sb) = g.chain.T, g.skip.T
    z = model.weights[g.features].sum(axis=1) + model.weights[-1]
    for at, add in ((cb, label[ca] @ model.chain), (ca, label[cb] @ model.chain.T), (sa, label[sb] @ model.skip), (sb, label[sa] @ model.skip)):
        np.add.at(z, at, add)
    log = z - np.logaddexp.reduce(z, axis=1, keepdims=True)
    n = max(1, int(known.sum()))
    pull = np.where(known[:, None], label - np.exp(log), 0.0) / n
    weights = np.empty_like(model.weights)
    for c in range(label.shape[1]):
        weights[:-1, c] = np.bincount(g.features.ravel(), np.repeat(pull[:, c], g.features.shape[1]), len(weights) - 1)
    weights[-1] = pull.sum(axis=0)
    chain = label[ca].T @ pull[cb] + pull[ca].T @ label[cb]
    skip = label[sb].T @ pull[sa] + label[sa].T @ pull[sb]
    return float((label * log)[known].sum() / n), [weights, chain, (skip + skip.T) / 2]


AGREE = 4.0  # prior mean of the skip potential: linked tokens tend to be of one kind


def train(texts: list[str], rounds: int = 4, steps: int = 60, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Fits all potentials together. A skip link says how far two tokens of one kind agree, a number for each kind.

    In the first round latent tokens don't count; then each round takes their posteriors for labels.
    Without a candidate token the potentials keep their prior.
    """
    k = len(LABELS)
    model = Model(np.zeros((FEATURES + 1, k)), np.zeros((k, k)), AGREE * np.eye(k))
    graphs = [g for t in texts if len((g := graph(t, base_spans(t))).spans)]
    if not graphs:
        return model
    g = union(graphs)
    seen = g.observed >= 0
    linked = np.zeros(len(seen), dtype=bool)
    linked[g.skip[:, 0]] |= seen[g.skip[:, 1]]
    linked[g.skip[:, 1]] |= seen[g.skip[:, 0]]
    known = seen | ~linked
    label = np.eye(k)[np.where(seen, g.observed, 0)]
    label[~known] = 0  # no message to their neighbours yet
    clamped = Graph(g.spans, np.where(known, np.maximum(g.observed, 0), -1), g.features, g.chain, g.skip, g.words)
    parts, prior = [model.weights, model.chain, model.skip], [0.0, 0.0, AGREE * np.eye(k)]
    counts = known.copy()
    for _ in range(rounds):
        first, second = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
        for step in range(1, steps + 1):
            _, grads = gradient(model, g, label, counts)
            grads[2] *= np.eye(k)
            for x, d, m, v, mean in zip(parts, grads, first, second, prior, strict=True):
                d -= penalty * (x - mean)
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if known.all():
            break
        label[~known] = model.posteriors(clamped)[~known]
        counts[:] = True
    return model


def added_spans(text: str, base: list[Span], model: Model, least: float = 0.7) -> list[Span]:
    """Spans of tokens outside base spans that a skip link ties to an entity and whose posterior for one kind is ``least`` or more."""
    if not base:
        return []
    g = graph(text, base)
    if not len(g.skip) or not (g.observed < 0).any():
        return []
    part = forest(len(g.spans), g.skip[:, 0], g.skip[:, 1])  # support passes along links
    linked = np.isin(part, part[g.observed >= 0]) & (g.observed < 0)
    if not linked.any():
        return []
    posterior = model.posteriors(g)
    best = posterior[:, 1:].argmax(axis=1)
    out = []
    for i in np.flatnonzero(linked):
        if posterior[i, best[i] + 1] >= least:
            a, b = g.spans[i]
            out.append((KINDS[best[i]], a, b))
    return apart(out, base)


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap no base span."""
    taken = np.array(sorted((a, b) for _, a, b in base))
    reach = np.maximum.accumulate(taken[:, 1])
    out = []
    for s in spans:
        k = int(np.searchsorted(taken[:, 0], s[2])) - 1
        if k < 0 or reach[k] <= s[1]:
            out.append(s)
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span as its kind in angle brackets; overlapping spans give one, of the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, text: str = "text", max_rows: int = 2000, max_bytes: int = 32 << 20) -> Model:
    """Learns from at most ``max_rows`` different texts with a digit or an @, which the patterns label; chosen by their hash, ``max_bytes`` bytes in all."""
    t = F.col(place(docs, text))
    rows = numbered(docs).filter(t.rlike("[0-9@]")).select(F.lit(0).alias("g"), F.xxhash64(t).alias("h"), F.octet_length(t).alias("size"), t.alias("text"))
    picked = sampling.chosen(rows.select("g", "h", "size"), max_rows, max_bytes)
    return train([r.text for r in sampling.fetched(rows, picked, "text")] if picked else [])


def spans_of(text: str | None, model: Model, least: float) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds."""
    base = ordered(base_spans(text)) if text else []
    return base, added_spans(text, base, model, least) if base else []


def find_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.7, max_rows: int = 2000, max_bytes: int = 32 << 20, keep_text: bool = False) -> DataFrame:
    """Personal data in every whole text, however long.

    Returns, per row: the id, n_email, n_ip, n_card, n_phone (base spans), base_sha256
    of the base spans as kind:start:end, spans (base and added ones, written alike;
    code points, end exclusive), n_added and, with ``keep_text``, redacted (the text
    with all spans replaced; null stays null). Null texts count as empty. Null ids, repeated rows
    and ties are rows like others; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    worker.small_batches(docs.sparkSession)
    model = fit(docs, text, max_rows, max_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for batch in batches:
            for part in slices(batch):
                counts, digests, all_spans, n_added, texts = [], [], [], [], []
                for t in column(part, "text").to_pylist():
                    base, more = spans_of(t, model, least)
                    spans = ordered(base + more) if more else base
                    counts.append([sum(s[0] == k for s in base) for k in KINDS])
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                    all_spans.append(written(spans))
                    n_added.append(len(more))
                    texts.append(redact(t, spans) if spans else t)
                cols = [column(part, "id"), *(pa.array(c, pa.int64()) for c in np.array(counts).reshape(-1, len(KINDS)).T), pa.array(digests), pa.array(all_spans, pa.string()), pa.array(n_added, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(texts, pa.string())] * keep_text], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *["redacted"] * keep_text])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", redacted string" * keep_text
    rows = numbered(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text)).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, model: Model, measures: dict | None = None, text: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced; ``measures`` names columns to compute anew from a changed text.

    Null texts stay null; all other columns, whatever their names, and all rows stay as they are.
    """
    worker.small_batches(docs.sparkSession)
    measures = {docs.columns.index(c): f for c, f in (measures or {}).items() if c in docs.columns}
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                columns, texts = part.columns, part.column(at).to_pylist()
                changed: dict[int, str] = {}
                for k, t in enumerate(texts):
                    base, more = spans_of(t, model, least)
                    if base:
                        changed[k] = redact(t, ordered(base + more))
                if changed:
                    columns[at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], columns[at].type)
                    for c, f in measures.items():
                        columns[c] = pa.array([f(changed[k]) if k in changed else v for k, v in enumerate(columns[c].to_pylist())], columns[c].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    own = numbered(docs)
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
