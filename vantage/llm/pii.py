"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")  # secrets have no base pattern: all of them are the classifier's

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
_SECRET = re.compile(r"[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_.-]{16,})")

#: Candidate shapes beyond the base patterns.
_MORE = (
    ("phone", re.compile(r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{16,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63})+")),
)

#: Gazetteers of the labelers, cue words near a span, and words that speak against one.
_TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es uk it nl eu us ca au ch at be".split())
_ISSUERS = ("34", "35", "36", "37", "4", "50", "51", "52", "53", "54", "55", "56", "60", "62", "64", "65")
_DIALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91".split())
_CUES = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "adresse"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "appel"),
    "secret": ("api", "auth", "access", "bearer", "export", "config", "private"),
}
_NAMES = ("token", "secret", "key", "passw", "pwd", "credential")
_AGAINST = ("version", "isbn", "serial", "order no", "invoice", "section", "chapter", "release")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind as listed, then start. Linear in the text.

    E-mail addresses are found from their ``@``: the local part is the run of its characters to the
    left, up to the last match, which is where a left-to-right search would have begun.
    """
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if _octets(m[0]):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Votes of the labelers on one candidate: 1 for, 0 against, -1 abstains.

    In order: base pattern, shape, checksum or range, gazetteer, context, boundary.
    """
    s = text[start:end]
    d = _digits(s)
    near = text[max(0, start - 40) : start].lower()
    if kind == "email":
        top = re.split(r"[.)\]\s]+", s)[-1].lower()
        shape, valid, gaz = int(re.search(r"[A-Za-z0-9]", s.split("@")[0]) is not None), int(top.isalpha() and 2 <= len(top) <= 12), 1 if top in _TOP_DOMAINS else -1
    elif kind == "ip":
        parts = s.split(".")
        shape, valid, gaz = int(all(len(p) <= 3 for p in parts)), int(_octets(s)), 1 if parts[0].lstrip("0") and 1 <= int(parts[0][-3:]) <= 223 else 0
    elif kind == "card":
        shape, valid, gaz = int(re.fullmatch(r"[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", s) is not None), int(luhn(d)), 1 if d.startswith(_ISSUERS) else 0
    elif kind == "secret":
        name = near.rstrip(" \t\"'=:")[-12:]
        shape, valid, gaz = int(re.fullmatch(r"[0-9a-fA-F]+|[A-Za-z0-9+_-]+", s) is not None), int(len(set(s.lower())) >= 8), int(any(name.endswith(w) or w in name.split()[-1:] for w in _NAMES))
    else:
        code = re.match(r"\+([0-9]{1,3})", s)
        shape = int(re.fullmatch(r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", s) is not None)
        valid, gaz = int(8 <= len(d) <= 15), (1 if any(code[1].startswith(c) for c in _DIALLING) else 0) if code else -1
    context = 0 if any(w in near for w in _AGAINST) else 1 if any(w in near for w in _CUES[kind]) else -1
    edge = int(not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()))
    return (1 if base else -1, shape, valid, gaz, context, edge)


def features(text: str, kind: str, start: int, end: int, seen: tuple[int, ...]) -> tuple[int, ...]:
    """What the final classifier sees: kind, length class, separators, signs and the non-base votes."""
    s = text[start:end]
    return (
        EVERY.index(kind),
        min(len(_digits(s)), 20),
        int(" " in s) + 2 * int("-" in s) + 4 * int("(" in s) + 8 * int(s[:1] == "+") + 16 * int("@" in s),
        *seen[1:],
    )


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """Base spans, and every candidate as ``(kind, start, end, base, votes, features)``."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    spans = [(k, s, e, True) for k, s, e in base]
    taken = {k: [(s, e) for kk, s, e in base if kk == k] for k in KINDS}
    for kind, pattern in _MORE:
        held, at = sorted(taken[kind]), 0
        for m in pattern.finditer(text):
            s, e = m.span()
            while at < len(held) and held[at][1] <= s:
                at += 1
            if at == len(held) or held[at][0] >= e:
                spans.append((kind, s, e, False))
                taken[kind].append((s, e))
    spans += [("secret", *m.span(1), False) for m in _SECRET.finditer(text) if len(_digits(m[1])) >= 4 and any(c.isalpha() for c in m[1])]
    out = []
    for kind, s, e, is_base in spans:
        v = votes(text, kind, s, e, is_base)
        out.append((kind, s, e, is_base, v, features(text, kind, s, e, v)))
    return base, out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.string())])
_SPAN_DDL = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,features:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            rows.append(
                [
                    {"kind": k, "start": s, "end": e, "base": b, "votes": " ".join(map(str, v)), "features": " ".join(map(str, f))}
                    for k, s, e, b, v, f in candidates(text.as_py() or "")[1]
                ]
            )
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def _scan_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_scan`` of the second column, with both columns kept."""
    for batch in batches:
        for found in _scan(iter([batch])):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found.column(1)], names=["row", "text", "spans"])


def estimate_reliabilities(table: np.ndarray, counts: np.ndarray, rounds: int = 50) -> dict:
    """Two-class EM over vote patterns: ``table`` holds -1, 0, 1 by labeler, ``counts`` how often each was seen.

    Gives the class prior, each labeler's chance to vote 1 on a true and on a false span (counts of one
    are added), and the posterior of each pattern. Labelers are taken to be right at first.
    """
    if not len(table):
        return {"prior": 0.5, "true": np.full(0, 0.5), "false": np.full(0, 0.5), "posterior": np.zeros(0)}
    n = table.shape[1]
    true, false, prior = np.full(n, 0.85), np.full(n, 0.25), 0.7
    on, off = table == 1, table == 0
    for _ in range(rounds):
        up = np.log(prior) + on @ np.log(true) + off @ np.log(1 - true)
        down = np.log(1 - prior) + on @ np.log(false) + off @ np.log(1 - false)
        p = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        yes, no = p * counts, (1 - p) * counts
        prior = (yes.sum() + 1) / (counts.sum() + 2)
        true = (yes @ on + 4) / (yes @ (on | off) + 5)
        false = (no @ on + 1) / (no @ (on | off) + 4)
    return {"prior": prior, "true": true, "false": false, "posterior": p}


def _active(patterns: list[tuple[int, ...]]) -> tuple[np.ndarray, int]:
    """Of each pattern, the columns that are one: each feature's value, the same by kind, and a constant; and how many there are."""
    index: dict = {}
    rows = [[index.setdefault(x, len(index)) for i, v in enumerate(f) for x in ((i, v), ("kind", f[0], i, v))] for f in patterns]
    return np.array([[*r, len(index)] for r in rows], np.int64), len(index) + 1


def train_classifier(patterns: list[tuple[int, ...]], positive: np.ndarray, counts: np.ndarray, l2: float = 1.0, rounds: int = 30, block: int = 4096) -> np.ndarray:
    """Logistic regression (Newton steps) on soft labels, by feature pattern; the patterns' probabilities.

    Patterns are laid out in blocks; of all of them only the numbers of their columns are held."""
    if not patterns:
        return np.zeros(0)
    active, width = _active(patterns)
    w = np.zeros(width)

    def chances() -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(w[active].sum(1), -30, 30)))

    for _ in range(rounds):
        p = chances()
        grad, hess = -l2 * w, l2 * np.eye(width)
        for at in range(0, len(active), block):
            some = active[at : at + block]
            x = np.zeros((len(some), width))
            x[np.arange(len(some))[:, None], some] = 1
            q, n = p[at : at + block], counts[at : at + block]
            grad = grad + x.T @ (positive[at : at + block] - n * q)
            hess += (x * (n * q * (1 - q))[:, None]).T @ x
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return chances()


def fit(scanned: DataFrame) -> dict[str, float]:
    """Probability of each feature pattern. Only counts by pattern leave the executors, and there are
    few patterns whatever the corpus: three votes to the sixth power by five kinds at most, and lengths
    and separators of bounded range."""
    rows = scanned.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    if not rows:
        return {}
    belief: dict[tuple, float] = {}
    for kind in EVERY:
        seen: dict[tuple[int, ...], int] = {}
        for r in rows:
            if r["kind"] == kind:
                v = tuple(map(int, r["votes"].split()))
                seen[v] = seen.get(v, 0) + r["n"]
        patterns = sorted(seen)
        if patterns:
            post = estimate_reliabilities(np.array(patterns), np.array([seen[v] for v in patterns], float))["posterior"]
            belief |= {(kind, v): p for v, p in zip(patterns, post)}
    total: dict[tuple[int, ...], list[float]] = {}
    for r in rows:
        f = tuple(map(int, r["features"].split()))
        p = belief[r["kind"], tuple(map(int, r["votes"].split()))]
        t = total.setdefault(f, [0.0, 0.0])
        t[0] += p * r["n"]
        t[1] += r["n"]
    patterns = sorted(total)
    prob = train_classifier(patterns, np.array([total[f][0] for f in patterns]), np.array([total[f][1] for f in patterns]))
    return {" ".join(map(str, f)): float(p) for f, p in zip(patterns, prob)}


def _decide(prob: dict[str, float], threshold: float):
    order = {k: i for i, k in enumerate(EVERY)}

    def text_of(spans: list) -> str:
        return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_n, more_n, digest, joined, secrets = [], [], [], [], []
            for spans in batch.column(1).to_pylist():
                spans = sorted(spans or [], key=lambda s: (order[s["kind"]], s["start"], s["end"]))
                base = [s for s in spans if s["base"]]
                every = [s for s in spans if s["base"] or prob.get(s["features"], 0.0) >= threshold]
                kept = [s for s in every if s["kind"] != "secret"]
                base_n.append([sum(s["kind"] == k for s in base) for k in KINDS])
                more_n.append([len(kept) - len(base), len(every) - len(kept), len(every)])
                digest.append(hashlib.sha256(text_of(base).encode()).hexdigest())
                joined.append(text_of(kept))
                secrets.append(text_of(every[len(kept) :]))
            n, more = np.array(base_n, np.int64).reshape(-1, len(KINDS)), np.array(more_n, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in n.T.copy()], pa.array(digest, pa.string()), pa.array(joined, pa.string()), *[pa.array(c) for c in more.T.copy()], pa.array(secrets, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_secret", "n_spans", "secrets"],
            )

    return run


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal-data spans of every text.

    Returns doc_id, n_email, n_ip, n_card and n_phone (spans of the base patterns), base_sha256 (of
    those spans), spans (they and what the classifier adds, ``kind:start:end`` by kind, then start; in code
    points, end exclusive), n_added, n_secret, n_spans (base, added and secret ones) and secrets (spans of
    tokens and keys, which have no base pattern). Base spans always stay; an added span overlaps no other of its
    kind. A null or empty text has none. A text is read whole, in time linear in its length. Rows with null or
    equal ids are judged each on its own. An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = materialize(rows.mapInArrow(_scan, f"doc_id {kind}, spans {_SPAN_DDL}"), "spans")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    shape = f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long, n_secret long, n_spans long, secrets string"
    return scanned.mapInArrow(_decide(fit(scanned), threshold), shape)


def redact(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span that ``find_pii`` finds, secrets included, replaced by its kind in angle brackets.

    Overlapping spans are replaced together, by the kind of the first. Other columns stay as they are, whatever
    their names, but for ``length_col``, which gets the new number of code points where it is given and
    there. Null texts stay null; repeated rows are all cleaned; an empty table gives an empty table. Rows
    are written with their spans, so texts are scanned once.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kept = whole.schema["row"].dataType.simpleString()
    scanned = materialize(whole.mapInArrow(_scan_beside, f"row {kept}, text string, spans {_SPAN_DDL}"), "spans")
    prob = fit(scanned)

    def clean(text: str | None, spans: list) -> str | None:
        out, done = [], 0
        for s, e, k in sorted((x["start"], x["end"], x["kind"]) for x in spans if x["base"] or prob.get(x["features"], 0.0) >= threshold):
            if s >= done:
                out += [text[done:s], f"<{k.upper()}>"]
            done = max(done, e)
        return "".join([*out, text[done:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t.as_py(), x.as_py()) for t, x in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "cleaned"])

    out = scanned.mapInArrow(run, f"row {kept}, cleaned string")
    changed = {text_col: F.col("cleaned").cast(docs.schema[text_col].dataType)}
    if length_col and length_col in docs.columns:
        changed[length_col] = F.length("cleaned").cast(docs.schema[length_col].dataType)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
