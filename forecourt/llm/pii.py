"""Personal data by weak supervision.

Candidates come from two generators per kind: the strict pattern, whose checked matches are always reported (the base),
and looser shapes.  Five labelers vote on each candidate (personal, not personal, or no vote): the strict pattern, a
validity check, a gazetteer, the words before it, and the characters around it.  Expectation-maximisation estimates how
reliable each labeler is, without labels, and gives each candidate a probability.  On these a logistic classifier over
votes and shape features is trained; it decides which looser candidates are reported too.

Only counts of (kind, votes, shape) patterns leave the scan.  They cover every candidate of every text, and there are at
most `PATTERNS` of them, so estimating on the driver needs a bounded amount of memory.  Texts are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.frames import col, text_of, whole_row, with_text

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "validity", "gazetteer", "words before", "surroundings")
SHAPES = ("separated", "bracketed", "long", "line start")
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 2 ** len(SHAPES)
THRESHOLD = 0.5

# Public lists that serve as gazetteers.
DOMAIN_ENDINGS = frozenset(
    "com org net edu gov mil int info biz io dev app ai co us uk de fr es it nl be ch at se no dk fi pl pt ie cz gr ru "
    "ua tr in cn jp kr au nz za br mx ar cl ca eu".split()
)
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 971 972".split()
)
CARD_PREFIXES = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|64[4-9]|65|62")
UNROUTABLE = re.compile(r"0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|22[4-9]\.|2[3-5]\d\.")
TRIGGERS = {
    "email": "email e-mail mail mailto contact write correo courriel kontakt",
    "ip": "ip ipv4 ipv6 address addr host from client adresse",
    "card": "card visa mastercard amex credit debit payment tarjeta carte karte",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon teléfono téléphone",
}
DISTRACTORS = "isbn issn doi version build serial order invoice ref id hash token key sku part model ticket"

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A run of digits that fails from its start fails from inside too, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(
        r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}"
        r"(?:(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)[A-Za-z0-9-]{1,63}){1,5}",
        re.I,
    ),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:.])"),
    "card": re.compile(r"(?<![\w./])[0-9]{4}(?:([./_])[0-9]{4})(?:\1[0-9]{4}){2}(?![\w/])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
}
# A cheap necessary condition of each looser shape.
_LOOSE_HINT = {
    "email": re.compile(r"[(\[{]\x20?at\x20?[)\]}]", re.I),
    "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": re.compile(r"[0-9]{4}[./_][0-9]{4}"),
    "phone": re.compile(r"[0-9][\x20.-][0-9]{4}"),
}


def digits_of(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern.  No character before an @ can be one itself, so the local part is the longest run
    that ends there, and each @ is tried once."""
    begin, at = 0, text.find("@")
    while at >= 0:
        reach = 64
        while True:
            low = max(begin, at - reach)
            run = _EMAIL_LOCAL.match(text[low:at][::-1])
            if not run or run.end() < at - low or low == begin:
                break
            reach *= 4
        domain = _EMAIL_DOMAIN.match(text, at + 1) if run else None
        if domain:
            yield at - run.end(), domain.end()
        begin = domain.end() if domain else at + 1
        at = text.find("@", begin)


def _ip_ok(found: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in found.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the strict patterns' matches that pass their check, by kind and start."""
    spans = [("email", i, j) for i, j in _emails(text)]
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return spans


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the looser shapes that touch no span of `taken`."""
    out = []
    for kind, pattern in _LOOSE.items():
        if _LOOSE_HINT[kind].search(text):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    ends = sorted((i, j) for _, i, j in taken)
    if not ends or not out:
        return out
    starts = [i for i, _ in ends]
    reach = np.maximum.accumulate([j for _, j in ends])
    # The last taken span that starts before the candidate's end must end before its start.
    last = np.searchsorted(starts, [j for _, _, j in out], side="left") - 1
    return [s for s, k in zip(out, last) if k < 0 or reach[k] <= s[1]]


_WORDS_BEFORE = re.compile(r"[^\W_]+(?:-[^\W_]+)?")
_TRIGGER_SETS = {k: frozenset(v.split()) for k, v in TRIGGERS.items()}
_DISTRACTOR_SET = frozenset(DISTRACTORS.split())


def _validity(kind: str, found: str) -> int:
    digits = digits_of(found)
    if kind == "email":
        return 1 if re.search(r"[A-Za-z]{2,}\Z", found) else -1
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "ip":
        return 1
    if found.startswith("+"):
        return 1 if 9 <= len(digits) <= 15 else -1
    return 1 if digits[0] not in "01" and digits[3] not in "01" else -1


def _gazetteer(kind: str, found: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z]+", found.rstrip(")]}"))[-1].lower() in DOMAIN_ENDINGS else -1
    if kind == "ip":
        return -1 if UNROUTABLE.match(found) else 1
    if kind == "card":
        return 1 if CARD_PREFIXES.match(digits_of(found)) else -1
    if found.startswith("+"):
        return 1 if any(digits_of(found)[:n] in CALLING_CODES for n in (1, 2, 3)) else -1
    return 0


def evidence(text: str, kind: str, start: int, end: int, is_base: bool) -> int:
    """The pattern number of a candidate: its kind, votes and shape."""
    found = text[start:end]
    words = [w.lower() for w in _WORDS_BEFORE.findall(text[max(0, start - 32) : start])][-3:]
    if any(w in _DISTRACTOR_SET for w in words):
        context = -1
    else:
        context = 1 if any(w in _TRIGGER_SETS[kind] for w in words) else 0
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    votes = (
        1 if is_base else 0,
        _validity(kind, found),
        _gazetteer(kind, found),
        context,
        -1 if any(c.isalnum() or c in "_=/#" for c in around) else 1,
    )
    shape = (
        any(c in " .-" for c in found),
        any(c in "()[]{}" for c in found),
        len(found) > 20,
        start == 0 or text[start - 1] == "\n",
    )
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v + 1
    for s in shape:
        code = code * 2 + s
    return code


def decode_pattern(code: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes and shape of a pattern number."""
    shape, votes = [], []
    for _ in SHAPES:
        code, s = divmod(code, 2)
        shape.append(s)
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], shape[::-1]


def aggregate_votes(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that a candidate with these votes is personal data, by expectation-maximisation.

    For either truth each labeler has its own probabilities of its three answers, and each kind its own share of
    personal data.  It starts from the majority vote; counts are smoothed by one.
    """
    answers = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, answer
    p = 1 / (1 + np.exp(-votes.sum(axis=1)))
    for _ in range(rounds):
        likelihood = []
        for q in (1 - p, p):
            tally = np.einsum("n,nla->la", counts * q, answers) + 1
            likelihood.append(np.einsum("nla,la->n", answers, np.log(tally / tally.sum(axis=1, keepdims=True))))
        for kind in np.unique(kinds):
            at = kinds == kind
            share = ((counts * p)[at].sum() + 1) / (counts[at].sum() + 2)
            likelihood[1][at] += np.log(share)
            likelihood[0][at] += np.log(1 - share)
        p = 1 / (1 + np.exp(np.clip(likelihood[0] - likelihood[1], -50, 50)))
    return p


def features(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    kind = np.eye(len(KINDS))[kinds]
    return np.hstack([kind, votes > 0, votes < 0, shapes]).astype(float)


def fit_classifier(x: np.ndarray, p: np.ndarray, counts: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model trained on probabilities, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - guess)) - ridge * w
        curvature = (x * (counts * guess * (1 - guess))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
    return w


def fit(docs: DataFrame, text_col: str = "text") -> dict[int, float]:
    """Probability of every pattern number that occurs in the texts, by the trained classifier."""

    @F.pandas_udf("array<int>")
    def patterns(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_patterns(t) for t in texts], dtype=object)

    seen = docs.select(F.explode(patterns(text_of(text_col))).alias("pattern"))
    rows = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most PATTERNS rows
    if not rows:
        return {}
    codes, counts = zip(*sorted(rows))
    decoded = [decode_pattern(c) for c in codes]
    kinds = np.array([k for k, _, _ in decoded])
    votes = np.array([v for _, v, _ in decoded])
    shapes = np.array([s for _, _, s in decoded])
    weight = np.array(counts, dtype=float)
    x = features(kinds, votes, shapes)
    w = fit_classifier(x, aggregate_votes(kinds, votes, weight), weight)
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def _patterns(text: str) -> list[int]:
    base = base_spans(text)
    loose = loose_spans(text, base)
    return [evidence(text, *s, True) for s in base] + [evidence(text, *s, False) for s in loose]


def all_spans(text: str, model: dict[int, float], threshold: float) -> list[tuple[int, int, int, bool, float]]:
    """Kind number, start, end, is base, probability; by kind and start."""
    base = base_spans(text)
    out = [(s, True, model.get(evidence(text, *s, True), 1.0)) for s in base]
    for s in loose_spans(text, base):
        p = model.get(evidence(text, *s, False), 0.0)
        if p >= threshold:
            out.append((s, False, p))
    return sorted((KINDS.index(k), i, j, b, p) for (k, i, j), b, p in out)


def masked(text: str, spans: list[tuple[int, int, int, bool, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are masked as one."""
    if not spans:
        return text
    out, done = [], 0
    for kind, i, j, _, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if i >= done:
            out += [text[done:i], f"<{KINDS[kind].upper()}>"]
        done = max(done, j)
    return "".join(out) + text[done:]


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base, probability), by kind as in KINDS and start; one row per row.

    Positions count code points, `end` is exclusive.  `base` marks matches of the strict patterns; they are always
    there.  NULL text counts as empty and has no spans.  Texts without candidates give an empty model and no spans.
    Repeated rows count in the estimates and give equal rows; an empty table gives none.  Other columns are not read.
    """
    model = fit(docs, text_col)
    fields = "array<struct<kind: int, start: bigint, end: bigint, base: boolean, probability: double>>"

    @F.pandas_udf(fields)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "probability")
        for texts in batches:
            yield pd.Series(
                [[dict(zip(names, s)) for s in all_spans(t, model, threshold)] for t in texts], dtype=object
            )

    named = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform("spans", lambda s: s.withField("kind", F.get(named, s["kind"])))
    return docs.select(col(id_col).alias("doc_id"), find(text_of(text_col)).alias("spans")).select(
        "doc_id", spans.alias("spans")
    )


def mask_documents(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the same columns, personal data masked and `n_chars` recomputed."""
    model = fit(docs, text_col)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([masked(t, all_spans(t, model, threshold)) for t in texts], dtype=object)

    rows = docs.select(whole_row(docs).alias("row"), mask(text_of(text_col)).alias("text"))
    return rows.select(*with_text(docs, "row", F.col("text"), text_col))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, SHA-256 of the base spans and all spans as text."""

    def as_text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans")
    )
