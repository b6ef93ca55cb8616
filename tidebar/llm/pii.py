"""Personal data by weak supervision.

Candidates come from wide patterns (the base ones and written-out or national forms). For each, four labelers vote -1, 0
or +1: a strict pattern, a gazetteer (endings of domains, given names, street words, area codes, checksums), context words
before the span, and the span's borders. Votes of all documents are counted by kind and pattern of votes (at most
81 rows a kind), and expectation-maximisation over these counts estimates, for each kind and labeler, how it votes on true
and false candidates. A logistic span classifier is then trained on the posteriors: it reads kind and votes, and besides them
the span's shape (length, digits, capitals, separators) and the word before it (hashed), which the labelers don't see, and so
learns from all documents which shapes and contexts go with true candidates. Its counts are by these features, whose
combinations bound them. Each candidate with a probability of at least one half is added. Base matches always stay.

Null texts count as empty: no spans; very long texts are read whole. Ties of overlapping candidates go to the one that starts
first, then the longer one. Repeated rows are judged one by one; empty tables give empty results; ids may be null or repeat;
columns of other names play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import cut

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "name", "address", "secret")
N_LABELERS = 4
#: Values of a span's shape, and hashes of the word before it.
N_SHAPES, N_WORDS = 24, 32

#: Gazetteers and context words.
ENDINGS = frozenset("ai app at au be biz br ca ch cn co com cz de dev dk edu es eu fi fr gov gr hu ie in info int io it jp kr me mil mx name net nl no nz org pl pro pt ro ru se sk tv uk us za".split())
GIVEN_NAMES = frozenset(
    "alex alice amy andrea andrew angela anna anne anthony barbara benjamin brian carl carlos carol caroline catherine charles charlotte christine christopher claire daniel david deborah diana donald dorothy edward elena elizabeth emily emma eric eva frank gary george hannah hans helen henry jack jacob james jane jason jean jeffrey jennifer jessica joan john jonathan jose joseph juan julia karen karl kate kevin klaus laura lauren linda lisa louis lucas lucy luis maria marie mark martin mary matthew melissa michael michelle miguel monica nancy nicholas nicole olivia pablo patricia patrick paul pedro peter philip pierre rachel rebecca richard robert roger ronald rosa ruth ryan samuel sandra sarah scott sharon simon sophia sophie stefan stephen steven susan teresa thomas timothy victoria walter william".split()
)
STREET_WORDS = frozenset("street st avenue ave road rd lane ln drive dr boulevard blvd court ct square sq way".split())
CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "mastercard", "pay", "credit"),
    "phone": ("call", "phone", "tel", "mobile", "cell", "fax", "contact", "text", "dial"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "bank"),
    "name": ("name", "mr", "mrs", "ms", "dr", "prof", "dear", "contact", "sincerely", "regards"),
    "address": ("address", "live", "lives", "resid", "ship to", "located"),
    "secret": ("token", "key", "secret", "password", "passwd"),
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9][0-9 .()-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9])(?:00[ .-]?[1-9][0-9]{0,2}[ .-]|1[ .-])?(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])")
_SSN = re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"[0-9]{1,5} (?:[A-Z][a-z]+ ){1,2}([A-Z][a-z]+)\b")
_SPELLED = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?(\[at\]|\(at\)|\{at\}| at ) ?([A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]+)*) ?(\[dot\]|\(dot\)|\{dot\}| dot ) ?([A-Za-z]{2,10})\b", re.I)
_DOT = re.compile(r"[ \[({]dot[ \])}]", re.I)
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? ((?:[A-Z]\w+)(?: [A-Z]\w+)?)")
_NAMED = re.compile(r"\b(?:[Mm]y name is|[Nn]ame:|Dear|Sincerely,|Regards,)\s+((?:[A-Z]\w+)(?: [A-Z]\w+)?)")
_BEFORE = re.compile(r"[^\W\d_]+")
_ACCESS_KEY = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"\b(token|key|secret|password|passwd)\b[\"']?\s?[=:]\s?[\"']?([A-Za-z0-9_+/-]{16,})", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str, chunks: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """chunks: runs of digits, spaces, dots, brackets and hyphens that begin with a digit."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        head = text[free:at]
        local = len(head) - len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            out["email"].append((at - local, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    for low, high in chunks:
        if high - low < 7:
            continue
        for m in _IP.finditer(text, low, high):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        if high - low >= 16:
            for m in _CARD.finditer(text, low, high):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out["card"].append(m.span())
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out["phone"].append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return out


def _near_dots(text: str) -> Iterator[tuple[int, int]]:
    """Where spelled-out addresses can stand: from 160 characters before each 'dot' to 12 after it, as one where they overlap."""
    low, high = 0, -1
    for d in _DOT.finditer(text):
        if d.start() - 160 > high:
            if high >= 0:
                yield low, high
            low = max(0, d.start() - 160)
        high = min(len(text), d.end() + 12)
    if high >= 0:
        yield low, high


def _wide(text: str, chunks: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """Candidates besides the base ones: kind, start, end, and the votes of the strict pattern and the gazetteer."""
    for low, high in chunks:
        begin = low - 1 if low and text[low - 1] == "(" else low
        if high - low >= 9:
            for m in _SSN.finditer(text, low, high):
                area, group, serial = m[0].split("-")
                yield "ssn", *m.span(), 1, 1 if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else -1
            for m in _NATIONAL.finditer(text, begin, high):
                digits = re.sub("[^0-9]", "", m[1])
                yield "phone", *m.span(), 1 if "(" in m[1] or m[1].count("-") == 2 or m[1].count(".") == 2 else 0, 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
        # Only the last number of a run has a word after it.
        head = text[low : high - 1]
        m = _ADDRESS.match(text, low + len(head.rstrip("0123456789"))) if text[high - 1] == " " else None
        if m:
            yield "address", *m.span(), 0, 1 if m[1].lower() in STREET_WORDS else -1
        if low >= 2 and text[low - 2 : low].isupper():
            m = _IBAN.match(text, low - 2)
            if m:
                yield "iban", *m.span(), 1, 1 if _iban_ok(m[0]) else -1
    for low, high in _near_dots(text) if "dot" in text or "DOT" in text or "Dot" in text else ():
        for m in _SPELLED.finditer(text, low, high):
            strict = (m[2].strip()[0] in "[({") + (m[4].strip()[0] in "[({")
            yield "email", *m.span(), 1 if strict else 0, 1 if m[5].lower() in ENDINGS else -1
    for mark, pattern in (("Mr", _TITLED), ("Ms", _TITLED), ("Dr", _TITLED), ("Prof", _TITLED), ("ame", _NAMED), ("Dear", _NAMED), ("gards,", _NAMED), ("cerely,", _NAMED)):
        if mark in text:
            for m in pattern.finditer(text):
                yield "name", *m.span(1), 1 if " " in m[1] else 0, 1 if m[1].split()[0].lower() in GIVEN_NAMES else -1
    if "AKIA" in text:
        for m in _ACCESS_KEY.finditer(text):
            yield "secret", *m.span(), 1, 1
    low_text = text.lower()
    if any(w in low_text for w in ("token", "key", "secret", "passw")):
        for m in _SECRET.finditer(text):
            mixed = any(c.isdigit() for c in m[2]) and any(c.isalpha() for c in m[2])
            yield "secret", *m.span(2), 1 if mixed else -1, 1 if len(set(m[2])) >= 8 else -1


def shape_of(span: str) -> int:
    """Length (under 12, under 20, longer), and whether there are digits, capitals, separators."""
    return 8 * ((len(span) >= 12) + (len(span) >= 20)) + 4 * any(x.isdigit() for x in span) + 2 * any(x.isupper() for x in span) + any(x in " -.:" for x in span)


def word_before(text: str, start: int) -> int:
    """A hash of the last word before a span, 0 where there is none."""
    words = _BEFORE.findall(text[max(0, start - 24) : start].lower())
    return 1 + zlib.crc32(words[-1].encode()) % (N_WORDS - 1) if words else 0


def candidates(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, int, int, int, bool]]]:
    """Base spans, and all candidates as (kind, start, end, code of the votes, code of shape and word before, whether base)."""
    chunks = [m.span() for m in _DIGITS.finditer(text)]
    base = base_spans(text, chunks)
    found = {(k, s, e): (1, 1 if k != "email" or text[s:e].rpartition(".")[2].lower() in ENDINGS else -1, True) for k in BASE_KINDS for s, e in base[k]}
    for k, s, e, strict, known in _wide(text, chunks):
        found.setdefault((k, s, e), (strict, known, False))
    out = []
    for (k, s, e), (strict, known, is_base) in found.items():
        before = text[max(0, s - 40) : s].lower()
        cue = 1 if any(w in before for w in CUES[k]) else 0
        border = -1 if (s and (text[s - 1].isalnum() and text[s].isalnum())) or (e < len(text) and text[e].isalnum()) else 1
        code = 0
        for vote in (strict, known, cue, border):
            code = 3 * code + vote + 1
        out.append((KINDS.index(k), s, e, code, N_WORDS * shape_of(text[s:e]) + word_before(text, s), is_base))
    return base, sorted(out)


def votes_of(code: int) -> list[int]:
    out = []
    for _ in range(N_LABELERS):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def reliabilities(counts: dict[tuple[int, int], float], rounds: int = 50) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """Expectation-maximisation over counts by (kind, code): the posterior of each, and the chances of each vote by kind, truth and labeler.

    Each kind starts from the same pseudo-counts: a labeler is right four times in five, and half of the candidates are true.
    """
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys], float)
    kind = np.array([k for k, _ in keys], int)
    votes = np.array([votes_of(c) for _, c in keys], int).reshape(-1, N_LABELERS) + 1
    fixed = np.zeros((len(KINDS), 2, N_LABELERS, 3)) + 1.0
    fixed[:, 1, :, 2], fixed[:, 0, :, 0], fixed[:, :, :, 1] = 4.0, 4.0, 2.0
    posterior = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(1))) if len(keys) else np.zeros(0)
    chance = fixed / fixed.sum(-1, keepdims=True)
    for _ in range(rounds):
        seen, share = fixed.copy(), np.full((len(KINDS), 2), 5.0)
        for truth, part in ((1, weight * posterior), (0, weight * (1 - posterior))):
            np.add.at(share, (kind, truth), part)
            for j in range(N_LABELERS):
                np.add.at(seen, (kind, truth, j, votes[:, j]), part)
        chance = seen / seen.sum(-1, keepdims=True)
        log = np.log(share / share.sum(1, keepdims=True))
        odds = log[kind, 1] - log[kind, 0]
        for j in range(N_LABELERS):
            odds = odds + np.log(chance[kind, 1, j, votes[:, j]]) - np.log(chance[kind, 0, j, votes[:, j]])
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, posterior.tolist(), strict=True)), chance


def features(keys: list[tuple[int, int, int]]) -> np.ndarray:
    """A row for each (kind, votes, shape and word): kind, both signs of each vote, shape and word, each as its own column."""
    kind, code, seen = (np.array([k[j] for k in keys], int) for j in range(3))
    votes = np.array([votes_of(x) for x in code.tolist()], int).reshape(-1, N_LABELERS)
    return np.hstack([np.eye(len(KINDS))[kind], votes == 1, votes == -1, np.eye(N_SHAPES)[seen // N_WORDS], np.eye(N_WORDS)[seen % N_WORDS]]).astype(float)


def fit_classifier(counts: dict[tuple[int, int, int], float], posterior: dict[tuple[int, int], float], rounds: int = 60, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic classifier, by Newton steps on posteriors weighted by the log of the counts, from votes that add up."""
    keys = sorted(counts)
    beta = np.zeros(len(KINDS) + 2 * N_LABELERS + N_SHAPES + N_WORDS)
    beta[len(KINDS) : len(KINDS) + N_LABELERS] = 1.0
    beta[len(KINDS) + N_LABELERS : len(KINDS) + 2 * N_LABELERS] = -1.0
    prior = beta.copy()
    if not keys:
        return beta
    x, y, w = features(keys), np.array([posterior[k[:2]] for k in keys]), np.array([1 + np.log(counts[k]) for k in keys])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * (beta - prior)
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge * np.eye(len(beta)), grad)
        beta += np.clip(step, -2, 2)
    return beta


_SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, cands array<struct<kind:int,start:int,stop:int,code:int,seen:int,base:boolean>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("code", pa.int32()), ("seen", pa.int32()), ("base", pa.bool_())]))
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                counts: list[list[int]] = [[] for _ in BASE_KINDS]
                shas, cands = [], []
                for text in batch.column(1).to_pylist():
                    base, found = candidates(text or "")
                    for k, name in enumerate(BASE_KINDS):
                        counts[k].append(len(base[name]))
                    shas.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in base[k]).encode()).hexdigest())
                    cands.append([dict(kind=k, start=s, stop=e, code=c, seen=x, base=b) for k, s, e, c, x, b in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(cands, kind)], names=[f.partition(" ")[0] for f in _SCAN.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCAN)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: base counts, base_sha256, and found: array of (kind, start, end, p, base), non-overlapping outside base."""
    scanned = cut(scan(docs, id_col, text_col), "pii")
    grouped = scanned.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.code", "c.seen").count()
    counts = {(r["kind"], r["code"], r["seen"]): float(r["count"]) for r in grouped.collect()}  # bounded by the features' combinations
    by_votes: dict[tuple[int, int], float] = {}
    for key, n in counts.items():
        by_votes[key[:2]] = by_votes.get(key[:2], 0.0) + n
    posterior, _ = reliabilities(by_votes)
    beta = fit_classifier(counts, posterior)
    keys = sorted(counts)
    chance = dict(zip(keys, (1 / (1 + np.exp(-np.clip(features(keys) @ beta, -30, 30)))).tolist(), strict=True)) if keys else {}
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind:string,start:int,stop:int,p:double,base:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for cands in batch.column(6).to_pylist():
                took = [c for c in cands if c["base"]]
                for c in sorted((c for c in cands if not c["base"] and chance[c["kind"], c["code"], c["seen"]] >= 0.5), key=lambda c: (c["start"], -c["stop"])):
                    if all(c["stop"] <= t["start"] or t["stop"] <= c["start"] for t in took):
                        took.append(c)
                took.sort(key=lambda c: (c["kind"], c["start"]))
                out.append([dict(kind=KINDS[c["kind"]], start=c["start"], stop=c["stop"], p=chance[c["kind"], c["code"], c["seen"]], base=c["base"]) for c in took])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, kind)], names=[f.partition(" ")[0] for f in schema.split(", ")][:6] + ["found"])

    return scanned.mapInArrow(run, schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = F.concat_ws(",", F.transform("found", lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string"))))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"), F.size("found").cast("long").alias("n_spans"))
