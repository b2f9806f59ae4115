"""Secret scans: patterns, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.automata import ProbabilisticAutomaton
from quillspark.llm.batches import sliced, texts
from quillspark.llm.compression import drawn, piece
from quillspark.llm.shared import removed, written
from quillspark.sources.tables import table

KINDS = ("assign", "access", "hex")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What the automata look at: runs of a credential's symbols, with the padding behind them; of a run every stretch of so many
#: symbols at least that begins and ends at the run's ends or at one of these signs.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}")
_SIGNS = re.compile(r"[+/_.=-]")
SHORTEST = 16
#: Runs of so many symbols are judged once and remembered, so many of them.
REMEMBERED, RUNS = 256, 50_000

#: Labelled credentials of each kind to infer from, and the bits by which a format must beat ordinary text.
EXAMPLES, MARGIN = 1000, 24.0
#: Ordinary text to infer from: pieces of so many documents, so many characters of each, so many runs in all.
PLAIN_TEXTS, PLAIN_CHARS, PLAIN_RUNS = 300, 400, 1500

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_ALNUM = _DIGITS + _LOWER + _UPPER
# Credential formats as (label, fixed start, symbols, lengths).
FORMATS = (
    ("hex-key", "", "0123456789abcdef", (32, 40, 64)),
    ("access-key", "AKIA", _UPPER + "234567", (16,)),
    ("cloud-secret", "", _ALNUM + "+/", (40,)),
    ("api-key", "AIza", _ALNUM + "_-", (35,)),
    ("code-token", "ghp_", _ALNUM, (36,)),
    ("payment-key", "sk_live_", _ALNUM, (24,)),
    ("model-key", "sk-", _ALNUM, (48,)),
    ("chat-token", "xoxb-", _DIGITS + "-" + _ALNUM, (40, 50)),
    ("web-token", "eyJhbGciOiJIUzI1NiJ9.", _ALNUM + "_-.", (60, 80)),
)


def labelled_credentials(count: int = EXAMPLES, seed: int = 1) -> dict[str, list[str]]:
    """Examples of each format, drawn by its rule; equal seeds give equal examples."""
    rng = random.Random(seed)
    return {
        label: [start + "".join(rng.choices(symbols, k=rng.choice(lengths))) for _ in range(count)]
        for label, start, symbols, lengths in FORMATS
    }


def ordinary_runs(count: int = EXAMPLES, seed: int = 2) -> dict[str, list[str]]:
    """Runs that are no secrets: numbers, dates, addresses of hosts, names joined by signs."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choices(_DIGITS, k=k))
    name = lambda: "".join(rng.choices(_LOWER, k=rng.randint(2, 10)))
    return {
        "numbers": [rng.choice(["", "-", "+"]) + rng.choice(["", ".", "-"]).join(number(rng.randint(2, 6)) for _ in range(rng.randint(3, 5))) for _ in range(count)],
        "names": [rng.choice(".-_/").join(name() + rng.choice(["", "", number(2)]) for _ in range(rng.randint(2, 6))) for _ in range(count)],
    }


@dataclass(frozen=True)
class Detector:
    """Automata of credential formats and of ordinary text."""

    formats: tuple[tuple[str, ProbabilisticAutomaton], ...]
    ordinary: tuple[ProbabilisticAutomaton, ...]

    @classmethod
    def learned(cls, credentials: dict[str, list[str]], ordinary: dict[str, list[str]]) -> Detector:
        """One automaton for each label, those of credentials with their lengths; labels without examples are left out."""
        infer = ProbabilisticAutomaton.inferred
        return cls(
            tuple((label, infer(found, lengths=True)) for label, found in sorted(credentials.items()) if found),
            tuple(infer(found) for _, found in sorted(ordinary.items()) if found),
        )

    def plain(self, text: str) -> float:
        return min((a.bits(text) for a in self.ordinary), default=8.0 * len(text))

    def found(self, run: str) -> list[tuple[int, int, str]]:
        """(start, end, label) of the stretches of a run that a format explains by MARGIN bits better than ordinary text,
        those of the greatest gain first, none over another."""
        signs = [m.start() for m in _SIGNS.finditer(run)]
        # A sign may be part of a credential, so stretches begin at it or after it, and end before it or with it.
        begins = sorted({0, *signs, *(k + 1 for k in signs)})
        stops = sorted({len(run), *signs, *(k + 1 for k in signs)})
        best: dict[tuple[int, int], tuple[float, str]] = {}
        for start in begins:
            ends = stops[bisect_left(stops, start + SHORTEST) :]
            for label, automaton in self.formats if ends else ():
                for end, bits in automaton.bits_to(run, start, ends):
                    best[start, end] = min(best.get((start, end), (bits, label)), (bits, label))
        gains = [(self.plain(run[a:b]) - bits, a, b, label) for (a, b), (bits, label) in best.items()]
        taken: list[tuple[int, int, str]] = []
        for gain, a, b, label in sorted(gains, key=lambda g: (-g[0], g[1], -g[2])):
            if gain >= MARGIN and not any(x < b and a < y for x, y, _ in taken):
                taken.append((a, b, label))
        return sorted(taken)

    def label(self, text: str) -> str | None:
        """The format of a text that is a credential as a whole."""
        return next((label for a, b, label in self.found(text) if (a, b) == (0, len(text))), None)


def found_credentials(docs: DataFrame, count: int = EXAMPLES) -> dict[str, list[str]]:
    """Credentials that the patterns find in the texts (doc_id, text), labelled by their kinds: of each kind those distinct
    ones with the least hashes, so many at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(f"like-{kind}", value) for text in texts(batch).to_pylist() for kind, value in base_values(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["label", "value"])

    found, path = written(docs.select("text").mapInArrow(run, "label string, value string").distinct(), "secret-values")
    out: dict[str, list[str]] = {}
    for label, value in sorted(map(tuple, drawn(found, "label", F.col("value"), count).collect())):
        out.setdefault(label, []).append(value)
    removed(docs.sparkSession, path)
    return out


def plain_runs(docs: DataFrame) -> list[str]:
    """Runs of letters in a bounded sample of the texts (doc_id, text), with up to three in a row joined, as ordinary
    text's candidates are long words or chains of words."""
    known = docs.filter("text is not null").select("doc_id", "text", F.lit(0).alias("all"))
    rows = drawn(known, "all", F.struct("doc_id", "text"), PLAIN_TEXTS).select(piece(F.col("text"), PLAIN_CHARS)).collect()
    words = [w for (text,) in sorted(rows) for w in re.findall(r"[A-Za-z]{2,}", text)]
    rng = random.Random(3)
    rng.shuffle(words)
    return ["".join(words[k : k + 3]) for k in range(0, min(len(words), 3 * PLAIN_RUNS), 3)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, in code points, by start, then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def base_values(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the patterns' matches: of an assignment what is assigned."""
    spans = base_spans(text)
    return [(kind, _ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]) for kind, start, end in spans]


def learned_spans(text: str, judge, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(label, start, end) of the stretches that the automata take for a credential and no pattern has found."""
    found, starts = [], [a for _, a, _ in taken]
    reach = list(accumulate((b for _, _, b in taken), max))
    for m in _RUN.finditer(text):
        for a, b, label in judge(m[0]):
            a, b = m.start() + a, m.start() + b
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                found.append((label, a, b))
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scanned(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (doc_id, text).

    The counts are of the patterns' matches, leftmost and non-overlapping for each kind; base_sha256 is of their list;
    spans also has those that the automata add, which overlap none of the patterns'. All stretches between signs of all runs
    of 16 and more symbols are scored, in texts of any length. Null and empty texts have none, and the list is empty. Rows
    are independent: repeats give repeats; other columns, whatever their names, are ignored; an empty table gives an empty
    one.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(RUNS)(detector.found)
        judge = lambda run: known(run) if len(run) <= REMEMBERED else detector.found(run)
        for batch in sliced(batches):
            rows = []
            for text in texts(batch).to_pylist():
                base = base_spans(text)
                added = learned_spans(text, judge, base)
                spans = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else 3, s[0]))
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                rows.append((*counts, sha256(listed(base).encode()).hexdigest(), listed(spans)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op5_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = plain_runs(docs)
    ordinary = ordinary_runs() | {"plain": plain, "shouted": [run.upper() for run in plain]}
    return scanned(docs, Detector.learned(labelled_credentials() | found_credentials(docs), ordinary))


QUERIES = {"op5_secrets": op5_secrets}
ORACLE: dict[str, str] = {}
