import hashlib
import random
import re

from quillspark.llm.automata import ProbabilisticAutomaton
from quillspark.llm.secrets import Detector, base_spans, found_credentials, labelled_credentials, op5_secrets, ordinary_runs, plain_runs, scanned

SF = "/root/testdata/sf0.1"
PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_query_has_the_base_of_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op5_secrets(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == digest(base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    added = [s for r in got for s in r.spans.split(",") if s and s.split(":")[0] not in PATTERNS]
    assert len(added) < len(docs) / 100


def test_hard_texts():
    for text in ['ToKeN\'= "abcdef" API_KEY:x.y=z/+-', "paſsword=abcdefg toKen=abcdefg", "AKIA" * 9, "é" * 50 + "a" * 24 + "g" + "0" * 23, "secret=12345 secret : 123456", "password=password=abcdefgh", "tokentoken=aaaaaa" * 3, "token =\nabcdefgh"]:
        assert base_spans(text) == brute(text)


def covered(detector, text):
    return sum(b - a for a, b, _ in detector.found(text)) / len(text)


def test_formats_are_told_from_ordinary_text():
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(4, 9))) for _ in range(3000)]
    plain = ["".join(rng.sample(words, 3)) for _ in range(1500)]
    detector = Detector.learned(labelled_credentials(), ordinary_runs() | {"plain": plain})
    fresh = labelled_credentials(60, seed=77)
    assert all(sum(covered(detector, x) > 0.9 for x in found) >= 58 for found in fresh.values())
    other = [x for found in ordinary_runs(200, seed=78).values() for x in found] + ["".join(rng.sample(words, 3)) for _ in range(400)]
    assert sum(bool(detector.found(x)) for x in other) <= 4
    key = fresh["code-token"][0]
    assert detector.found(f"//h.io/{key}") == [(7, 7 + len(key), "code-token")] and detector.found(f"{key}/about.html") == [(0, len(key), "code-token")]


def test_lengths_are_kept():
    rng = random.Random(6)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(300)]
    automaton = ProbabilisticAutomaton.inferred(keys, lengths=True)
    assert len(automaton.ends) == 41
    assert automaton.bits(keys[0]) + 10 < automaton.bits(keys[0][:-1]) + 4 and automaton.bits(keys[0] + "a") > automaton.bits(keys[0]) + 10
    text = keys[1] + "/" + keys[2]
    assert all(abs(bits - automaton.bits(text[:end])) < 1e-9 for end, bits in automaton.bits_to(text, 0, [20, 40, 41]))


def test_planted_credentials_in_documents(spark):
    """Credentials of kinds that no pattern finds, put into real documents, are found where they are, by automata that learn
    from the documents' own labelled credentials too."""
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text is not null")
    fresh = labelled_credentials(40, seed=99)
    kinds = ["api-key", "cloud-secret", "code-token", "payment-key", "model-key"]
    rows, want = [], {}
    for k, (doc_id, text) in enumerate(docs.collect()):
        words = text.split(" ")
        if k % 4 == 0:
            key = fresh[kind := kinds[k // 4 % 5]][k // 20 % 40]
            at = rng.randrange(len(words) + 1)
            before = " ".join([*words[:at], ""])
            key_text = f"//host.io/{key}" if k % 8 == 0 else key
            text = before + key_text + " " + " ".join(words[at:])
            start = len(before) + len(key_text) - len(key)
            want[doc_id] = (kind, start, start + len(key))
        rows.append((doc_id, text))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    learned = found_credentials(docs)
    assert set(learned) == {"like-assign", "like-hex"} and all(0 < len(v) <= 1000 for v in learned.values())
    plain = plain_runs(docs)
    detector = Detector.learned(labelled_credentials() | learned, ordinary_runs() | {"plain": plain, "shouted": [x.upper() for x in plain]})
    hits = false = 0
    for r in scanned(planted, detector).collect():
        added = [s for s in (x.split(":") for x in r.spans.split(",") if x) if s[0] not in PATTERNS]
        right = [s for s in added if r.doc_id in want and int(s[1]) < want[r.doc_id][2] and want[r.doc_id][1] < int(s[2])]
        hits += any((int(s[1]), int(s[2])) == want[r.doc_id][1:] for s in right)
        false += len(added) - len(right)
    assert hits >= 0.95 * len(want) and false <= 0.02 * len(want), (hits, len(want), false)


def test_inference_merges_loops_and_keeps_probabilities():
    rng = random.Random(4)
    strings = ["x" + "".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(400)]
    automaton = ProbabilisticAutomaton.inferred(strings)
    assert len(automaton.ends) <= 8
    assert automaton.bits("xabab") < automaton.bits("abab") and automaton.bits("xabab") < automaton.bits("xabcb")
    assert not list(automaton.bits_to("zzzzz", 0, [5]))
    assert all(abs(sum(2**-b for _, b in s.values()) + (2**-e if e < 12 else 0) - 1) < 1e-6 for s, e in zip(automaton.steps, automaton.ends))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "password=hunter22"), (3, "password=hunter22"), (None, "x " * 90000 + "f" * 40), (4, "key ghp_" + "aZ09" * 9 + " end")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n_hex int")
    detector = Detector.learned(labelled_credentials(), ordinary_runs())
    got = {r.doc_id: r for r in scanned(docs, detector).collect()}
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "assign:0:17" and got[None].spans == "hex:180000:180040" and got[4].spans == "code-token:4:44"
    assert scanned(docs, Detector.learned({}, {})).count() == 6 and scanned(docs.limit(0), detector).count() == 0
