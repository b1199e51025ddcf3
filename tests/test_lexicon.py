"""Dictionary tables against regular expressions."""

import random
import re

from tidemark.functions import vocabulary as V
from tidemark.operators import lexicon

TERMS = "kind string, term string, canonical string, cased boolean, closed boolean"


def brute(text, terms):
    """Leftmost, then longest, then on from its end; by the engine of regular expressions."""
    out = []
    for kind in sorted({t[0] for t in terms}):
        here = sorted((t for t in terms if t[0] == kind and t[1]), key=lambda t: (-len(lexicon_pieces(t[1])), t[2], t[1]))
        at = 0
        while at < len(text or ""):
            for _, term, name, cased, closed in here:
                guard = r"\w." if closed else r"\w"
                m = re.compile(rf"(?<![{guard}]){re.escape(term)}(?![{guard}])", 0 if cased else re.I).match(text, at)
                if m:
                    out.append((kind, name, m.group()))
                    at = m.end()
                    break
            else:
                at += 1
    return out


def lexicon_pieces(text):
    return re.findall(r"\w+|\W", text)


def found(spark, texts, terms):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {}
    for r in lexicon.found_terms(rows, spark.createDataFrame(terms, TERMS)).orderBy("id", "kind", "start").collect():
        out.setdefault(r["id"], []).append((r["kind"], r["canonical"], r["found"]))
    return out


def test_terms_equal_regular_expressions(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "ab", "A", "é", ".", "+", " ", " ", "_", "1", "-", "\n"]
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    terms = {}
    while len(terms) < 60:
        t = make(rng.randint(1, 5)).strip()
        if t:
            terms[(rng.choice("xy"), t.lower())] = (t, rng.random() < 0.2, rng.random() < 0.3)
    rows = [(k, t, f"{k}{i:03}", cased, closed) for i, ((k, _), (t, cased, closed)) in enumerate(sorted(terms.items()))]
    texts = [make(rng.randint(0, 60)) for _ in range(300)] + [None, "", "   "]
    got = found(spark, texts, rows)
    assert len(got) > 200
    for i, text in enumerate(texts):
        assert got.get(i, []) == brute(text, rows), (text, got.get(i))


def test_ties_overlaps_and_blank_terms(spark):
    rows = [("t", "Spring", "z", None, None), ("t", "spring", "a", None, None), ("t", "spring boot", "boot", None, None), ("t", "boot camp", "camp", None, None), ("t", " ", "blank", None, None), ("t", None, "null", None, None), ("t", "C++", "cpp", None, None)]
    got = found(spark, ["Spring boot camp", "spring, boot camp", "c++ C++x c+++", "offspring"], rows)
    assert got == {0: [("t", "boot", "Spring boot")], 1: [("t", "a", "spring"), ("t", "camp", "boot camp")], 2: [("t", "cpp", "c++"), ("t", "cpp", "c++")]}
    assert found(spark, ["spring"], []) == {}


def test_a_dictionary_of_100_000_terms_and_one_that_is_not_broadcast(spark, monkeypatch):
    terms = [("t", f"word{i % 1000} w{i}", f"n{i}", False, False) for i in range(100_000)]
    texts = [f"x word{i % 1000} W{i}, word1 w1 and word{i % 1000} w{i}0000000" for i in range(0, 100_000, 997)]
    want = {j: [("t", f"n{i}", f"word{i % 1000} W{i}"), ("t", "n1", "word1 w1")] for j, i in enumerate(range(0, 100_000, 997))}
    want[0] = [("t", "n0", "word0 W0"), ("t", "n1", "word1 w1")]
    got = found(spark, texts, terms)
    monkeypatch.setattr(lexicon, "BROADCAST_BYTES", 0)
    assert got == found(spark, texts, terms)
    assert all(got[j][:2] == want[j] for j in want)


def entities_brute(text, terms, fields, fallbacks):
    out = []
    for field, kinds in fields.items():
        seen = {}
        for kind in kinds:
            for _, _, m in brute(text, [t for t in terms if t[0] == kind]):
                seen.setdefault(m.lower(), m)
        if not seen:
            for pattern, names in fallbacks.get(field, {}).items():
                if re.search(pattern, (text or "").lower()):
                    seen.update({n: n for n in names if n not in seen})
        out.append(list(seen.values()))
    return out


def test_entities_of_queries(spark):
    kinds = [("cased", "AI", True, False), ("cased", "IT", True, False), ("short", "k8s", False, False), ("short", "js", False, False), ("tech", "node.js", False, True), ("tech", "React", False, True), ("role", "data engineer", False, True), ("role", "engineer", False, True), ("company", "Acme", False, True)]
    terms = [(k, t, t, c, d) for k, t, c, d in kinds]
    fields = {"techs": ["cased", "short", "tech"], "roles": ["role"], "companies": ["company"]}
    fallbacks = {"techs": V.INTENT_TECHS, "roles": V.INTENT_ROLES}
    texts = ["AI and ai for it, React REACT", "học lập trình web", "node.js vs js. And node.js.", "Data Engineer at ACME, engineer", "big data và bảo mật", "nothing", None, "", "K8s k8S devops"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: [r[f] for f in fields] for r in lexicon.entities(rows, spark.createDataFrame(terms, TERMS), fields, fallbacks).collect()}
    assert got == {i: entities_brute(t, terms, fields, fallbacks) for i, t in enumerate(texts)}
    assert got[0][0] == ["AI", "React"] and got[3][1:] == [["Data Engineer", "engineer"], ["ACME"]] and got[1][1][0] == "Frontend Developer"
